"""Tables that change together: every commit writes new folders and then, in one rename, a file that names them.

A reader sees the tables of the latest commit whole or not at all. A commit carries a batch number; the same number
again does nothing, so a repeated micro-batch changes nothing, and a crash before the rename leaves the old state.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/commits"))

    # ------------------------------------------------------------ commits

    def _commits(self) -> list[str]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/commits"))]
        return sorted(n for n in names if n.endswith(".json"))

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/commits/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode() or "{}")
        finally:
            stream.close()

    def current(self) -> dict[str, dict]:
        """Folders and schema of each table as of the latest commit."""
        names = self._commits()
        return self._load(names[-1]) if names else {}

    def committed(self, batch: int) -> bool:
        return self._fs.exists(self._path(f"{self.root}/commits/{batch:020d}.json"))

    def commit(self, batch: int, replace: dict[str, DataFrame] | None = None,
               append: dict[str, DataFrame] | None = None) -> bool:
        """Write the tables and make them visible together; False if the batch was committed before."""
        if self.committed(batch):
            return False
        names = self._commits()
        if names and int(names[-1][:-5]) > batch:
            raise ValueError(f"batch {batch} comes after {int(names[-1][:-5])}")
        tables = self._load(names[-1]) if names else {}
        for added, frames in ((False, replace or {}), (True, append or {})):
            for name, df in frames.items():
                folder = f"{self.root}/data/{name}/{batch:020d}-{uuid.uuid4().hex}"
                df.write.parquet(folder)
                before = tables[name]["folders"] if added and name in tables else []
                tables[name] = {"folders": [*before, folder], "schema": df.schema.jsonValue()}
        draft = self._path(f"{self.root}/commits/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(tables).encode()))
        finally:
            stream.close()
        if not self._fs.rename(draft, self._path(f"{self.root}/commits/{batch:020d}.json")):
            self._fs.delete(draft, False)
            raise RuntimeError(f"batch {batch} was committed by another writer")
        return True

    # ------------------------------------------------------------ tables

    def read(self, name: str, schema: str | StructType | None = None) -> DataFrame:
        """The table as of the latest commit; an empty one of ``schema`` before its first."""
        known = self.current().get(name)
        if known is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(StructType.fromJson(known["schema"])).parquet(*known["folders"])

    def prune(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` commits names, and commits before those; gives how many
        folders went. Readers of older states must be done."""
        names = self._commits()
        kept = {f for n in names[-keep:] for t in self._load(n).values() for f in t["folders"]}
        gone = {f for n in names[:-keep] for t in self._load(n).values() for f in t["folders"]} - kept
        for folder in gone:
            self._fs.delete(self._path(folder), True)
        for n in names[:-keep]:
            # an empty file still says that the batch was committed
            self._fs.create(self._path(f"{self.root}/commits/{n}"), True).close()
        return len(gone)
