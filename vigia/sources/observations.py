"""Observations that connectors land as JSON lines in a folder, as a Spark data source for batch and stream.

``spark.dataSource.register(ObservationSource)``, then ``spark.read.format("observations").load(folder)`` or
``spark.readStream...``. Files are cut into byte ranges, each read by its own task; a stream takes files in the order
in which they landed (time of change, then path) and remembers the last one. Files are opened by pyarrow's file
systems (local, hdfs, s3, ...). Files whose names begin with . or _ are not data.

A line that is no JSON object, or lacks provider, indicator_type or value, gives a row with status ``malformed`` and
the place of the line in ``provenance``; nothing is dropped. Missing fields are null, but status (active), version (1)
and retryable (false).
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from vigia import schemas as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RANGE_BYTES = 32 << 20
BATCH_LINES = 2_000
_FIELDS = [f.name for f in S.OBSERVATIONS.fields]
_TIMES = ("first_seen", "last_seen", "retrieved_at", "expires_at")
_ARROW = pa.schema([(n, pa.timestamp("us", "UTC") if n in _TIMES else pa.float64() if n == "confidence" else
                     pa.map_(pa.string(), pa.string()) if n == "provenance" else pa.bool_() if n == "retryable" else pa.string())
                    for n in _FIELDS])


class FileRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _open(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def landed_files(root: str) -> list[tuple[int, str, int]]:
    """(time of change in ns, path, size) of the data files below a folder, in landing order."""
    system, path = _open(_uri(root))
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found
                  if f.type == fs.FileType.File and not any(p[:1] in "._" for p in f.path[len(path):].split("/") if p))


def _uri(root: str) -> str:
    """Hadoop writes local paths as file:/x, which URI parsers take for a host name."""
    return f"file://{root[5:]}" if root.startswith("file:/") and not root.startswith("file://") else root


def _ranges(files: list[tuple[int, str, int]]) -> list[FileRange]:
    return [FileRange(path, at, min(at + RANGE_BYTES, size)) for _, path, size in files for at in range(0, size, RANGE_BYTES)]


def _time(value) -> datetime | None:
    if value in (None, ""):
        return None
    at = datetime.fromisoformat(str(value).replace("Z", "+00:00"))
    return at.astimezone(UTC) if at.tzinfo else at.replace(tzinfo=UTC)


def _row(line: str, place: str) -> dict:
    try:
        given = json.loads(line)
        if not all(isinstance(given[k], str) and given[k] for k in ("provider", "indicator_type", "value")):
            raise ValueError
        row = {k: given.get(k) for k in _FIELDS} | {k: _time(given.get(k)) for k in _TIMES}
        row["confidence"] = None if row["confidence"] is None else float(row["confidence"])
        row["provenance"] = [(str(k), v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False))
                             for k, v in (row["provenance"] or {}).items()]
        row["status"], row["version"] = str(row["status"] or "active"), str(row["version"] or "1")
        row["retryable"] = bool(row["retryable"])
        return row
    except (ValueError, TypeError, KeyError, AttributeError):
        return dict.fromkeys(_FIELDS) | {"status": "malformed", "version": "1", "retryable": False, "provenance": [("place", place)]}


def read_range(root: str, part: FileRange) -> Iterator[pa.RecordBatch]:
    """The lines that begin inside the range."""
    system, _ = _open(_uri(root))
    with system.open_input_file(part.path) as raw:
        file = pa.PythonFile(raw, mode="r") if not hasattr(raw, "readline") else raw
        at, held = part.start, b""
        if at:  # the line that is under way belongs to the range before
            at -= 1
        file.seek(at)
        rows, skip = [], part.start > 0
        while True:
            chunk = file.read(1 << 20)
            lines = (held + chunk).split(b"\n")
            held = lines.pop() if chunk else b""
            for line in lines:
                begins, at = at, at + len(line) + 1
                if skip:
                    skip = False
                    continue
                if begins >= part.end:
                    chunk = b""
                    held = b""
                    break
                if line.strip():
                    rows.append(_row(line.decode("utf-8", "replace"), f"{part.path}:{begins}"))
                if len(rows) >= BATCH_LINES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
            if not chunk:
                break
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[FileRange]:
        return _ranges(landed_files(self.root)) or [FileRange("", 0, 0)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return read_range(self.root, partition) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are the landing time and path of the last file that was taken."""

    def __init__(self, root: str):
        self.root = root

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = landed_files(self.root)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        key = lambda o: (o["time"], o["path"])
        return _ranges([f for f in landed_files(self.root) if key(start) < f[:2] <= key(end)]) or [FileRange("", 0, 0)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        return read_range(self.root, partition) if partition.path else iter(())

    def commit(self, end: dict) -> None:
        pass


class ObservationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self):
        return S.OBSERVATIONS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])
