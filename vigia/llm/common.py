"""What the operators share: written intermediate tables, bounded membership filters, byte kernels.

The kernels work on the raw buffers of an Arrow string column: one uint8 array for all rows of a piece and
the offset at which each row begins. Null texts are empty rows.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigia.session import ensure_checkpoint_dir

PIECE_BYTES = 1 << 20
BATCH_ROWS = 1_000  # rows that a Python worker gets at once; texts make a batch wide
_scratch: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: lineage ends there, the plan knows
    the true size, and a lost executor costs nothing but a read."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    if not _scratch:
        atexit.register(_clear_at_exit, spark)
    _scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every table that ``stage`` wrote in this process; only for callers whose results are stored."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop().rpartition("/")[0])
        path.getFileSystem(conf).delete(path, True)


def _clear_at_exit(spark: SparkSession) -> None:
    try:
        clear_scratch(spark)
    except Exception:  # the session may be gone; the folder's owner cleans up then
        pass


def keep_rows(docs: DataFrame, stays: DataFrame, repeated: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_xx) is in ``stays``, with all their columns; one each of the
    (doc_id, text_xx) in ``repeated``, which are rows that occur more than once."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumns({"__own_xx": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))),
                               "__own_id": F.col(id_col).cast("long")})
    keys = lambda df: df.select(F.col("doc_id").alias("__id"), F.col("text_xx").alias("__xx"))
    same = F.expr("__own_id <=> __id and __own_xx = __xx")
    kept = marked.join(keys(stays), same, "left_semi")
    repeated = stage(keys(repeated), "repeated")
    if repeated.isEmpty():
        return kept.select(*own)
    once = kept.join(repeated, same, "left_anti")
    more = kept.join(repeated, same, "left_semi").dropDuplicates(["__own_id", "__own_xx"])
    return once.unionByName(more).select(*own)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) whatever else the table holds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


# ---------------------------------------------------------------- bounded membership filter

class BitFilter:
    """Bit per hash value modulo ``bits``: a superset test of fixed size, whatever the input's size.

    A false positive costs work, never a result: callers verify what passes."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def hits(self, keys: np.ndarray) -> np.ndarray:
        at = keys.astype(np.uint64) % np.uint64(self.bits)
        return (self.words[(at >> np.uint64(3)).astype(np.int64)]
                >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


def bit_filter(keys: DataFrame, bits: int = 1 << 26) -> BitFilter:
    """Filter over the single long column of ``keys``. Each group is one block of 2^16 bits, so no group and
    no collected array grows with the input: the driver gets ``bits / 8`` bytes at most."""
    block = 1 << 16
    col = keys.columns[0]
    # the unsigned remainder: bits is a power of two, so the low bits decide
    low = F.col(col).bitwiseAND(F.lit(bits - 1))
    blocks = (keys.select(low.alias("at")).distinct()
              .groupBy(F.shiftright("at", 16).alias("block"))
              .agg(F.collect_list(F.col("at").bitwiseAND(F.lit(block - 1)).cast("int")).alias("ones")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ones in batch.column("ones"):
                flags = np.zeros(block, np.uint8)
                flags[np.asarray(ones.values)] = 1
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.record_batch([batch.column("block"), pa.array(out, pa.binary())], names=["block", "bytes"])

    words = np.zeros(bits >> 3, np.uint8)
    for row in blocks.mapInArrow(packed, "block long, bytes binary").toLocalIterator():
        at = row["block"] * (block >> 3)
        words[at:at + (block >> 3)] = np.frombuffer(row["bytes"], np.uint8)
    return BitFilter(words, bits)


# ---------------------------------------------------------------- byte kernels

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(base^i, base^-i) for i in 0..n, modulo 2^64; a few long pieces do not stay in memory."""
    if _powers["n"] < n:
        up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n > 4 * PIECE_BYTES:
            return up, down
        _powers.update(n=n, up=up, down=down)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Prefix:
    """Hashes of any byte ranges of one array from its prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text each; a longer row comes alone."""
    _, at = raw(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word ``[^\\x20\\x09-\\x0D]+``; no word crosses a row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points: entry i counts those that begin before byte i."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def per_piece(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
              column: str = "text", limit: int = PIECE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices of bounded text size."""

    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, limit):
                out = work(piece)
                if out is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)
