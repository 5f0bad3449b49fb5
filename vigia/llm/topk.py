"""Exact inner-product search: the k highest products of every query with all other vectors.

Vectors are ordered by dimension and length and dealt to tasks in ranges; a task packs its range into buckets of
vectors of about equal length, longest first. Queries are packed the same way into blocks. Every block meets every
range of buckets in a task of its own (a tile of bounded size), and the tile takes its buckets in order. For a query
with threshold t (its k-th best product so far), a bucket's local cosine threshold is t / (length of the query *
greatest length in the bucket): over one, the bucket is left out; low, its vectors are pruned by length, a prefix of
the bucket in one matrix product; high, by coordinates: a candidate must lie, in each of the query's largest
coordinates, in the interval that the threshold's angle leaves. What is left is verified by exact products. The
first range gives all queries thresholds before they meet the others.

Products are of whole numbers, floor(scale * x): sums below 2^53 are exact in doubles, others are taken in Python's
integers and held at the ends of a long. Nothing equal to a threshold is pruned, so ties go to the smaller id.

Defined results: vectors that are null or hold null or non-finite components take no part; rows are candidates each
for itself (a repeated row may be found as often as it occurs, and only the query's own row is left out); a null id is
no query and as a candidate comes last among ties; vectors of another dimension than the query's are no candidates;
an empty vector has product 0 with every empty vector; fewer candidates than k give fewer rows; an empty table none;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from vigia.llm.common import small_batches, stage

BUCKET_ROWS, BUCKET_BYTES = 1_024, 1 << 20
TILE_BUCKETS = 8  # buckets of a range of vectors, and of a block of queries, on average
LENGTH_UP_TO = 0.4  # local cosine thresholds up to this are pruned by length
FOCUS = 4  # coordinates that coordinate pruning looks at
SLACK = 1e-9  # bounds are rounded to the safe side by this part
LONG = (-(1 << 63), (1 << 63) - 1)
PACKED = "grp long, dim int, ids binary, nulls binary, rows binary, norms binary, thetas binary, body binary"
FOUND = "row_no long, query_id long, score long, vec_id long, found_row long"


def prepared(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(row_no, vec_id, dim, norm, body) of the vectors that take part; body holds their whole numbers as doubles."""
    small_batches(vectors.sparkSession)
    plain = vectors.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("vec_id"),
                           F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            fine = np.flatnonzero(bad[ends[1:]] == bad[ends[:-1]])
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.clip(np.floor(flat * scale), -1e300, 1e300)
            rows = [whole[ends[i]:ends[i + 1]] for i in fine]
            with np.errstate(over="ignore"):
                norms = [float(np.sqrt(np.dot(r, r))) for r in rows]
            take = pa.array(fine)
            yield pa.record_batch([batch.column("row_no").take(take), batch.column("vec_id").take(take),
                                   pa.array([len(r) for r in rows], pa.int32()), pa.array(norms, pa.float64()),
                                   pa.array([r.tobytes() for r in rows], pa.binary())],
                                  names=["row_no", "vec_id", "dim", "norm", "body"])

    return plain.mapInArrow(work, "row_no long, vec_id long, dim int, norm double, body binary")


def packed(vectors: DataFrame, groups: int) -> DataFrame:
    """Buckets of vectors of one dimension and about equal length, longest first; ``grp`` is the range they lie in.
    A column ``theta``, if there is one, goes along as each vector's threshold."""
    if "theta" not in vectors.columns:
        vectors = vectors.withColumn("theta", F.lit(-math.inf))
    ranged = (vectors.withColumn("shorter", -F.col("norm")).repartitionByRange(groups, "dim", "shorter", "row_no")
              .sortWithinPartitions("dim", "shorter", "row_no")
              .select("row_no", "vec_id", "dim", "norm", F.coalesce("theta", F.lit(-math.inf)).alias("theta"), "body"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, held, dim = TaskContext.get().partitionId(), [], None

        def bucket() -> pa.RecordBatch:
            ids = np.array([r[1] or 0 for r in held], np.int64)
            row = [grp, dim, ids.tobytes(), np.array([r[1] is None for r in held]).tobytes(),
                   np.array([r[0] for r in held], np.int64).tobytes(), np.array([r[3] for r in held]).tobytes(),
                   np.array([r[4] for r in held], np.float64).tobytes(), b"".join(r[5] for r in held)]
            held.clear()
            return pa.record_batch([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.int32()),
                                    *(pa.array([x], pa.binary()) for x in row[2:])],
                                   names=["grp", "dim", "ids", "nulls", "rows", "norms", "thetas", "body"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if held and (row[2] != dim or len(held) >= min(BUCKET_ROWS, max(1, BUCKET_BYTES // (8 * max(dim, 1))))):
                    yield bucket()
                held.append(row)
                dim = row[2]
        if held:
            yield bucket()

    return ranged.mapInArrow(work, PACKED)


# ---------------------------------------------------------------- one tile

class Bucket:
    """A packed row, unpacked."""

    def __init__(self, row: dict):
        n, self.dim = len(row["rows"]) // 8, row["dim"]
        self.ids, self.rows = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
        self.nulls, self.norms = np.frombuffer(row["nulls"], bool), np.frombuffer(row["norms"])
        self.thetas = np.frombuffer(row["thetas"]).copy()
        self.body = np.frombuffer(row["body"]).reshape(n, self.dim)
        self.largest = float(np.abs(self.body).max(initial=0))
        with np.errstate(invalid="ignore", divide="ignore"):
            self.unit = np.nan_to_num(self.body / np.where(self.norms > 0, self.norms, 1)[:, None])


def products(queries: np.ndarray, vectors: np.ndarray, exact: bool) -> np.ndarray:
    """Products of whole numbers: in doubles where every sum is exact in them, else in Python's integers."""
    if exact:
        return queries @ vectors.T
    left, right = ([[int(x) for x in row] for row in m] for m in (queries, vectors))
    out = np.empty((len(left), len(right)), object)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            out[i, j] = min(max(sum(x * y for x, y in zip(a, b)), LONG[0]), LONG[1])
    return out


def coordinate_candidates(query: np.ndarray, bucket: Bucket, cosine: float) -> np.ndarray:
    """Rows that lie, in the query's largest coordinates, in the interval left by the cosine threshold."""
    gap = math.acos(max(-1.0, min(1.0, cosine - SLACK)))
    keep = np.ones(len(bucket.rows), bool)
    for f in np.argsort(-np.abs(query))[:FOCUS]:
        angle = math.acos(max(-1.0, min(1.0, query[f])))
        low, high = math.cos(min(math.pi, angle + gap)) - SLACK, math.cos(max(0.0, angle - gap)) + SLACK
        keep &= (bucket.unit[:, f] >= low) & (bucket.unit[:, f] <= high)
    return np.flatnonzero(keep)


class Best:
    """The k best of one query so far, ties by null and id."""

    __slots__ = ("k", "found", "theta")

    def __init__(self, k: int, theta: float):
        self.k, self.found, self.theta = k, [], theta

    def offer(self, scores: np.ndarray, bucket: Bucket, at: np.ndarray, own: int) -> None:
        good = scores >= self.theta
        if len(scores) > 4 * self.k and good.sum() > 4 * self.k:  # the (k + 1)-th is a bound that keeps all ties
            good &= scores >= np.partition(scores, len(scores) - self.k - 1)[len(scores) - self.k - 1]
        for i in np.flatnonzero(good):
            row = at[i]
            if bucket.rows[row] != own:
                null = bool(bucket.nulls[row])
                self.found.append((-int(scores[i]), null, 0 if null else int(bucket.ids[row]), int(bucket.rows[row])))
        if len(self.found) > self.k:
            self.found = sorted(self.found)[:self.k]
        if len(self.found) == self.k:
            self.theta = max(self.theta, float(min(-f[0] for f in self.found)))


def search(block: Bucket, buckets: list[Bucket], k: int) -> list[tuple]:
    """(row_no, query_id, score, vec_id, found_row): the best of these buckets for each query of the block."""
    best = [Best(k, t) for t in block.thetas]
    for bucket in buckets:
        exact = block.largest * bucket.largest * max(block.dim, 1) < 2.0 ** 53
        longest, every = bucket.norms[0], np.arange(len(bucket.rows))
        by_length, cuts = [], []
        for q, state in enumerate(best):
            bound = block.norms[q] * longest
            if not exact or not math.isfinite(bound) or state.theta <= 0 or bound == 0:
                if state.theta <= 0 or bound != 0:  # nothing is known, or nothing can be left out safely
                    by_length.append(q)
                    cuts.append(len(every))
                continue
            cosine = state.theta / bound
            if cosine > 1 + SLACK:
                continue
            if cosine <= LENGTH_UP_TO:
                by_length.append(q)
                shortest = state.theta / block.norms[q] * (1 - SLACK)
                cuts.append(int(np.searchsorted(-bucket.norms, -shortest, "right")))
                continue
            at = coordinate_candidates(block.unit[q], bucket, cosine)
            if len(at):
                state.offer(products(block.body[q:q + 1], bucket.body[at], True)[0], bucket, at, block.rows[q])
        if by_length:
            upto = max(cuts)
            table = products(block.body[by_length], bucket.body[:upto], exact)
            for q, cut, scores in zip(by_length, cuts, table):
                best[q].offer(scores[:cut], bucket, every, block.rows[q])
    return [(int(block.rows[q]), int(block.ids[q]), -f[0], None if f[1] else f[2], f[3])
            for q, state in enumerate(best) for f in state.found]


def tiles(blocks: DataFrame, buckets: DataFrame, k: int, first: int, last: int) -> DataFrame:
    """The search of all blocks in the ranges ``first`` to ``last``, a task for each block range and bucket range."""
    block_groups = blocks.agg(F.max("grp")).first()[0]
    if block_groups is None or last < first:
        return blocks.sparkSession.createDataFrame([], FOUND)
    left = blocks.withColumn("side", F.explode(F.sequence(F.lit(first), F.lit(last)).cast("array<long>")))
    right = (buckets.where(F.col("grp").between(first, last)).withColumnRenamed("grp", "side")
             .withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(block_groups)).cast("array<long>"))))

    def work(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        there = [Bucket(r) for r in vectors.to_pylist()]
        rows = []
        for row in queries.to_pylist():
            block = Bucket(row)
            same = sorted((b for b in there if b.dim == block.dim), key=lambda b: -b.norms[0])
            rows += search(block, same, k)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5,
                        names=["row_no", "query_id", "score", "vec_id", "found_row"])

    return left.groupBy("grp", "side").cogroup(right.groupBy("grp", "side")).applyInArrow(work, FOUND)


def top_products(vectors: DataFrame, queries: str, k: int = 5, scale: int = 256, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each row for which ``queries``, a condition on
    vec_id, holds."""
    rows = stage(prepared(vectors, scale, id_col, vector_col), "vectors")
    asked = rows.where(queries)
    groups = lambda n: max(1, math.ceil(n / (BUCKET_ROWS * TILE_BUCKETS)))
    buckets = stage(packed(rows, groups(rows.count())), "buckets")
    n_asked = asked.count()
    blocks = stage(packed(asked, groups(n_asked)), "blocks")
    last = buckets.agg(F.max("grp")).first()[0]
    begun = stage(tiles(blocks, buckets, k, 0, -1 if last is None else 0), "seeds")
    thresholds = begun.groupBy("row_no").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("theta")).where(F.col("n") == k)
    found = begun
    if last:
        known = stage(packed(asked.join(thresholds.drop("n"), "row_no", "left"), groups(n_asked)), "known_blocks")
        found = begun.unionByName(tiles(known, buckets, k, 1, last))
    order = Window.partitionBy("row_no").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "found_row")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
