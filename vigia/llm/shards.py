"""Sharding by minimax contiguous partition.

All rows of one text are an atomic group; groups stand in the order of their 64-bit text hash. The smallest
feasible capacity is found by binary search with a greedy check over the ordered sizes. The driver never
holds the groups: it searches over sums of key ranges, which bracket the answer, and asks for finer sums of
only those ranges in which a cut can fall, until these are single groups. Each table it gets has at most
``RANGES`` rows, whatever the input.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import DataFrame, Window, functions as F

from vigia.llm.common import keyed, stage

RANGES = 1 << 14
_TOP = 1 << 63
ROWS_PER_TASK = 50_000


class Ranges:
    """Ordered key ranges with their total size, number of groups and largest group."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        self.rows = sorted(rows)  # (first key, last key, total, groups, largest)
        self.ends = list(itertools.accumulate(r[2] for r in self.rows))
        self.total = self.ends[-1] if self.rows else 0
        self.largest = max((r[4] for r in self.rows), default=0)

    def reach(self, done: int, capacity: int) -> int:
        """Number of leading ranges that whole ranges after ``done`` fill within ``capacity``."""
        used = self.ends[done - 1] if done else 0
        return bisect.bisect_right(self.ends, used + capacity)

    def greedy(self, capacity: int, shards: int) -> list[int] | None:
        cuts, done = [], 0
        for _ in range(shards):
            if (further := self.reach(done, capacity)) == done and done < len(self.rows):
                return None
            done = further
            cuts.append(done)
        return cuts if done == len(self.rows) else None

    def capacity(self, shards: int) -> int:
        """Smallest capacity for which the greedy check fits the ranges, taken whole, into the shards."""
        low, high = max(-(-self.total // shards), max((r[2] for r in self.rows), default=0)), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.greedy(middle, shards) else (middle + 1, high)
        return low

    def undecided(self, shards: int) -> list[int]:
        """Ranges of several groups in which a cut of the best partition can fall, the largest first.

        The greedy end of shard k over groups lies between the end that whole ranges reach at the lower
        bound of the capacity and the end of the range that the upper bound touches."""
        high, low = self.capacity(shards), max(-(-self.total // shards), self.largest)
        if high == low:
            return []
        out: set[int] = set()
        early = late = 0
        for _ in range(shards - 1):
            early = max(early, self.reach(early, low))
            late = min(len(self.rows), self.reach(late, high) + 1)
            out.update(i for i in range(early, late) if self.rows[i][3] > 1)
            out.update(i for i in (early - 1,) if i >= 0 and self.rows[i][3] > 1)
        return sorted(out, key=lambda i: -self.rows[i][2])

    def balanced(self, capacity: int, shards: int) -> list[int]:
        """Cuts (numbers of leading ranges) with no shard above ``capacity`` and sizes near the mean of what
        is left; each cut stays between what the rest needs and what the capacity allows."""
        need, after = [len(self.rows)], len(self.rows)
        for _ in range(shards - 1):  # backwards: the earliest cut from which the rest still fits
            floor = self.ends[after - 1] - capacity if after else 0
            after = 0 if floor <= 0 else bisect.bisect_left(self.ends, floor) + 1
            need.append(after)
        need.reverse()
        cuts, done = [], 0
        for k in range(shards - 1):
            used = self.ends[done - 1] if done else 0
            ideal = used + (self.total - used) / (shards - k)
            at = bisect.bisect_left(self.ends, ideal)
            near = [x for x in (at, at + 1) if x <= len(self.rows)]
            pick = min(near, key=lambda x: abs((self.ends[x - 1] if x else 0) - ideal)) if near else len(self.rows)
            done = max(done, min(max(pick, need[k]), self.reach(done, capacity)))
            cuts.append(done)
        return cuts


def _summed(groups: DataFrame, lo, hi) -> DataFrame:
    return groups.groupBy(lo.alias("lo"), hi.alias("hi")).agg(
        F.sum("bytes").cast("long").alias("total"), F.count("*").alias("n"), F.max("bytes").alias("largest"))


def _rows(df: DataFrame) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """(first key of every shard but the first, smallest capacity) for the ordered group sizes of
    ``groups`` (key long, bytes long; one row for each key)."""
    shift = 64 - RANGES.bit_length() + 1
    block = F.shiftright("key", shift)
    first = _rows(_summed(groups, F.shiftleft(block, shift),
                          F.shiftleft(block, shift).bitwiseOR(F.lit((1 << shift) - 1))))
    ranges = Ranges(first)
    while open_ := ranges.undecided(shards):
        # as many ranges at once as keep the answer bounded; the rest waits for a narrower bracket
        open_ = set(open_[:RANGES // 16])
        spans = [(r[0] >> shift, r[0], r[1], max(1, -(-(r[1] - r[0] + 1) // 16))) for r in (ranges.rows[i] for i in open_)]
        inside = groups.withColumn("block", block).join(F.broadcast(groups.sparkSession.createDataFrame(
            spans, "block long, a long, b long, step long")), "block").where("key between a and b")
        part = F.expr("a + step * ((key - a) div step)")
        finer = _rows(_summed(inside, part, F.expr(
            "a + step * ((key - a) div step) + least(step - 1, b - a - step * ((key - a) div step))")))
        ranges = Ranges([r for i, r in enumerate(ranges.rows) if i not in open_] + finer)
    best = ranges.capacity(shards)
    cuts = ranges.balanced(best, shards)
    return [ranges.rows[c][0] if c < len(ranges.rows) else _TOP - 1 for c in cuts], best


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
          overhead: int = 16) -> DataFrame:
    """One row for each input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Sizes are UTF-8 bytes plus ``overhead``; null texts count as empty and are equal to empty ones. Rows of
    one text share a shard. Slots number a shard's rows without gaps in the order of (text hash, spread of
    doc_id). Fewer groups than shards leave shards empty; an empty table gives no rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = keyed(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"))
    rows = stage(rows, "sized")
    groups = stage(rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "groups")
    cuts, _ = minimax_cuts(groups.select("key", "bytes"), shards)
    marks = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    placed = rows.withColumn("shard", F.size(F.filter(marks, lambda c: c <= F.col("key"))).cast("int"))
    # slots: rows are numbered within parts of bounded size; a text with many rows is spread over parts
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    bits = max(0, min(40, (n_rows // ROWS_PER_TASK).bit_length() + 3))
    heavy = groups.where(F.col("n") > ROWS_PER_TASK // 8).select(
        "key", F.ceil(F.col("n") / (ROWS_PER_TASK // 8)).alias("spread"))
    placed = placed.join(heavy, "key", "left").select(
        "doc_id", "size", "text_crc32", "key", "shard", F.shiftright("key", 64 - bits if bits else 63).alias("block"),
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("spread")), F.lit(0)).alias("part"),
        F.when(F.col("spread").isNotNull(), F.col("key")).alias("heavy"))
    part = ["shard", "block", "heavy", "part"]
    sizes = placed.groupBy(*part).agg(F.count("*").alias("m"))
    before = Window.partitionBy("shard").orderBy("block", F.col("heavy").asc_nulls_first(), "part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(*part, F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    numbered = placed.withColumn("nth", F.row_number().over(
        Window.partitionBy(*part).orderBy("key", "doc_id")) - 1)
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in part]
    return numbered.alias("l").join(offsets.alias("r"), same).select(
        "l.doc_id", "l.size", "l.text_crc32", F.lit("bytes").alias("law"), "l.shard",
        (F.col("r.offset") + F.col("l.nth")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
