"""Streaming counterparts of the batch operators.

Late data: counts use a watermark of ten minutes and drop later rows; scoring is stateless and
still scores them.
"""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from vigia import schemas as S
from vigia.functions import text as tx
from vigia.operators import hunt, intel, upkeep
from vigia.plans.score import ScoreOptions, judge, read_messages
from vigia.session import CHECKPOINT_CONF, stage_table
from vigia.sources.versioned import VersionedTables

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LATENESS = "10 minutes"


def score_stream(messages: DataFrame, options: ScoreOptions = ScoreOptions()) -> DataFrame:
    """Verdicts of a message stream: the batch plan, which keeps no state."""
    return judge(read_messages(messages, options), options)


def score_batches(pepper: bytes, root: str, options: ScoreOptions = ScoreOptions()
                  ) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that stores the analysis tables, one folder per batch: a repeated batch
    overwrites its own rows."""
    from vigia.sources.writers import write_analysis

    def store(batch: DataFrame, epoch: int) -> None:
        write_analysis(score_stream(batch, options), pepper, root, epoch)

    return store


def window_counts(events: DataFrame, at: str, size: str, slide: str | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(w, keys, requests): rows per window and key. A stream gives a window once the watermark has passed it;
    ``drain_windows`` gives the open ones too."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, LATENESS).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("requests"))


def sliding_view(counts: DataFrame, key: str = "user_id", limit: int = S.RATE_LIMIT_ANALYSES) -> DataFrame:
    return counts.select(key, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "requests",
                         (F.col("requests") > limit).alias("over_limit"))


def sliding_rate(events: DataFrame, key: str = "user_id", at: str = "ts", size: str = "60 seconds",
                 slide: str = "10 seconds", limit: int = S.RATE_LIMIT_ANALYSES) -> DataFrame:
    """Requests per key in hopping windows."""
    return sliding_view(window_counts(events, at, size, slide, (key,)), key, limit)


def minute_view(counts: DataFrame, key: str = "user_id", limit: int = S.RATE_LIMIT_ANALYSES) -> DataFrame:
    return counts.select(key, F.col("w.start").alias("minute"), "requests", (F.col("requests") <= limit).alias("allowed"))


def minute_rate(events: DataFrame, key: str = "user_id", at: str = "ts",
                limit: int = S.RATE_LIMIT_ANALYSES) -> DataFrame:
    """Requests per key and calendar minute."""
    return minute_view(window_counts(events, at, "1 minute", keys=(key,)), key, limit)


def trailing_view(counts: DataFrame) -> DataFrame:
    return counts.select(F.col("w.end").alias("until"), F.col("requests").alias("analyses"))


def trailing_day(events: DataFrame, at: str = "ts") -> DataFrame:
    return trailing_view(window_counts(events, at, "24 hours", "1 hour"))


def first_seen(events: DataFrame, keys: list[str], at: str = "ts", within: str = LATENESS) -> DataFrame:
    """Each key once within the watermark: idempotent enqueueing and per-day logs."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


# ---------------------------------------------------------------- exact sliding limiter

_KEPT = "key string, times array<bigint>"
_DECIDED = "key string, row string, t bigint, allowed boolean, retry_after bigint, times array<bigint>"


def decide_requests(rows: DataFrame, kept: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Rows (key, row, t in microseconds) in their order against the allowed times ``kept(key, times)`` of before:
    a request is allowed when fewer than ``limit`` allowed ones lie in (t - window, t]; a refused one does not
    count. The result holds each row's decision and, with null ``row``, the times to keep of each key.

    Spark sorts by (key, time), spilling where it must, and a task walks its rows as a stream: of a key it holds
    ``limit`` times at most, whatever number of rows the key has."""
    window = window_seconds * 1_000_000

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now_key, times = None, deque()

        def record(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out))
            return pa.record_batch([
                pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.bool_()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.list_(pa.int64()))],
                names=["key", "row", "t", "allowed", "retry_after", "times"])

        for batch in batches:
            out = []
            for key, row, t, before in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if key != now_key:
                    if now_key is not None:
                        out.append((now_key, None, None, None, None, list(times)))
                    now_key, times = key, deque()
                if t is None:
                    times.extend(before)
                    continue
                while times and times[0] <= t - window:
                    times.popleft()
                fits = len(times) < limit
                out.append((key, row, t, fits, 0 if fits else max(1, (times[0] + window - t) // 1_000_000 + 1), None))
                if fits:
                    times.append(t)
            if out:
                yield record(out)
        if now_key is not None:
            yield record([(now_key, None, None, None, None, list(times))])

    none = F.lit(None)
    tagged = rows.select("key", "row", "t", none.cast("array<bigint>").alias("times")).unionByName(
        kept.select("key", none.cast("string").alias("row"), none.cast("bigint").alias("t"), "times"))
    return tagged.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("t"), "row").mapInArrow(walk, _DECIDED)


def limit_requests(tables: VersionedTables, key: str = "user_id", at: str = "ts", row: str = "event_id",
                   limit: int = S.RATE_LIMIT_ANALYSES, window_seconds: int = 60) -> Callable[[DataFrame, int], None]:
    """foreachBatch step of the limiter: appends ``decisions`` and replaces ``kept`` in one commit, so a repeated
    batch decides nothing twice. Rows without key or time are not limited and get no decision; a row that arrives
    in a later batch is judged there. Keys whose times lie a window and the allowed lateness back are forgotten."""
    window = window_seconds * 1_000_000

    def step(batch: DataFrame, epoch: int) -> None:
        if tables.committed(epoch):
            return
        rows = batch.select(F.col(key).cast("string").alias("key"), F.col(row).cast("string").alias("row"),
                            F.unix_micros(F.col(at).cast("timestamp")).alias("t")).where("key is not null and t is not null")
        decided = stage_table(decide_requests(rows, tables.read("kept", _KEPT), limit, window_seconds), "decided")
        newest = decided.agg(F.max("t")).first()[0]
        late = 600 * 1_000_000  # LATENESS
        kept = decided.where("row is null").select("key", "times")
        if newest is not None:
            kept = kept.where(F.coalesce(F.element_at("times", -1) > newest - window - late, F.lit(False)))
        tables.commit(epoch, replace={"kept": kept}, append={"decisions": decided.where("row is not null").drop("times")})

    return step


def campaign_sightings(messages: DataFrame, sightings: DataFrame, *, days: int = S.CAMPAIGN_WINDOW_DAYS,
                       threshold: float = S.TEXT_SIMILARITY, bands: int = 4) -> DataFrame:
    """Stream-stream join: ``messages(message_id, simhash, received_at)`` with scam
    ``sightings(campaign_id, c_simhash, seen_at)`` of the days before, on fingerprint slices. Both sides are kept
    for ``days`` behind the watermark. A pair that shares several keys is given under its first one only, which
    both fingerprints tell: one row a pair without further state."""
    from vigia.operators.campaigns import band_keys
    pieces = int((1 - threshold) * 64 + 1e-9) + 1
    keys = lambda c: band_keys(F.col(c), bands, pieces)
    left = messages.where("simhash <> 0").withWatermark("received_at", LATENESS).withColumn("k", F.explode(keys("simhash")))
    right = sightings.where("c_simhash <> 0").withWatermark("seen_at", LATENESS).withColumn("ck", F.explode(keys("c_simhash")))
    first_shared = F.array_position(F.zip_with(keys("simhash"), keys("c_simhash"), lambda a, b: a == b), True)
    return left.join(right, F.expr(
        f"k = ck and seen_at <= received_at and seen_at >= received_at - interval {days} days")).where(
        (tx.similarity(F.col("simhash"), F.col("c_simhash")) >= threshold) & (first_shared == F.col("k.slot") + 1)) \
        .drop("k", "ck")


def live_indicators(messages: DataFrame, indicators: DataFrame, ttl: str) -> DataFrame:
    """Stream-stream join that expires indicators: a match counts while ``seen_at`` is at most
    ``ttl`` old; older state is dropped by the watermark."""
    return messages.withWatermark("received_at", LATENESS).join(
        indicators.withWatermark("seen_at", LATENESS), F.expr(
            "value = value_public and seen_at <= received_at "
            f"and seen_at >= received_at - interval {ttl}"))


def feed_round(tables: VersionedTables, now: Callable[[], datetime]) -> Callable[[DataFrame, int], None]:
    """foreachBatch step of the polling loop: merge a landed feed, log its snapshot, hunt through old messages,
    queue what is new. All tables change in one commit under the batch's number: a repeated batch does nothing, and
    a crash in between leaves the state of before."""
    def step(batch: DataFrame, epoch: int) -> None:
        if tables.committed(epoch):
            return
        at = now()
        incoming = stage_table(intel.as_indicators(batch.select("provider", "indicator_type", "value")), "incoming")
        log = intel.snapshot_rows(incoming, at, f"batch-{epoch}")
        merged = stage_table(intel.merge_snapshot(tables.read("indicators"), incoming, log), "indicators")
        snapshots = stage_table(tables.read("snapshots").unionByName(log), "snapshots")
        artifacts, verdicts = tables.read("artifacts"), tables.read("verdicts")
        found = hunt.hunt_feeds(hunt.fresh_domains(merged, snapshots, at), artifacts, verdicts).unionByName(
            hunt.hunt_campaigns(artifacts, tables.read("campaigns"), verdicts))
        tables.commit(epoch, replace={"indicators": merged}, append={
            "snapshots": log, "reviews": hunt.enqueue(found, tables.read("reviews"), at)})

    return step


def retention_round(tables: VersionedTables, now: Callable[[], datetime], hours: int = S.RETENTION_HOURS
                    ) -> Callable[[DataFrame, int], None]:
    """foreachBatch step of the retention schedule; any trigger stream drives it. Messages and extractions are
    blanked in one commit."""
    def step(_: DataFrame, epoch: int) -> None:
        if tables.committed(epoch):
            return
        at, messages = now(), tables.read("messages")
        tables.commit(epoch, replace={
            "extractions": upkeep.purge_extractions(tables.read("extractions"), messages, at, hours),
            "messages": upkeep.purge_expired(messages, at, hours)})

    return step


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], folder: str) -> None:
    """Run a foreachBatch step over everything that has landed; ``folder`` keeps the stream's progress."""
    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress") \
        .trigger(availableNow=True).start().awaitTermination()


def working_folder(spark, prefix: str) -> str:
    """A new folder under the shared one that the cluster names; a private one only on one machine."""
    shared = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_CONF, None)
    if shared:
        return f"{shared.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder before running on a cluster")
    return tempfile.mkdtemp(prefix=f"{prefix}-")


def drain(stream: DataFrame) -> DataFrame:
    """Run a stream over everything that has landed and give what it wrote."""
    return _drained(stream)[0]


def drain_windows(counts: DataFrame) -> DataFrame:
    """``window_counts`` of everything that has landed: the windows that the stream closed and, from its state,
    those still open."""
    closed, state = _drained(counts)
    held = counts.sparkSession.read.format("statestore").load(state)
    fields = [f"key.`{f}`" for f in held.schema["key"].dataType.names] + [f"value.`{f}`" for f in held.schema["value"].dataType.names]
    return closed.unionByName(held.select(*(F.col(f).alias(n) for f, n in zip(fields, counts.columns))))


def _drained(stream: DataFrame) -> tuple[DataFrame, str]:
    spark = stream.sparkSession
    folder = working_folder(spark, "vigia-stream")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state") \
        .option("path", f"{folder}/rows").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows"), f"{folder}/state"
