"""Tables that change together, the exact limiter, windows still open, pairs given once."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from vigia.sources.versioned import VersionedTables
from vigia.streaming import jobs


def ids(tables, name):
    return sorted(r["i"] for r in tables.read(name).collect())


def test_commits_are_whole_and_repeat_to_nothing(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "i int")
    assert tables.read("a", "i int").count() == 0
    with pytest.raises(KeyError):
        tables.read("a")
    assert tables.commit(-1, replace={"a": rows(1), "b": rows(2)})
    assert tables.commit(0, replace={"a": rows(3)}, append={"b": rows(4)})
    assert not tables.commit(0, replace={"a": rows(9)}, append={"b": rows(9)})
    assert ids(tables, "a") == [3] and ids(tables, "b") == [2, 4]
    broken = rows(5).select(F.raise_error(F.lit("lost")).cast("int").alias("i"))
    with pytest.raises(Exception):
        tables.commit(1, replace={"a": rows(7), "b": broken})
    assert ids(tables, "a") == [3] and ids(tables, "b") == [2, 4] and not tables.committed(1)
    assert tables.commit(1, replace={"b": rows()})
    assert ids(tables, "b") == [] and tables.read("b").columns == ["i"]
    with pytest.raises(ValueError):
        tables.commit(-5, replace={"a": rows(8)})
    assert tables.prune(1) == 3 and ids(tables, "a") == [3] and ids(tables, "b") == []
    assert tables.committed(-1) and tables.committed(0)


def plain_limiter(batches, limit, window):
    """Decisions of rows in batches, each batch in (time, row) order."""
    kept, out = defaultdict(deque), {}
    for batch in batches:
        for key, t, row in sorted((k, t, r) for k, t, r in batch if k is not None and t is not None):
            times = kept[key]
            while times and times[0] <= t - window:
                times.popleft()
            out[row] = len(times) < limit
            if out[row]:
                times.append(t)
    return out


def test_limiter_equals_brute_force_with_a_hot_key_over_batches(spark, tmp_path):
    rnd, micros = random.Random(1), 1_000_000
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None]), rnd.randrange(0, 600) * micros, f"r{i:05d}") for i in range(6_000)]
    rows += [("a", None, "no time")] + [("tie", 5 * micros, f"t{i}") for i in range(5)]
    late = sorted(rows, key=lambda r: (r[1] or 0))
    batches = [late[:2_500], late[2_500:4_000], late[4_000:]]
    tables = VersionedTables(spark, str(tmp_path / "t"))
    step = jobs.limit_requests(tables, limit=3, window_seconds=60)
    for epoch, batch in enumerate(batches):
        df = spark.createDataFrame([(k, None if t is None else t / micros, r) for k, t, r in batch], "user_id string, s double, event_id string") \
            .withColumn("ts", F.timestamp_seconds("s")).repartition(5)
        step(df, epoch)
        step(df, epoch)
    got = {r["row"]: r["allowed"] for r in tables.read("decisions").collect()}
    assert got == plain_limiter(batches, 3, 60 * micros)
    held = {r["key"]: r["times"] for r in tables.read("kept").collect()}
    assert all(len(v) <= 3 for v in held.values())
    retry = tables.read("decisions").where("not allowed").agg(F.min("retry_after"), F.max("retry_after")).first()
    assert retry[0] >= 1 and retry[1] <= 61


def test_limiter_walks_a_long_key_in_bounded_memory(spark, tmp_path):
    """A key of 300,000 rows in one batch: what is kept of it has ``limit`` times."""
    tables = VersionedTables(spark, str(tmp_path / "t"))
    df = spark.range(300_000).select(F.lit("one").alias("user_id"), F.timestamp_seconds(F.col("id") / 100).alias("ts"), F.col("id").alias("event_id"))
    jobs.limit_requests(tables, limit=10, window_seconds=60)(df, 0)
    assert tables.read("decisions").where("allowed").count() == 10 * 50 and tables.read("decisions").count() == 300_000
    assert len(tables.read("kept").first()["times"]) == 10


def test_open_windows_come_from_the_state(spark, tmp_path):
    for k, minutes in enumerate([(0, 1, 1), (2, 40)]):
        spark.createDataFrame([(m * 60, "u") for m in minutes], "s long, user_id string").withColumn("ts", F.timestamp_seconds("s")) \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s long, user_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = jobs.drain_windows(jobs.window_counts(stream, "ts", "1 minute", keys=("user_id",)))
    got = sorted((r["minute"].timestamp() // 60, r["requests"]) for r in jobs.minute_view(counts).collect())
    assert got == [(0, 1), (1, 2), (2, 1), (40, 1)]


def test_observations_are_read_whole_in_ranges_and_once_in_a_stream(spark, tmp_path, monkeypatch):
    import json
    from vigia.sources import observations as obs
    lines = [json.dumps({"provider": "p", "indicator_type": "domain", "value": f"é{i}.example" * (1 + i % 4)}, ensure_ascii=False) for i in range(300)]
    lines[7], lines[8], lines[9] = "", "[1]", '{"provider": "p"'
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "a.jsonl"
    path.write_text("\n".join(lines), encoding="utf-8")
    whole = [r for b in obs.read_range(str(tmp_path), obs.FileRange(str(path), 0, path.stat().st_size)) for r in b.to_pylist()]
    assert len(whole) == 299 and sum(r["status"] == "malformed" for r in whole) == 2
    for size in (50, 333, 5_000):
        monkeypatch.setattr(obs, "RANGE_BYTES", size)
        parts = obs._ranges(obs.landed_files(str(tmp_path / "in")))
        cut = [r for p in parts for b in obs.read_range(str(tmp_path), p) for r in b.to_pylist()]
        assert cut == whole
    spark.dataSource.register(obs.ObservationSource)
    read = lambda: spark.readStream.format("observations").load(str(tmp_path / "in"))
    for extra, expected in ((None, 299), ("b.jsonl", 301), (None, 301)):
        if extra:
            (tmp_path / "in" / extra).write_text("\n".join(lines[:2]))
        read().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")) \
            .trigger(availableNow=True).start().awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == expected
    (tmp_path / "none").mkdir()
    assert spark.read.format("observations").load(str(tmp_path / "none")).count() == 0
