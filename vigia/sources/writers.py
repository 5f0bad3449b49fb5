"""Sinks: plain Spark writes, laid out for the joins that read them back."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from vigia.functions import hashing, pii
from vigia.operators import campaigns
from vigia.operators.evidence import evidence_rows


def analysis_tables(scored: DataFrame, pepper: bytes,
                    model_version: str = "local-extractor-v1") -> dict[str, DataFrame]:
    """messages, extractions, signals, verdicts and artifacts of a scored batch, ready to store: bodies,
    links and evidence values redacted, references pseudonymised. All artifacts of a message are stored."""
    column = lambda n, t="string": (
        F.col(n) if n in scored.columns else F.lit(None)).cast(t)
    messages = scored.select(
        "message_id", F.coalesce(column("channel"), F.lit("api")).alias("channel"),
        hashing.hmac_sha256(column("user_reference"), pepper).alias("user_hash"),
        column("received_at", "timestamp").alias("received_at"),
        pii.redact(F.col("body")).alias("body_redacted"),
        F.coalesce(column("lang"), F.lit("es")).alias("lang"),
        F.lit(None).cast("timestamp").alias("purged_at"))
    extractions = scored.select(
        "message_id", "sender_alias",
        F.nullif(pii.redact(F.col("sender_number")), F.lit("")).alias("sender_number"),
        "claimed_entity", F.transform("urls", pii.redact).alias("urls"), "requested_action",
        "urgency_markers", "qr_payload_types")
    signals = evidence_rows(scored).withColumn("value", pii.redact_json(F.col("value"))) \
        .drop("domain")
    verdicts = scored.select(
        "message_id", "level", "message_type", "message_type_confidence", "message_type_reasons",
        "confidence", "score", F.array_join("reasons", " ").alias("explanation"), "action",
        F.lit(model_version).alias("model_version"),
        F.element_at("rule_trace", 1)["version"].alias("ruleset_version"), "rule_trace",
        column("received_at", "timestamp").alias("created_at"))
    return {"messages": messages, "extractions": extractions, "signals": signals,
            "verdicts": verdicts,
            "artifacts": campaigns.build_artifacts(scored, pepper, limits=campaigns.ALL_ARTIFACTS)}


def write_analysis(scored: DataFrame, pepper: bytes, root: str, batch: int | None = None) -> None:
    """Store the analysis tables. The batch is scored once and kept on the executors' disks until all are
    written (a lost executor scores its part again). A numbered batch overwrites its own folder when repeated."""
    once = scored.persist(StorageLevel.DISK_ONLY)
    try:
        for name, df in analysis_tables(once, pepper).items():
            if batch is None:
                df.write.mode("append").parquet(f"{root}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    finally:
        once.unpersist()


def table_digests(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows, messages, digest) of analysis tables: a digest of every row with all its columns, so all of
    them are worked out. Row digests are added up in parts: neither order nor partitions matter, repeated rows do."""
    part = lambda i: F.conv(F.substring("_row", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    found = None
    for name, df in tables.items():
        row = F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256)
        rows = df.select(F.lit(name).alias("table_name"), "message_id", row.alias("_row"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("table_name").agg(
        F.count("*").alias("rows"), F.countDistinct("message_id").alias("messages"),
        F.sha2(F.concat_ws("|", *[F.sum(part(i)).cast("string") for i in range(4)]), 256).alias("digest"))


def append_daily(df: DataFrame, path: str, day: str = "day") -> None:
    """Append-only log, one folder per day."""
    df.write.mode("append").partitionBy(day).json(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Checksum, non-blank lines and size per log file."""
    files = spark.read.format("binaryFile").load(path)
    lines = F.split(F.decode("content", "UTF-8"), r"\r\n|\r|\n")
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"),
        F.sha2("content", 256).alias("sha256"),
        F.size(F.filter(lines, lambda l: F.trim(l) != "")).alias("entry_count"),
        F.col("length").alias("size_bytes"))


def write_cases(cases: DataFrame, path: str) -> None:
    """One case per line; null fields are left out."""
    cases.write.mode("overwrite").json(path)

