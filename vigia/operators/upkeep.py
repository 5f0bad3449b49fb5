"""Retention, rate limits and trailing counts."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window, functions as F

from vigia import schemas as S


def purge_expired(messages: DataFrame, now: datetime, retention_hours: int = S.RETENTION_HOURS) -> DataFrame:
    """Blank the content and pseudonym of messages past their time; the rows stay. Idempotent."""
    due = _due(now, retention_hours)
    return messages.withColumns({
        "body_redacted": F.when(due, "").otherwise(F.col("body_redacted")),
        "user_hash": F.when(~due, F.col("user_hash")),
        "purged_at": F.when(due, F.lit(now)).otherwise(F.col("purged_at")),
    })


def purge_extractions(extractions: DataFrame, messages: DataFrame, now: datetime,
                      retention_hours: int = S.RETENTION_HOURS) -> DataFrame:
    """Sender, links and urgency markers of the messages that ``purge_expired`` blanks."""
    due = messages.where(_due(now, retention_hours)).select("message_id", F.lit(True).alias("_due"))
    gone = F.coalesce("_due", F.lit(False))
    none = F.array().cast("array<string>")
    return extractions.join(due, "message_id", "left").withColumns({
        "sender_alias": F.when(~gone, F.col("sender_alias")),
        "sender_number": F.when(~gone, F.col("sender_number")),
        "urls": F.when(gone, none).otherwise(F.col("urls")),
        "urgency_markers": F.when(gone, none).otherwise(F.col("urgency_markers")),
    }).drop("_due")


def _due(now: datetime, retention_hours: int):
    cutoff = now - timedelta(hours=max(0, retention_hours))
    return F.coalesce((F.col("received_at") < F.lit(cutoff)) & F.col("purged_at").isNull(),
                      F.lit(False))


def sliding_counts(events: DataFrame, key: str = "user_id", at: str = "ts",
                   window_seconds: int = 60, limit: int | None = None) -> DataFrame:
    """Events of the same key in (t - window, t], for every event, ties included.

    A key may own a third of all rows, so the frame never spans a key: rows are grouped per key
    and time bucket of one window's length, and each bucket also receives a copy of the rows of
    the bucket before it. Groups therefore hold two windows of one key at most, and a row is
    copied once.
    """
    micros = F.unix_micros(at)
    size = window_seconds * 1_000_000
    bucket = F.floor(micros / size)
    copies = events.withColumns({"_t": micros, "_b": bucket}).withColumn(
        "_g", F.explode(F.array(F.col("_b"), F.col("_b") + 1)))
    frame = Window.partitionBy(key, "_g").orderBy("_t").rangeBetween(-(size - 1), 0)
    counted = copies.withColumn("in_window", F.count("*").over(frame)).where("_g = _b") \
        .drop("_g", "_b", "_t")
    return counted.withColumn("over_limit", F.col("in_window") > limit) if limit else counted


def minute_buckets(events: DataFrame, key: str = "user_id", at: str = "ts",
                   limit: int = S.RATE_LIMIT_ANALYSES) -> DataFrame:
    """Events per key and calendar minute and whether the minute's limit holds."""
    return events.groupBy(key, F.date_trunc("minute", at).alias("minute")).agg(
        F.count("*").alias("requests")).withColumn("allowed", F.col("requests") <= limit)


def trailing_day(events: DataFrame, at: str = "ts") -> DataFrame:
    """Events of the 24 hours before each full hour (hopping windows)."""
    return events.groupBy(F.window(at, "24 hours", "1 hour").alias("w")).agg(
        F.count("*").alias("analyses")).select(F.col("w.end").alias("until"), "analyses")
