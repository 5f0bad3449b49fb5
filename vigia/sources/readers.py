"""Readers for landed files. All of them are DataFrames from the first step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vigia import schemas as S
from vigia.functions import urls as ur


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; blank lines and lines that begin with # are skipped.

    Reading is strict: a line that does not parse, a missing id, label, message or expected level,
    a repeated id or an empty set raises an error. The checks are one small aggregation each.
    """
    lines = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("file")) \
        .where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    parsed = lines.withColumn("case", F.from_json(
        "value", T.StructType([*S.EVALUATION_CASES.fields,
                               T.StructField("_corrupt_record", T.StringType())]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.col("case").isNull() | F.col("case._corrupt_record").isNotNull()
    for needed in ("id", "label", "message", "expected_level"):
        broken = broken | F.coalesce(F.col(f"case.{needed}") == "", F.lit(True))
    broken = broken | ~F.col("case.label").isin("scam", "legitimate", "spam", "unknown") \
        | ~F.col("case.expected_level").isin(S.LEVEL_SCAM, S.LEVEL_UNCERTAIN)
    bad = parsed.where(broken).select("file", F.substring("value", 1, 120).alias("line")).take(1)
    if bad:
        raise ValueError(f"invalid case in {bad[0]['file']}: {bad[0]['line']}")
    cases = parsed.select("case.*").drop("_corrupt_record")
    repeated = cases.groupBy("id").count().where("count > 1").take(1)
    if repeated:
        raise ValueError(f"case id is not unique: {repeated[0]['id']}")
    if not cases.take(1):
        raise ValueError(f"no cases in {path}")
    return cases.withColumns({
        "required_signals": F.coalesce("required_signals", F.array().cast("array<string>")),
        "language": F.coalesce("language", F.lit("es")),
        "source": F.coalesce("source", F.lit("local")),
        "split": F.coalesce("split", F.lit("validation")),
    })


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Corpus CSV with a header, quoted line breaks allowed; every column is text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def read_sms_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Labelled SMS rows; files may lack some of the columns."""
    return spark.read.schema(
        "id string, category string, sender string, message string, expected_verdict string, "
        "expected_type string, scam_type string, lure string").json(path)


def feed_values(lines: DataFrame, provider: str, form: str, kind: str,
                column: str = "value") -> DataFrame:
    """Distinct normalised values of a feed given as text lines: ``csv`` (every cell), ``hostfile``
    (second field after a local address, else every field) or plain ``text``."""
    line = F.trim(F.regexp_replace(F.col(column), "^﻿", ""))
    usable = lines.select(line.alias("line")).where("line <> ''")
    if form == "csv":
        # cells, quoted or not; quotes are doubled inside a quoted cell
        cells = F.regexp_extract_all(
            F.concat(F.lit(","), F.col("line")),
            F.lit(r',(?:\s*"((?:[^"]|"")*)"|([^,]*))'), F.lit(0))
        candidates = F.transform(cells, lambda c: F.replace(F.regexp_replace(
            F.trim(F.substring(c, F.lit(2), F.char_length(c))), r'^"|"$', ""),
            F.lit('""'), F.lit('"')))
    elif form == "hostfile":
        parts = F.split("line", r"\s+")
        local = (F.size(parts) >= 2) & F.get(parts, F.lit(0)).isin("127.0.0.1", "0.0.0.0")
        candidates = F.when(F.col("line").rlike("^(#|//)"), F.array().cast("array<string>")) \
            .when(local, F.slice(parts, 2, 1)).otherwise(parts)
    else:
        candidates = F.array("line")
    value = F.trim("candidate")
    normal = ur.normal_domain(value) if kind == "domain" else ur.canonical_url(value)
    return usable.select(F.explode(candidates).alias("candidate")) \
        .where((value != "") & ~value.rlike("^(#|//)")) \
        .select(normal.alias("value")).where("value is not null").distinct() \
        .select(F.lit(provider).alias("provider"), F.lit(kind).alias("indicator_type"), "value")


def read_feed(spark: SparkSession, path: str, provider: str, form: str, kind: str) -> DataFrame:
    return feed_values(spark.read.text(path), provider, form, kind)


def verified_phish(rows: DataFrame) -> DataFrame:
    """Verified and online entries of a phish list whose host has a dot."""
    yes = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))) == "yes"
    return rows.where(yes("verified") & yes("online")).select(
        "phish_id", F.trim("url").alias("url"), ur.host(F.trim("url")).alias("host"), "target",
        "submission_time", F.col("phish_detail_url").alias("detail_url")
    ).where(F.col("host").contains("."))


def read_certificates(spark: SparkSession, path: str) -> DataFrame:
    """Certificate rows from JSON (arrays or lines); other JSON values are dropped."""
    return spark.read.schema(S.CERTIFICATES).json(path, multiLine=True) \
        .where("name_value is not null")


def observations_from(rows: DataFrame, provider: str, version: str = "1",
                      provenance: Column | None = None) -> DataFrame:
    """The contract of a connector: any table with value, indicator_type and times becomes
    observation rows. A custom source is a function that returns such a DataFrame."""
    have = set(rows.columns)
    cell = lambda n, t: (F.col(n) if n in have else F.lit(None)).cast(t).alias(n)
    fixed_values = {"provider": F.lit(provider), "version": F.lit(version),
                    "status": F.coalesce("status", F.lit("active")) if "status" in have
                    else F.lit("active"),
                    "retryable": F.lit(False),
                    "provenance": provenance if provenance is not None
                    else F.create_map().cast("map<string,string>")}
    return rows.select(*[
        fixed_values[f.name].alias(f.name) if f.name in fixed_values
        else cell(f.name, f.dataType.simpleString()) for f in S.OBSERVATIONS.fields])
