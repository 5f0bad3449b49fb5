"""Labelled corpora: import with leakage-safe splits, evaluation and its integrity checks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from vigia import fixed, schemas as S
from vigia.functions import pii, urls as ur
from vigia.functions.text import pin
from vigia.operators.extract import loose_date

# Candidate column names per field and profile, best first.
PROFILES: dict[str, dict[str, tuple[str, ...]]] = {
    "ncsu": {
        "text": ("message", "sms", "text", "body"), "label": (),
        "campaign": ("campaign", "campaign_id", "cluster"),
        "timestamp": ("timestamp", "first_seen", "date"), "language": ("language", "lang"),
        "scam_type": ("scam_type", "category"), "lure": ("lure", "lure_type"),
    },
    "imc25": {
        "text": ("message", "sms", "text", "content"), "label": ("label", "class", "is_smishing"),
        "campaign": ("campaign", "campaign_id", "cluster"),
        "timestamp": ("timestamp", "created_at", "date", "time"), "language": ("language", "lang"),
        "scam_type": ("scam", "scam_type", "category"), "lure": ("lure", "lure_type", "lure_principle"),
    },
    "generic": {
        "text": ("message", "sms", "text", "body", "content"),
        "label": ("label", "class", "category"),
        "campaign": ("campaign", "campaign_id", "cluster"),
        "timestamp": ("timestamp", "observed_at", "date", "first_seen"),
        "language": ("language", "lang"), "scam_type": ("scam_type", "type"),
        "lure": ("lure", "lure_type"),
    },
}
PHISHING_ONLY = ("ncsu", "imc25")


def pick(df: DataFrame, names: tuple[str, ...]) -> Column:
    """First non-empty of several candidate columns, whatever their case."""
    by_lower = {c.lower(): c for c in df.columns}
    found = [F.when(F.col(f"`{by_lower[n]}`").cast("string") != "",
                    F.trim(F.col(f"`{by_lower[n]}`").cast("string"))) for n in names if n in by_lower]
    return F.coalesce(*found, F.lit(None).cast("string")) if found else F.lit(None).cast("string")


def normal_label(value: Column, phishing_only: bool = False) -> Column:
    if phishing_only:
        return F.lit("scam")
    known = F.lower(F.coalesce(value, F.lit("unknown")))
    return (
        F.when(known.isin(*fixed.LABELS_SCAM), "scam")
        .when(known.isin(*fixed.LABELS_LEGITIMATE), "legitimate")
        .when(known == "spam", "spam").otherwise("unknown")
    )


def derived_campaign(message: Column) -> Column:
    """Campaign id for rows that carry none: the linked hosts, or else the whole text without blanks."""
    hosts = F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all(message, F.lit(pii.URL), F.lit(0)),
        lambda u: F.coalesce(ur.host(F.when(u.contains("://"), u)), F.lit("")))))
    squeezed = F.regexp_replace(F.lower(message), r"(?U)\s+", "")
    basis = F.coalesce(F.nullif(F.array_join(hosts, "|"), F.lit("")), squeezed)
    return F.concat(F.lit("derived-"), F.substring(F.sha2(basis, 256), 1, 16))


def group_split(campaign: Column, buckets: int = 5) -> Column:
    """All rows of one campaign fall on the same side; about one campaign in five validates."""
    bucket = F.pmod(F.conv(F.substring(F.sha2(campaign, 256), 1, 8), 16, 10).cast("long"),
                    F.lit(buckets))
    return F.when(bucket == 0, "validation").otherwise("tuning")


def import_cases(rows: DataFrame, profile: str, source: str, *, row_number: str | None = None,
                 validation_after: date | None = None) -> DataFrame:
    """Raw corpus rows to evaluation cases: redaction, labels, campaign and split. With a time cut,
    campaigns found on both sides of it are left out entirely.

    ``row_number`` names a column with the row's place in its file; it only makes ids unique.
    """
    names = PROFILES[profile]
    only = profile in PHISHING_ONLY
    place = F.col(row_number).cast("string") if row_number else F.lit("")
    picked = rows.select(
        place.alias("_row"), pin(F.trim(pii.redact(pick(rows, names["text"])))).alias("message"),
        normal_label(pick(rows, names["label"]), only).alias("label"),
        loose_date(pick(rows, names["timestamp"])).alias("observed_at"),
        pick(rows, names["campaign"]).alias("_campaign"),
        F.coalesce(pick(rows, names["language"]), F.lit("und")).alias("language"),
        pick(rows, names["scam_type"]).alias("scam_type"), pick(rows, names["lure"]).alias("lure"),
    ).where("message <> ''")
    staged = picked.withColumn("campaign_id", F.coalesce("_campaign", derived_campaign(F.col("message"))))
    split = group_split(F.col("campaign_id"))
    if validation_after:
        split = F.when(F.col("observed_at").isNotNull(), F.when(
            F.col("observed_at") >= F.lit(validation_after), "validation").otherwise("tuning")
        ).otherwise(split)
    digest = F.substring(F.sha2(F.concat_ws("|", F.lit(source), "_row", "message"), 256), 1, 16)
    cases = staged.select(
        F.concat(F.lit(f"{source}-"), digest).alias("id"), "label", "message",
        F.lit(None).cast("string").alias("sender"),
        F.when(F.col("label") == "scam", S.LEVEL_SCAM).otherwise(S.LEVEL_UNCERTAIN)
        .alias("expected_level"),
        F.array().cast("array<string>").alias("required_signals"), "language", "scam_type", "lure",
        "campaign_id", "observed_at", F.lit(source).alias("source"), split.alias("split"),
        F.lit(None).cast("string").alias("notes"))
    return quarantine_crossing(cases) if validation_after else cases


def quarantine_crossing(cases: DataFrame) -> DataFrame:
    """Without the campaigns that occur in more than one split."""
    crossing = cases.groupBy("campaign_id").agg(
        F.min("split").alias("_a"), F.max("split").alias("_b")).where("_a <> _b")
    return cases.join(crossing.select("campaign_id"), "campaign_id", "left_anti") \
        .select(*cases.columns)


def training_rows(raw: DataFrame, kind: str, order: str | None = None) -> DataFrame:
    """(text, label, digest) of an e-mail (subject, body, Label) or SMS (texto, etiqueta) corpus.
    Equal texts count once, the first row by ``order`` gives the label."""
    if kind == "email":
        missing = {"subject", "body", "Label"} - set(raw.columns)
        value = F.trim("Label")
        label = F.when(value == "1", "phishing").when(value == "0", "legitimate")
        text = F.concat_ws("\n", F.trim(F.nullif(F.col("subject"), F.lit(""))),
                           F.trim(F.nullif(F.col("body"), F.lit(""))))
    else:
        missing = {"texto", "etiqueta"} - set(raw.columns)
        value = F.lower(F.trim("etiqueta"))
        label = F.when(value == "spam", "spam").when(value == "ham", "legitimate")
        text = F.coalesce("texto", F.lit(""))
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    rows = raw.select(
        pin(F.trim(pii.model_text(text))).alias("text"), label.alias("label"),
        (F.col(order) if order else F.lit(0)).alias("_order")).where(
        "label is not null and text <> ''")
    return rows.groupBy(F.sha2(F.lower("text"), 256).alias("digest")).agg(
        F.min_by(F.struct("text", "label"), F.struct("_order", "text", "label")).alias("r")
    ).select("r.text", "r.label", "digest")


def unite(*corpora: DataFrame) -> DataFrame:
    first, *rest = corpora
    for more in rest:
        first = first.unionByName(more)
    return first


# --- evaluation -------------------------------------------------------------------------------

def evaluate(cases: DataFrame, scored: DataFrame) -> DataFrame:
    """Case results: ``cases`` with id, ``scored(message_id = id, level, score, hard_rule, signals)``."""
    active = F.array_sort(F.array_distinct(F.transform(
        F.filter("signals", lambda s: s["status"] == S.HIT), lambda s: s["check_name"])))
    facts = scored.select(F.col("message_id").alias("id"), F.col("level").alias("predicted_level"),
                          "score", "hard_rule", active.alias("active_signals"))
    return cases.join(facts, "id").withColumn(
        "missing_required_signals",
        F.array_sort(F.array_except("required_signals", "active_signals")))


def _counts() -> dict[str, Column]:
    scam = F.col("label") == "scam"
    flagged = F.col("predicted_level") == S.LEVEL_SCAM
    return {
        "total": F.count("*"), "scam_total": F.count_if(scam),
        "non_scam_total": F.count_if(~scam), "true_positives": F.count_if(scam & flagged),
        "false_alarms": F.count_if(~scam & flagged),
        "exact_matches": F.count_if(F.col("predicted_level") == F.col("expected_level")),
    }


def gate_metrics(results: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row: counts, rates (0 when empty) and, with thresholds, whether each gate holds."""
    counts = results.agg(*[c.alias(n) for n, c in _counts().items()])
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    exact = counts.withColumns({
        "_r": rate("true_positives", "scam_total"), "_f": rate("false_alarms", "non_scam_total"),
        "_e": rate("exact_matches", "total")})
    if thresholds:
        exact = exact.withColumn("passed", (F.col("_r") >= thresholds["min_scam_recall"])
                                 & (F.col("_f") <= thresholds["max_false_alarm_rate"])
                                 & (F.col("_e") >= thresholds["min_exact_agreement"]))
    return exact.withColumns({
        "scam_recall": F.bround("_r", 4), "false_alarm_rate": F.bround("_f", 4),
        "exact_agreement": F.bround("_e", 4)}).drop("_r", "_f", "_e")


def slice_metrics(results: DataFrame,
                  dimensions: tuple[str, ...] = ("language", "scam_type", "lure", "split")) -> DataFrame:
    """Rates per value of each dimension, in one pass (grouping sets); null values are skipped and
    a rate without cases is null."""
    long = results.select(
        "label", "predicted_level", "expected_level",
        F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"),
                                     F.col(d).cast("string").alias("value"))
                            for d in dimensions])).alias("d")).where("d.value is not null")
    counts = long.groupBy("d.dimension", "d.value").agg(*[c.alias(n) for n, c in _counts().items()])
    rate = lambda a, b: F.bround(F.try_divide(F.col(a), F.col(b)), 4)
    return counts.select(
        "dimension", "value", "total", rate("true_positives", "scam_total").alias("scam_recall"),
        rate("false_alarms", "non_scam_total").alias("false_alarm_rate"),
        rate("exact_matches", "total").alias("exact_agreement"))


def missing_signals(results: DataFrame) -> DataFrame:
    return results.where(F.size("missing_required_signals") > 0).select(
        "id", "missing_required_signals")


def leakage(cases: DataFrame) -> DataFrame:
    """One row: campaigns and texts found in more than one split, and whether tuning dates reach
    past the first validation date."""
    def crossing(key: Column, name: str) -> DataFrame:
        spread = cases.select(key.alias("k"), "split").where("k is not null").groupBy("k").agg(
            F.min("split").alias("a"), F.max("split").alias("b"))
        return spread.agg(F.count_if(F.col("a") != F.col("b")).alias(name))

    bare = F.regexp_replace(F.lower("message"), r"(?U)\W+", "")
    tuning = F.max(F.when(F.col("split") == "tuning", F.col("observed_at")))
    validation = F.min(F.when(F.col("split") == "validation", F.col("observed_at")))
    cut = cases.agg(F.coalesce(tuning > validation, F.lit(False)).alias("time_cut_broken"))
    parts = crossing(F.col("campaign_id"), "leaked_campaigns").unionByName(
        crossing(F.sha2(bare, 256), "leaked_messages"), allowMissingColumns=True).unionByName(
        cut, allowMissingColumns=True)
    return parts.agg(F.max("leaked_campaigns").alias("leaked_campaigns"),
                     F.max("leaked_messages").alias("leaked_messages"),
                     F.bool_or("time_cut_broken").alias("time_cut_broken"))


def _quality(tp: Column, fn: Column, fp: Column, tn: Column) -> dict[str, Column]:
    pct = lambda a, b: F.coalesce(F.try_divide(a * F.lit(100.0), b), F.lit(0.0))
    precision, recall = pct(tp, tp + fp), pct(tp, tp + fn)
    return {
        "recall_pct": recall, "false_positive_pct": pct(fp, fp + tn),
        "specificity_pct": pct(tn, fp + tn), "precision_pct": precision,
        "f1_pct": F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0)),
        "accuracy_pct": pct(tp + tn, tp + fn + fp + tn),
    }


def benchmark(results: DataFrame) -> DataFrame:
    """Both corpora against both verdicts, with rates in percent."""
    scam, flagged = F.col("label") == "scam", F.col("predicted_level") == S.LEVEL_SCAM
    counts = results.agg(
        F.count_if(scam & flagged).alias("tp"), F.count_if(scam & ~flagged).alias("fn"),
        F.count_if(~scam & flagged).alias("fp"), F.count_if(~scam & ~flagged).alias("tn"))
    return counts.withColumns({
        n: F.bround(c, 4) for n, c in _quality(
            F.col("tp"), F.col("fn"), F.col("fp"), F.col("tn")).items()})


def category_counts(results: DataFrame, category: str = "category") -> DataFrame:
    return results.groupBy("label", category).agg(
        F.count_if(F.col("predicted_level") == S.LEVEL_SCAM).alias("flagged"),
        F.count_if(F.col("predicted_level") != S.LEVEL_SCAM).alias("not_flagged"))


def threshold_sweep(results: DataFrame, thresholds: tuple[int, ...] = tuple(range(40, 85, 5))) -> DataFrame:
    """Quality at each score threshold; a hard rule always counts. Scores are integers up to 100, so
    they are counted first and only the counts meet the thresholds."""
    per_score = results.groupBy((F.col("label") == "scam").alias("scam"), "hard_rule", "score").agg(
        F.count("*").alias("n"))
    flagged = F.col("hard_rule") | (F.col("score") >= F.col("threshold"))
    at = per_score.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    counts = at.groupBy("threshold").agg(
        total(F.col("scam") & flagged).alias("tp"), total(F.col("scam") & ~flagged).alias("fn"),
        total(~F.col("scam") & flagged).alias("fp"), total(~F.col("scam") & ~flagged).alias("tn"))
    rates = _quality(F.col("tp"), F.col("fn"), F.col("fp"), F.col("tn"))
    return counts.withColumns({n: F.bround(rates[n], 4) for n in (
        "recall_pct", "false_positive_pct", "precision_pct", "f1_pct")})


def top_signals(evidence: DataFrame, limit: int = 10) -> DataFrame:
    """Most frequent scoring checks (a top-k report)."""
    return evidence.where((F.col("status") == S.HIT) & (F.col("weight") > 0)) \
        .groupBy("check_name").agg(F.count("*").alias("hits"),
                                   F.count_if("hard_rule").alias("hard_hits")) \
        .orderBy(F.desc("hits"), "check_name").limit(limit)


def verdict_counters(scored: DataFrame) -> DataFrame:
    """Analyses by verdict and message type, with their summed duration when known."""
    spent = F.sum("duration_ms") if "duration_ms" in scored.columns else F.lit(None).cast("long")
    return scored.groupBy("level", "message_type").agg(
        F.count("*").alias("analyses"), spent.alias("duration_ms"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.countDistinct
    return df.agg(*[count(c).alias(c) for c in columns])
