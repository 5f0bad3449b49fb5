"""Certificate-log monitoring: names that imitate a brand, their risk and how early they were seen."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigia import fixed, schemas as S
from vigia.dims import Brand, brands_df, default_brands
from vigia.functions import text as tx, urls as ur
from vigia.operators import lookalike
from vigia.operators.extract import iso_timestamp
from vigia.session import stage_table

CONNECTOR_VERSION = "1.0.0"


def monitored(brands: tuple[Brand, ...] | None = None,
              names: tuple[str, ...] = fixed.MONITORED_BRANDS) -> tuple[Brand, ...]:
    by_name = {b.name: b for b in brands or default_brands()}
    return tuple(by_name[n] for n in names if n in by_name)


def certificate_names(rows: DataFrame) -> DataFrame:
    """One row per host name of a certificate, with its registrable domain."""
    names = rows.withColumn("_name", F.explode(F.split("name_value", "\n"))) \
        .withColumn("_name", F.trim("_name")).where(ur.valid_hostname(F.col("_name")))
    host = F.rtrim(F.lower(F.ltrim(F.col("_name"), F.lit("*."))), F.lit("."))
    named = names.withColumn("_ids", ur.idna_hosts(F.array(host)))
    return named.withColumns({
        "domain": ur.registrable(F.col("_ids")[0]["ascii"]),
        "shown_domain": ur.registrable(F.col("_ids")[0]["shown"]),
    }).drop("_ids", "_name").where("domain is not null")


def recent_identities(identities: DataFrame, certificates: DataFrame, issuers: DataFrame,
                      tokens: tuple[str, ...], now: datetime, days: int = 30) -> DataFrame:
    """Certificate rows of the last days whose DNS name contains a token: three tables joined.

    ``identities(certificate_id, name_type, name_value)``, ``certificates(id, issuer_ca_id,
    not_before, not_after)``, ``issuers(id, name)``. The time filter reaches the scan."""
    cutoff = F.lit(now) - F.expr(f"interval {days} days")
    named = identities.where("name_type = 'dNSName'").where(
        F.lower("name_value").rlike("|".join(tokens)))
    recent = certificates.where(F.col("not_before") > cutoff)
    return named.join(recent, named["certificate_id"] == recent["id"]).join(
        issuers.select(F.col("id").alias("issuer_ca_id"), F.col("name").alias("issuer_name")),
        "issuer_ca_id").select(
        F.col("certificate_id").cast("string").alias("id"), "name_value", "issuer_name",
        F.col("not_before").cast("string").alias("not_before"),
        F.col("not_after").cast("string").alias("not_after"),
        F.col("not_before").cast("string").alias("entry_timestamp"))


def _automated(issuer: Column) -> Column:
    name = F.lower(F.coalesce(issuer, F.lit("")))
    test = F.lit(False)
    for known in fixed.AUTOMATED_ISSUERS:
        test = test | name.contains(known)
    return test


def risk_score(domain: Column, issuer: Column, entry_at: Column, now: datetime,
               refers: Column) -> Column:
    """0.20 base, automated issuer 0.30, brand name or lookalike 0.30, risky ending 0.15, at most
    72 hours old 0.05. Counted in hundredths, so sums are exact."""
    ending = F.lit(False)
    for tld in fixed.CERTIFICATE_RISKY_TLDS:
        ending = ending | domain.endswith(tld)
    hours = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(entry_at)) / F.lit(3.6e9)
    points = (
        F.lit(20) + F.when(_automated(issuer), 30).otherwise(0) + F.when(refers, 30).otherwise(0)
        + F.when(ending, 15).otherwise(0)
        + F.when(F.coalesce(hours.between(0, 72), F.lit(False)), 5).otherwise(0)
    )
    return F.least(F.lit(1.0), points / F.lit(100.0))


def _brand_table(spark: SparkSession, brands: tuple[Brand, ...] | DataFrame | None) -> DataFrame:
    """Brands given as a table, or as records; a table may have any size."""
    return brands if isinstance(brands, DataFrame) else brands_df(spark, brands or monitored())


def lookalikes(certificates: DataFrame, now: datetime, *, brands: tuple[Brand, ...] | DataFrame | None = None,
               phish: DataFrame | None = None, min_confidence: float = S.CT_MIN_CONFIDENCE,
               typo: float = S.TYPO_SIMILARITY, position: str = "position") -> DataFrame:
    """Observations from certificate rows (and matched verified-phish rows), one per domain.

    ``certificates`` carries ``position``, the order in which rows count. ``brands`` may be a table of any size
    (columns as ``brands_df``); names meet brands through the indexes of ``lookalike``. Each domain keeps its first
    accepted brand by (brand order, row order), a map-side combined minimum."""
    rows = certificate_names(certificates).withColumns({
        "origin": F.lit("crtsh"), "target_brand": F.lit(None).cast("string")})
    if phish is not None:
        rows = rows.unionByName(phish, allowMissingColumns=True)
    # read by the indexes and by both joins
    rows = stage_table(rows.withColumn("entry_at", iso_timestamp(F.col("entry_timestamp"))), "names")
    table = _brand_table(certificates.sparkSession, brands).select(
        "brand_order", "entity", "tokens", "official_domains", "official_labels")
    refers = stage_table(lookalike.named_brands(rows, table, typo), "refers")
    about = table.select("brand_order", "entity", "official_domains")
    feed = F.col("origin") == "phishtank"
    seen = rows.where(~feed & _automated(F.col("issuer_name"))).join(refers, ["domain", "shown_domain"]) \
        .join(about, "brand_order").withColumn("refers", F.lit(True))
    told = rows.where(feed).join(about, F.col("target_brand") == F.col("entity")).join(
        refers.withColumn("refers", F.lit(True)), ["domain", "shown_domain", "brand_order"], "left") \
        .withColumn("refers", F.coalesce("refers", F.lit(False)))
    pairs = seen.unionByName(told).where(~lookalike.own_domain()).withColumn("b", F.struct("brand_order", "entity", "refers"))
    scored = pairs.withColumn("_risk", risk_score(
        F.col("domain"), F.col("issuer_name"), F.col("entry_at"), now, F.col("b.refers")))
    scored = scored.withColumn("confidence", F.when(
        feed, F.greatest("_risk", F.lit(0.80))).otherwise(F.col("_risk")))
    first = scored.where(F.col("confidence") >= min_confidence).groupBy("domain").agg(F.min_by(
        F.struct("b.entity", "origin", "issuer_name", "common_name", "not_before", "not_after", "id",
                 "entry_at", "confidence"),
        F.struct(F.col("b.brand_order"), feed, F.col(position), F.col("id"))).alias("o"))
    return first.select(
        F.lit(fixed.CERTIFICATE_PROVIDER).alias("provider"), F.lit("domain").alias("indicator_type"),
        F.col("domain").alias("value"), F.lit("active").alias("status"), "o.confidence",
        F.col("o.entry_at").alias("first_seen"), F.col("o.entry_at").alias("last_seen"),
        F.lit(now).alias("retrieved_at"), F.lit(None).cast("timestamp").alias("expires_at"),
        F.lit(CONNECTOR_VERSION).alias("version"),
        F.map_filter(F.create_map(
            F.lit("claimed_entity"), F.col("o.entity"), F.lit("source"), F.col("o.origin"),
            F.lit("issuer_name"), F.col("o.issuer_name"), F.lit("common_name"),
            F.col("o.common_name"), F.lit("not_before"), F.col("o.not_before"),
            F.lit("not_after"), F.col("o.not_after"), F.lit("ct_id"), F.col("o.id")),
            lambda _, v: v.isNotNull()).alias("provenance"),
        F.lit(False).alias("retryable"))


def match_phish(feed: DataFrame, brands: tuple[Brand, ...] | DataFrame | None = None,
                typo: float = S.TYPO_SIMILARITY) -> DataFrame:
    """Verified-phish rows ``(phish_id, url, host, target, submission_time, detail_url)`` that name
    a monitored brand in their host or target: certificate-shaped rows, one per row and brand."""
    table = _brand_table(feed.sparkSession, brands).select(
        "brand_order", "entity", "tokens", "official_domains", "official_labels")
    named = feed.withColumns({
        "_ids": ur.idna_hosts(F.array("host")), "_host": tx.token(F.col("host")),
        "_target": tx.token(F.coalesce("target", F.lit("")))})
    named = named.withColumns({
        "domain": ur.registrable(F.col("_ids")[0]["ascii"]),
        "shown_domain": ur.registrable(F.col("_ids")[0]["shown"])}).drop("_ids").where("domain is not null")
    named = stage_table(named, "phish")
    tokens = table.select("brand_order", F.explode("tokens").alias("token")).distinct()
    forms = named.select("domain", "shown_domain", "_host", "_target").distinct()
    texts = lambda c: forms.select(F.col(c).alias("text"))
    by_target = lookalike.containing(texts("_target"), tokens).unionByName(
        tokens.where(F.char_length("token") >= 3).select(F.col("token").alias("text"), "token").distinct()) \
        .join(tokens, "token").select(F.col("text").alias("_target"), "brand_order").distinct()
    by_host = lookalike.containing(texts("_host"), tokens).join(tokens, "token") \
        .select(F.col("text").alias("_host"), "brand_order").distinct()
    refers = lookalike.named_brands(named, table, typo)
    where = ["domain", "shown_domain", "_host", "_target", "brand_order"]
    meant = forms.join(by_target, "_target").select(*where).unionByName(
        forms.join(by_host, "_host").join(refers, ["domain", "shown_domain", "brand_order"]).select(*where)).distinct()
    matched = named.join(meant, where[:-1]).join(table.select("brand_order", "entity", "official_domains"), "brand_order") \
        .where(~lookalike.own_domain()).withColumn("m", F.struct("entity"))
    return matched.select(
        F.concat_ws(":", F.lit("phishtank"), "phish_id", "domain").alias("id"),
        F.lit("PhishTank verified").alias("issuer_name"),
        F.col("submission_time").alias("entry_timestamp"),
        F.col("submission_time").alias("not_before"), F.col("url").alias("common_name"),
        "domain", "shown_domain", F.lit("phishtank").alias("origin"),
        F.col("m.entity").alias("target_brand"), F.col("phish_id").cast("long").alias("position"))


def audit_entries(observations: DataFrame, logged: DataFrame) -> DataFrame:
    """Log rows for domains that the day's log does not hold yet: ``logged(day, domain)``."""
    rows = observations.select(
        F.to_date("retrieved_at").alias("day"), F.col("value").alias("domain"),
        F.col("retrieved_at").alias("observed_at"), F.col("first_seen").alias("first_seen_cert"),
        F.try_element_at("provenance", F.lit("claimed_entity")).alias("claimed_entity"),
        F.try_element_at("provenance", F.lit("issuer_name")).alias("issuer"),
        F.try_element_at("provenance", F.lit("ct_id")).alias("ct_id"),
        F.col("confidence").alias("risk_score"), "status",
        F.lit(None).cast("struct<source:string,confirmed_at:timestamp,lead_time_days:double,"
                         "active_clone:boolean,evidence_hash:string>").alias("verification"))
    once = rows.groupBy("day", "domain").agg(F.min_by(
        F.struct(*[c for c in rows.columns if c not in ("day", "domain")]),
        F.struct("observed_at", "ct_id")).alias("r")).select("day", "domain", "r.*")
    return once.join(logged.select("day", "domain"), ["day", "domain"], "left_anti")


def run_log(records: DataFrame, run_key: str = "run_at") -> DataFrame:
    """One row per round: queried, ok, failed, sources and the per-brand results (one per monitored
    brand, so the collected array is as short as the brand list)."""
    return records.groupBy(run_key).agg(
        F.count("*").alias("entities_queried"), F.count_if("ok").alias("queries_ok"),
        F.count_if(~F.col("ok")).alias("queries_failed"),
        F.sort_array(F.collect_set("source")).alias("sources_used"),
        F.sort_array(F.collect_list(F.struct(
            "entity", "source", "ok", "certificates_seen", "attempts", "last_status", "error",
            "checked_at"))).alias("results"))


def supplement_sources(primary: DataFrame, feed_rows: DataFrame) -> DataFrame:
    """Per-brand run records after the verified feed was consulted as well:
    ``primary(entity, source, certificates_seen, ...)``, ``feed_rows(target_brand)``."""
    extra = feed_rows.groupBy(F.col("target_brand").alias("entity")).agg(
        F.count("*").alias("_extra"))
    untouched = F.col("source").contains("phishtank")
    return primary.join(extra, "entity", "left").withColumns({
        "source": F.when(untouched, F.col("source")).otherwise(
            F.concat(F.col("source"), F.lit("+phishtank"))),
        "certificates_seen": F.col("certificates_seen") + F.when(untouched, 0).otherwise(
            F.coalesce("_extra", F.lit(0))),
    }).drop("_extra")


# --- how early --------------------------------------------------------------------------------

def cross_reference(log: DataFrame, indicators: DataFrame) -> DataFrame:
    """Log rows with the first public listing of their domain and the head start over it."""
    public = indicators.where(F.col("provider") != fixed.CERTIFICATE_PROVIDER).where(
        "first_seen is not null").groupBy("value_hash").agg(
        F.min_by(F.struct("provider", "first_seen"), F.struct("first_seen", "provider")).alias("p"))
    joined = log.withColumn("value_hash", F.sha2("domain", 256)).join(public, "value_hash", "left")
    micros = F.unix_micros("p.first_seen") - F.unix_micros("observed_at")
    seconds = F.when(F.col("observed_at").isNotNull(), micros / F.lit(1e6))
    return joined.select(
        *[c for c in log.columns if c not in ("feed_provider",)],
        F.col("p.provider").alias("feed_provider"), F.col("p.first_seen").alias("feed_seen_at"),
        seconds.alias("lead_time_seconds"), F.bround(seconds / 86400, 2).alias("lead_time_days"))


def lead_over_messages(indicators: DataFrame, messages: DataFrame, on: str = "domain") -> DataFrame:
    """Seconds between the first sighting of a domain and each message that carries it."""
    first = indicators.groupBy(F.col("value_public").alias(on)).agg(
        F.min("first_seen").alias("first_seen"))
    return messages.join(first, on).withColumn("lead_seconds", (
        F.unix_micros("received_at") - F.unix_micros("first_seen")) / F.lit(1e6))


def lead_time_metrics(log: DataFrame) -> DataFrame:
    """One row of totals. The median is the upper middle value, found by counting distinct values
    (pre-aggregated), not by gathering all of them."""
    values = log.where("lead_time_days is not null").groupBy("lead_time_days").agg(
        F.count("*").alias("n"))
    # lead times have two decimals, so the distinct ones are few: one struct per value
    picked = values.agg(
        F.array_sort(F.collect_list(F.struct("lead_time_days", "n"))).alias("v"),
        F.sum("n").alias("total"))
    upper = F.aggregate(
        "v", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("hit")),
        lambda a, x: F.struct(
            (a["seen"] + x["n"]).alias("seen"),
            F.when(a["hit"].isNull() & (a["seen"] + x["n"] > F.floor(F.col("total") / 2)),
                   x["lead_time_days"]).otherwise(a["hit"]).alias("hit")),
        lambda a: a["hit"])
    median = picked.select(F.coalesce(F.bround(upper, 2), F.lit(0.0)).alias("median_days"))
    days = F.col("lead_time_days")
    totals = log.agg(
        F.count("*").alias("total_domains_monitored"),
        F.count_if(F.coalesce("active_clone", F.lit(False))).alias("active_clones_documented"),
        F.count("lead_time_days").alias("corroborated_phishing_domains"),
        F.coalesce(F.bround(F.avg(days), 2), F.lit(0.0)).alias("mean_days"),
        F.coalesce(F.min(days), F.lit(0.0)).alias("min_days"),
        F.coalesce(F.max(days), F.lit(0.0)).alias("max_days"),
        F.coalesce(F.bround(F.try_divide(F.count_if(days > 0), F.count(days)) * 100, 1), F.lit(0.0))
        .alias("advance_detection_rate_pct"))
    # two single rows side by side
    return totals.unionByName(median, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in (*totals.columns, "median_days")])


def lead_time_breakdown(log: DataFrame) -> DataFrame:
    """Domains per claimed brand and per issuer."""
    by = lambda dim, column, default: log.groupBy(
        F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default)).alias("value")).agg(
        F.count("*").alias("domains")).select(F.lit(dim).alias("dimension"), "value", "domains")
    return by("entity", "claimed_entity", "Desconocida").unionByName(by("issuer", "issuer", "Otro"))
