"""Facts read from a message: projections over a message table, no shuffle.

Every operator takes a table and returns it with columns added. The detection view is computed once
per message and every pattern reads it.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from vigia import fixed, schemas as S
from vigia.dims import Brand, alias_forms, brands_df, default_brands, strings
from vigia.functions import hashing, pii, text as tx, urls as ur


def normalise_text(df: DataFrame, column: str) -> DataFrame:
    """Adds ``detection`` and ``obfuscations``."""
    return df.withColumns({
        "detection": tx.pin(tx.detection_view(F.col(column))),
        "obfuscations": tx.obfuscations(F.col(column)),
    })


def redact(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: pii.redact(F.col(c)) for c in columns})


def model_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("model_text", pii.model_text(F.col(column)))


def personal_data(df: DataFrame, column: str) -> DataFrame:
    """Adds ``personal_data``, the kinds of identifiers present."""
    return df.withColumn("personal_data", pii.sensitive_types(F.col(column)))


def pii_inventory(df: DataFrame, column: str, by: str = "lang") -> DataFrame:
    """Messages per kind of personal data and language."""
    return (
        df.select(by, F.explode_outer(pii.sensitive_types(F.col(column))).alias("kind"))
        .where("kind is not null").groupBy("kind", by).agg(F.count("*").alias("messages"))
    )


def fingerprint(df: DataFrame, column: str, bands: int = 4) -> DataFrame:
    """Adds ``simhash`` and ``bands``."""
    return df.withColumn("simhash", tx.pin(tx.simhash(F.col(column)))) \
        .withColumn("bands", tx.bands(F.col("simhash"), bands))


def requested_action(detection: Column) -> Column:
    """First action whose wording is present, in order of priority. A request for a code that the
    text itself warns against ("no compartas") does not count."""
    ladder = None
    for action, pattern in fixed.ACTIONS:
        present = tx.says(detection, pattern, "(?U)")
        if action == S.ACTION_CODE:
            pattern = tx.quick(pattern, "(?U)")
            before = F.regexp_extract(detection, rf"(?s)^(.*?)(?:{pattern})", 1)

            def unwarned(near: Column) -> Column:
                return ~reduce(or_, (near.contains(negation) for negation in fixed.NEGATIONS))

            # a branch, not "and": what several tests behind an "and" share would be worked out for every message
            present = F.when(present, tx.let(F.right(before, F.lit(15)), unwarned)).otherwise(F.lit(False))
        ladder = F.when(present, action) if ladder is None else ladder.when(present, action)
    return ladder.otherwise(S.ACTION_NONE)


def urgency_markers(detection: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(detection.contains(sought), shown) for shown, sought in fixed.URGENCY]))


def claimed_brand(detection: Column, brands: tuple[Brand, ...]) -> Column:
    """Position of the brand whose longest alias is present as a whole word (the first one on ties).

    One pass of a single alternation, longest alias first, tried at every word start; only the character before an
    alias is consumed, which keeps overlapping aliases apart.
    """
    forms = alias_forms(brands)
    letters = "".join(sorted({alias[0] for alias, _ in forms}))
    pattern = rf"[^{tx.WORD}](?=[{letters}])(?U)(?<!\w)(?=(" + tx.literal_branches(
        [alias for alias, _ in forms], _java_quote) + r")(?!\w))"
    aliases = strings(alias for alias, _ in forms)
    owners = F.from_json(F.lit(json.dumps([i for _, i in forms])), "array<int>")
    found = F.regexp_extract_all(F.concat(F.lit(" "), detection), F.lit(pattern), F.lit(1))
    ranked = F.transform(found, lambda a: F.struct(
        F.char_length(a).alias("size"),
        (-F.element_at(owners, F.array_position(aliases, a).cast("int"))).alias("rank")))
    return -F.array_max(ranked)["rank"]


def _java_quote(literal: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", literal)


def extract_facts(
    df: DataFrame, body: str = "body", sender: str = "sender",
    brands: tuple[Brand, ...] | None = None,
) -> DataFrame:
    """Adds detection, urls, requested_action, urgency_markers, sender_number, sender_alias,
    brand (struct) and claimed_entity."""
    who = F.nullif(F.col(sender), F.lit(""))
    is_number = F.replace(who, F.lit(" "), F.lit("")).rlike(r"\d{6,}")
    return (
        df.withColumn("detection", tx.pin(tx.detection_view(F.col(body))))
        .withColumns({
            "urls": ur.extract_urls(F.col(body)),
            "requested_action": requested_action(F.col("detection")),
            "urgency_markers": urgency_markers(F.col("detection")),
            "sender_number": F.when(is_number, who),
            "sender_alias": F.when(~is_number, who),
            "brand_order": claimed_brand(F.col("detection"), brands or default_brands()),
            "qr_payload_types": F.array().cast("array<string>"),
        })
        # the brand table is checked to be small when it is loaded
        .join(F.broadcast(brand_rows(df.sparkSession, brands)), "brand_order", "left")
        .withColumn("claimed_entity", F.col("brand.entity")).drop("brand_order")
    )


def brand_rows(spark, brands: tuple[Brand, ...] | None = None) -> DataFrame:
    """(brand_order, brand): what the checks on a claimed brand need."""
    return brands_df(spark, brands).select("brand_order", F.struct(
        "entity", "category", "tokens", "official_domains", "official_labels").alias("brand"))


def merge_extractions(base: DataFrame, extra: DataFrame, key: str = "message_id") -> DataFrame:
    """Facts from a second extractor complete the first: its scalars win when present, arrays are
    united with the base rows first."""
    def pick(name: str) -> Column:
        better = F.col(f"x.{name}")
        if name == "requested_action":
            better = F.when(better != S.ACTION_NONE, better)
        elif name == "body":
            better = F.nullif(better, F.lit(""))
        return F.coalesce(better, F.col(f"b.{name}")).alias(name)

    scalars = [n for n in ("body", "sender_alias", "sender_number", "claimed_entity",
                           "requested_action") if n in base.columns and n in extra.columns]
    arrays = [n for n in ("urls", "urgency_markers") if n in extra.columns]
    kept = [F.col(f"b.{n}") for n in base.columns if n not in scalars + arrays]
    empty = F.array().cast("array<string>")
    united = [F.array_union(F.coalesce(F.col(f"b.{n}"), empty),
                            F.coalesce(F.col(f"x.{n}"), empty)).alias(n) for n in arrays]
    return base.alias("b").join(extra.alias("x"), key, "left").select(
        *[c for c in kept], *[pick(n) for n in scalars], *united)


# --- QR payloads ----------------------------------------------------------------------------

def qr_kind(payload: Column) -> Column:
    value = F.lower(F.trim(payload))

    def starts(*prefixes: str) -> Column:
        test = F.lit(False)
        for prefix in prefixes:
            test = test | value.startswith(prefix)
        return test

    return (
        F.when(starts("http://", "https://"), "url")
        .when(starts("bcd\n", "bitcoin:", "lightning:", "ethereum:", "upi:"), "payment")
        .when(starts("wifi:"), "wifi").when(starts("tel:"), "phone").otherwise("text")
    )


def merge_qr(facts: DataFrame, payloads: DataFrame, key: str = "message_id") -> DataFrame:
    """``payloads(message_id, position, payload)``: adds their links and kinds; a payment or a link
    supplies the action when the text asked for none."""
    read = payloads.select(
        key, "position", qr_kind(F.col("payload")).alias("kind"),
        ur.extract_urls(F.col("payload")).alias("links"))
    grouped = read.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("position", "kind", "links"))).alias("_qr"))
    joined = facts.join(grouped, key, "left")
    empty = F.array().cast("array<string>")
    kinds = F.coalesce(F.array_distinct(F.transform("_qr", lambda q: q["kind"])), empty)
    links = F.coalesce(F.flatten(F.transform("_qr", lambda q: q["links"])), empty)
    return joined.withColumns({
        "urls": F.array_union("urls", links),
        "requested_action": F.when(F.col("requested_action") != S.ACTION_NONE,
                                   F.col("requested_action"))
        .when(F.array_contains(kinds, "payment"), S.ACTION_TRANSFER)
        .when(F.array_contains(kinds, "url"), S.ACTION_CLICK).otherwise(S.ACTION_NONE),
        "qr_payload_types": F.array_union("qr_payload_types", kinds),
    }).drop("_qr")


# --- message type ----------------------------------------------------------------------------

def classify(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds message_type, message_type_confidence, message_type_reasons. A description of intent,
    never part of the verdict."""
    raw = F.coalesce(F.col(body), F.lit(""))
    tones = F.array_compact(F.array(*[
        F.when(tx.says(raw, pattern, "(?iU)"), label) for label, pattern in fixed.COMMERCIAL]))
    # most messages have no such word at all: one pass tells
    words = "|".join(pattern.removeprefix(r"\b(?:").removesuffix(r")\b") for _, pattern in fixed.COMMERCIAL)
    tones = F.when(tx.says(raw, rf"\b(?:{words})\b", "(?iU)"), tones).otherwise(F.array().cast("array<string>"))
    staged = df.withColumn("_tones", tx.pin(tones))
    sensitive = F.col("requested_action").isin(
        S.ACTION_CODE, S.ACTION_CREDENTIALS, S.ACTION_TRANSFER, S.ACTION_INSTALL)
    has_urls = F.size("urls") > 0
    hurried = F.size("urgency_markers") > 0
    brand_link = F.col("claimed_entity").isNotNull() & has_urls
    spam = (F.size("_tones") > 0) & ~sensitive & ~brand_link
    suspicious = sensitive | hurried | brand_link
    transactional = tx.says(raw, fixed.TRANSACTIONAL, "(?iU)")
    delivery = tx.says(raw, fixed.DELIVERY, "(?iU)")
    personal = tx.says(raw, fixed.PERSONAL, "(?iU)") & ~has_urls
    kind = (
        F.when(spam, S.TYPE_SPAM).when(suspicious, S.TYPE_PHISHING)
        .when(transactional, S.TYPE_TRANSACTIONAL).when(personal, S.TYPE_PERSONAL)
        .otherwise(S.TYPE_UNKNOWN)
    )
    staged = staged.withColumn("message_type", tx.pin(kind))
    is_kind = lambda value: F.col("message_type") == value
    confidence = (
        F.when(is_kind(S.TYPE_SPAM), F.least(F.lit(0.94), F.lit(0.62) + F.lit(0.10) * F.size("_tones")))
        .when(is_kind(S.TYPE_PHISHING), F.when(sensitive, 0.88).otherwise(0.72))
        .when(is_kind(S.TYPE_TRANSACTIONAL), 0.68).when(is_kind(S.TYPE_PERSONAL), 0.62)
        .otherwise(0.25)
    )
    reasons = (
        F.when(is_kind(S.TYPE_SPAM), F.transform(
            F.slice("_tones", 1, 3), lambda t: F.concat(F.lit("tono comercial: "), t)))
        .when(is_kind(S.TYPE_PHISHING), F.array_compact(F.array(
            F.when(sensitive, "incluye una petición de datos, dinero o acceso"),
            F.when(has_urls, "contiene un enlace que debe verificarse"),
            F.when(hurried, "usa lenguaje de urgencia"))))
        .when(is_kind(S.TYPE_TRANSACTIONAL), F.array(
            F.when(delivery, "menciona un envío, paquete o punto de recogida")
            .otherwise("menciona una cita, pedido o gestión esperable")))
        .when(is_kind(S.TYPE_PERSONAL), F.array(F.lit("parece una conversación personal")))
        .otherwise(F.array(F.lit(
            "no hay suficientes rasgos lingüísticos para identificar el tipo de mensaje")))
    )
    return staged.withColumns({
        "message_type_confidence": confidence, "message_type_reasons": reasons,
    }).drop("_tones")


# --- links ------------------------------------------------------------------------------------

def link_structs(df: DataFrame, urls: str = "urls") -> DataFrame:
    """Adds ``links``: one struct per URL, in order (url, host, domain, shown_domain)."""
    with_hosts = df.withColumn(
        "_hosts", F.transform(urls, lambda u: F.coalesce(ur.host(u), F.lit(""))))
    with_names = with_hosts.withColumn("_names", ur.idna_hosts(F.col("_hosts")))

    def link(url: Column, index: Column) -> Column:
        host = F.nullif(F.get(F.col("_hosts"), index), F.lit(""))
        name = F.get(F.col("_names"), index)
        domain = F.when(host.isNotNull(), ur.registrable(name["ascii"]))
        shown = F.when(host.isNotNull(), ur.registrable(name["shown"]))
        return F.struct(url.alias("url"), host.alias("host"), domain.alias("domain"),
                        shown.alias("shown_domain"))

    return with_names.withColumn("links", tx.pin(F.transform(urls, link))).drop("_hosts", "_names")


def url_facts(df: DataFrame, key: str = "message_id") -> DataFrame:
    """One row per message and URL with everything a join or a rule may need."""
    rows = link_structs(df.select(key, "urls")).select(
        key, F.posexplode("links").alias("position", "link")).select(key, "position", "link.*")
    url, host, domain = F.col("url"), F.col("host"), F.col("domain")
    label = F.lower(ur.longest_label(host))
    return rows.withColumns({
        "canonical_url": ur.canonical_url(url),
        "path_template": ur.path_template(url, domain),
        "url_length": F.char_length(url),
        "label_count": F.size(F.split(host, r"\.")),
        "path_depth": F.size(F.filter(F.split(ur.path_of(url), "/"), lambda p: p != "")),
        "label_entropy": F.bround(ur.entropy(label), 3),
        "suffix_candidates": ur.suffix_candidates(domain),
    })


def match_brands(df: DataFrame, domain: str = "domain", claimed: str = "claimed_entity",
                 brands: tuple[Brand, ...] | None = None) -> DataFrame:
    """Adds the claimed brand's data: official flag, closest similarity, official contacts."""
    known = brand_rows(df.sparkSession, brands).withColumn("_token", F.explode("brand.tokens")) \
        .groupBy("_token").agg(F.min_by("brand", "brand_order").alias("_brand"))
    staged = df.withColumn("_token", tx.token(F.col(claimed))) \
        .join(F.broadcast(known), "_token", "left").drop("_token")
    official = F.exists(
        ur.suffix_candidates(F.col(domain)),
        lambda d: F.array_contains(F.col("_brand.official_domains"), d))
    closest = F.array_max(F.transform(
        "_brand.official_labels", lambda o: ur.label_similarity(F.col(domain), o)))
    return staged.withColumns({
        "entity": F.col("_brand.entity"), "category": F.col("_brand.category"),
        "is_official": official, "similarity": F.bround(closest, 3),
        "official_domains": F.col("_brand.official_domains"),
    }).drop("_brand")


def official_contacts(df: DataFrame, brands: tuple[Brand, ...] | None = None,
                      claimed: str = "claimed_entity") -> DataFrame:
    """Adds ``official_verification`` for the claimed brand when it publishes any contact."""
    contacts = brands_df(df.sparkSession, brands).select(
        F.explode("tokens").alias("_token"), "brand_order",
        F.struct(F.col("entity").alias("entity_name"), "official_numbers", "official_domains")
        .alias("official_verification"),
    ).groupBy("_token").agg(F.min_by("official_verification", "brand_order")
                            .alias("official_verification")) \
        .where((F.size("official_verification.official_numbers") > 0)
               | (F.size("official_verification.official_domains") > 0))
    # bounded by the brand table, which the loaders keep small
    return df.withColumn("_token", tx.token(F.col(claimed))).join(
        F.broadcast(contacts), "_token", "left").drop("_token")


# --- identities and generated text -----------------------------------------------------------

def pseudonymise(df: DataFrame, columns: list[str], pepper: bytes) -> DataFrame:
    return df.withColumns({c: hashing.hmac_sha256(F.col(c), pepper) for c in columns})


def parse_times(df: DataFrame, columns: list[str]) -> DataFrame:
    """ISO text to timestamps; null where it cannot be read."""
    return df.withColumns({c: iso_timestamp(F.col(c)) for c in columns})


def iso_timestamp(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), F.try_to_timestamp(value))


def loose_date(value: Column) -> Column:
    """Epoch seconds, ISO time, or a text that begins with an ISO date."""
    digits = value.rlike("^[0-9]+$")
    epoch = F.when(F.char_length(value) <= 11, F.to_date(F.timestamp_seconds(
        F.try_to_number(value, F.lit("99999999999")).cast("long"))))
    iso = F.to_date(iso_timestamp(value))
    head = F.when(F.substring(value, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"),
                  F.to_date(F.try_to_timestamp(F.substring(value, 1, 10))))
    return F.when(digits, epoch).otherwise(F.coalesce(iso, head))


def is_alphanumeric_sender(sender: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.trim(sender), r"(?U)[\d\s+\-().]", "") != "", F.lit(False))


def screen_generated_text(df: DataFrame, level: str = "level", headline: str = "headline",
                          summary: str = "summary", reasons: str = "reasons") -> DataFrame:
    """Keeps generated wording that does not reassure: per level, some phrases are forbidden."""
    words = F.lower(F.concat_ws(" ", F.col(headline), F.col(summary), F.col(reasons)))

    def says(phrases: tuple[str, ...]) -> Column:
        test = F.lit(False)
        for phrase in phrases:
            test = test | words.contains(phrase)
        return test

    forbidden = (
        F.when(F.col(level) == S.LEVEL_UNCERTAIN, says(fixed.FORBIDDEN_WHEN_UNCERTAIN))
        .when(F.col(level) == S.LEVEL_SCAM, says(fixed.FORBIDDEN_WHEN_SCAM)).otherwise(F.lit(False))
    )
    return df.where(~forbidden)
