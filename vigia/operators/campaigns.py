"""Campaign correlation: shared artifacts, similar texts, roll-up."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigia import schemas as S
from vigia.functions import hashing, pii, text as tx, urls as ur
from vigia.operators.evidence import signal
from vigia.session import stage_table

MATCHABLE = ("domain", "redirect_domain", "url_path_template", "phone", "iban", "text_fingerprint")


@dataclass(frozen=True)
class ArtifactLimits:
    """How many artifacts one message may contribute; None means all of them."""

    urls: int | None = 20
    phones: int | None = 20
    ibans: int | None = 10
    total: int | None = 80


ALL_ARTIFACTS = ArtifactLimits(None, None, None, None)


def with_artifacts(linked: DataFrame, pepper: bytes, body: str = "body", *,
                   redirects: DataFrame | None = None, limits: ArtifactLimits = ALL_ARTIFACTS,
                   simhash: Column | None = None) -> DataFrame:
    """Adds ``artifacts``, the distinct artifacts of each message. Personal identifiers leave only as keyed hashes.

    All artifacts come out of the message's own row, so nothing is shuffled (``redirects(message_id,
    final_domain)`` needs one join). ``simhash``: the fingerprint, where it is known already."""
    def head(array: Column, count: int | None) -> Column:
        return F.slice(array, 1, count) if count else array

    def public(kind: str, value: Column, source: str) -> Column:
        return F.struct(F.lit(kind).alias("artifact_type"), F.sha2(value, 256).alias("value_hash"),
                        value.alias("value_public"), F.lit(source).alias("source"))

    def private(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("artifact_type"),
                        hashing.hmac_sha256(value, pepper).alias("value_hash"),
                        F.lit(None).cast("string").alias("value_public"),
                        F.lit("extraction").alias("source"))

    text = F.col(body)
    staged = linked.withColumns({
        "_links": head(F.col("links"), limits.urls),
        "_phones": F.filter(F.transform(
            head(F.array_compact(F.array_append(pii.phones(text), F.col("sender_number"))),
                 limits.phones),
            lambda p: F.regexp_replace(p, r"(?U)\D", "")), lambda p: p != ""),
        "_ibans": head(pii.valid_ibans(text), limits.ibans),
        "_simhash": simhash if simhash is not None else tx.pin(tx.simhash(pii.redact(text))),
    })
    if redirects is not None:
        moved = redirects.groupBy("message_id").agg(
            F.sort_array(F.collect_set(F.lower("final_domain"))).alias("_final"))
        staged = staged.join(moved, "message_id", "left")
    finals = F.coalesce(F.col("_final"), F.array().cast("array<string>")) if redirects is not None \
        else F.array().cast("array<string>")
    per_link = F.flatten(F.transform("_links", lambda l: F.array_compact(F.array(
        F.when(l["domain"].isNotNull(), public("domain", l["domain"], "extraction")),
        tx.let(ur.path_template(l["url"], l["domain"]), lambda t: F.when(
            t.isNotNull(), public("url_path_template", t, "extraction")))))))
    found = F.concat(
        per_link,
        F.transform(finals, lambda d: public("redirect_domain", d, "redirect")),
        F.transform("_phones", lambda p: private("phone", p)),
        F.transform("_ibans", lambda i: private("iban", i)),
        F.when(F.col("_simhash") != 0, F.array(public(
            "text_fingerprint", F.col("_simhash").cast("string"), "local_fingerprint")))
        .otherwise(F.array().cast("array<struct<artifact_type:string,value_hash:string,"
                                  "value_public:string,source:string>>")),
    )
    return staged.withColumn("artifacts", head(F.array_distinct(found), limits.total)) \
        .drop("_links", "_phones", "_ibans", "_simhash", "_final")


def build_artifacts(linked: DataFrame, pepper: bytes, body: str = "body", *,
                    redirects: DataFrame | None = None, carry: tuple[str, ...] = (),
                    limits: ArtifactLimits = ALL_ARTIFACTS) -> DataFrame:
    """One row per message and artifact (see ``with_artifacts``)."""
    return artifact_rows(with_artifacts(linked, pepper, body, redirects=redirects, limits=limits), *carry)


def artifact_rows(messages: DataFrame, *carry: str) -> DataFrame:
    return messages.select("message_id", *carry, F.explode_outer("artifacts").alias("a")) \
        .where("a is not null").select("message_id", *carry, "a.*")


def attach_campaign(artifacts: DataFrame, assignment: DataFrame, at: datetime) -> DataFrame:
    """Stored artifacts: ``assignment(message_id, campaign_id)`` fills the campaign."""
    return artifacts.join(assignment, "message_id", "left").select(
        "message_id", "campaign_id", "artifact_type", "value_hash", "value_public", "source",
        F.lit(at).alias("created_at"))


# --- shared artifacts --------------------------------------------------------------------------

#: A value that more campaigns hold is widespread: alone it leads from no message to its campaigns.
WIDESPREAD = 64
_ART = ["artifact_type", "value_hash"]


def _held_alike(held: DataFrame) -> DataFrame:
    """(artifact_type, value_hash, _n, _like) of each held value: ``_n`` campaigns hold it, and ``_like`` is the smallest
    value of its type that the very same campaigns hold. Sets are told apart by their size and 128 bits of hashes that
    add up in any order, so a value that millions of campaigns hold is never gathered."""
    members = held.groupBy(*_ART).agg(
        F.count("*").alias("_n"), F.bit_xor(F.xxhash64("campaign_id")).alias("_a"),
        F.bit_xor(F.xxhash64(F.lit("set"), "campaign_id")).alias("_b"))
    members = stage_table(members, "held_values")
    first = members.groupBy("artifact_type", "_n", "_a", "_b").agg(F.min("value_hash").alias("_like"))
    return members.join(first, ["artifact_type", "_n", "_a", "_b"]).select(*_ART, "_n", "_like")


def _signatures(wanted: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, sig) and (sig, artifact_type, value_hash, _n). Messages whose held artifacts lead to the same campaigns
    share a signature, so each such set is matched once, whatever the values themselves and the number of copies: a
    value is stood for by one that the same campaigns hold. ``_n``: campaigns that hold the value."""
    alike = _held_alike(held)
    known = wanted.select(key, *_ART).join(alike, _ART).select(
        key, F.struct("artifact_type", F.col("_like").alias("value_hash"), "_n").alias("_value"))
    sets = known.groupBy(key).agg(F.sort_array(F.collect_set("_value")).alias("_set")) \
        .withColumn("sig", F.sha2(F.to_json("_set"), 256))
    sets = stage_table(sets, "signatures")
    values = sets.groupBy("sig").agg(F.first("_set").alias("_set")).select("sig", F.explode("_set").alias("a")).select("sig", "a.*")
    return sets.select(key, "sig"), values


def _shared_by_signature(values: DataFrame, held: DataFrame, min_types: int, widespread: int) -> DataFrame:
    """(sig, campaign_id, artifact_types) of pairs that share at least ``min_types`` types.

    A pair shares a value that is not widespread, or all it shares is widespread. The first kind is found value by
    value, at most ``widespread`` campaigns each. The second kind shares, if two types are asked for, two widespread
    values: the few distinct pairs of such values that occur in messages are looked up among the campaigns from the
    rarer value's side, and what is found shares both, so it is part of the result and no mere candidate."""
    cold = values.where(F.col("_n") <= widespread).join(held, _ART).select("sig", "campaign_id")
    hot = values.where(F.col("_n") > widespread)
    if min_types < 2:
        pairs = cold.unionByName(hot.join(held, _ART).select("sig", "campaign_id")).distinct()
    else:
        sets = hot.groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("_n", *_ART))).alias("h")).where(F.size("h") > 1)
        both = sets.select("sig", F.explode(F.flatten(F.transform("h", lambda x, i: F.transform(
            F.filter(F.slice("h", i + 2, F.size("h")), lambda y: y["artifact_type"] != x["artifact_type"]),
            lambda y: F.struct(x["artifact_type"].alias("t1"), x["value_hash"].alias("v1"),
                               y["artifact_type"].alias("t2"), y["value_hash"].alias("v2")))))).alias("p")).select("sig", "p.*")
        asked = both.select("t1", "v1", "t2", "v2").distinct()
        hold = lambda n: held.select("campaign_id", F.col("artifact_type").alias(f"t{n}"), F.col("value_hash").alias(f"v{n}"))
        meet = asked.join(hold(1), ["t1", "v1"]).join(hold(2), ["campaign_id", "t2", "v2"])
        pairs = cold.unionByName(both.join(meet, ["t1", "v1", "t2", "v2"]).select("sig", "campaign_id")).distinct()
    shared = pairs.join(values.drop("_n"), "sig").join(held, ["campaign_id", *_ART]).groupBy("sig", "campaign_id").agg(
        F.sort_array(F.collect_set("artifact_type")).alias("artifact_types"))
    return shared.where(F.size("artifact_types") >= min_types)


def shared_campaigns(wanted: DataFrame, held: DataFrame, min_types: int = S.MIN_ARTIFACT_TYPES,
                     key: str = "message_id", widespread: int = WIDESPREAD) -> DataFrame:
    """(message_id, campaign_id, artifact_types) for pairs that share at least ``min_types``
    distinct artifact types. ``wanted(message_id, artifact_type, value_hash)``,
    ``held(campaign_id, artifact_type, value_hash)``. Null values match nothing."""
    held = held.select("campaign_id", *_ART).distinct()
    keys, values = _signatures(wanted, held, key)
    found = _shared_by_signature(values, held, max(1, min_types), widespread)
    return keys.join(found, "sig").select(key, "campaign_id", "artifact_types")


def match_artifacts(artifacts: DataFrame, stored: DataFrame, campaigns: DataFrame, now: datetime,
                    *, window_days: int = S.CAMPAIGN_WINDOW_DAYS, min_types: int = S.MIN_ARTIFACT_TYPES,
                    widespread: int = WIDESPREAD) -> DataFrame:
    """Best campaign per message by number of shared artifact types (smallest id on ties); kept
    only when that campaign is a scam."""
    cutoff = now - timedelta(days=max(1, window_days))
    held = stored.where(F.col("campaign_id").isNotNull() & (F.col("created_at") >= F.lit(cutoff)))
    held = held.select("campaign_id", *_ART).distinct()
    keys, values = _signatures(artifacts.where(F.col("artifact_type").isin(*MATCHABLE)), held, "message_id")
    pairs = _shared_by_signature(values, held, max(2, min_types), widespread)
    # the best campaign is the same for all messages of a signature: the pairs are never expanded to messages
    best = pairs.groupBy("sig").agg(F.max_by(
        F.struct("campaign_id", "artifact_types"),
        F.struct(F.size("artifact_types"), _descending("campaign_id"))).alias("b"))
    best = keys.join(best, "sig").select("message_id", "b.campaign_id", F.size("b.artifact_types").alias("match_count"),
                                         "b.artifact_types")
    return best.join(campaigns.where(F.col("verdict") == S.LEVEL_SCAM)
                     .select("campaign_id", "confirmed"), "campaign_id") \
        .select("message_id", "campaign_id", "match_count", "artifact_types", "confirmed")


def _descending(column: str) -> Column:
    """Ordering key under which the smallest text is the largest: inverted bytes, end mark last."""
    hexed = F.hex(F.encode(F.col(column), "UTF-8"))
    return F.concat(F.translate(hexed, "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))


def artifact_evidence(matches: DataFrame) -> DataFrame:
    hard = F.coalesce("confirmed", F.lit(False))
    row = signal(
        "known_campaign_artifacts", F.lit(True), weight=F.when(hard, 100).otherwise(60), hard=hard,
        severity=F.when(hard, S.CRITICAL).otherwise(S.WARNING), source="artifact_correlation",
        value=F.to_json(F.struct("campaign_id", "match_count", "artifact_types",
                                 hard.alias("confirmed"))),
        summary=F.when(hard, "Varios datos independientes coinciden con una campaña de estafa "
                             "confirmada.")
        .otherwise("Varios datos coinciden con una campaña aún pendiente de revisión."))
    return matches.select("message_id", F.lit(5000).alias("ordinal"), row.alias("signal"))


# --- similar texts -----------------------------------------------------------------------------

def match_texts(messages: DataFrame, campaigns: DataFrame, now: datetime, *,
                window_days: int = S.CAMPAIGN_WINDOW_DAYS, threshold: float = S.TEXT_SIMILARITY,
                bands: int = 4, newest: int | None = None) -> DataFrame:
    """Most similar recent scam campaign per message: ``messages(message_id, simhash)``.

    A campaign is a candidate when one of ``bands`` slices of the fingerprints agrees. Equal
    fingerprints are matched once, whatever number of messages carries them. The join key is a
    slice together with a piece of the remaining bits: fingerprints at most ``d`` bits apart agree
    on one of ``d + 1`` pieces, so a slice value that a third of all texts share is split into
    many small groups without losing a pair. ``newest`` restricts candidates to the latest
    campaigns that share a slice, as an interactive lookup would.
    """
    cutoff = now - timedelta(days=max(1, window_days))
    texts = messages.where("simhash <> 0").select("simhash").distinct()
    recent = campaigns.where(
        (F.col("verdict") == S.LEVEL_SCAM) & (F.col("last_seen") >= F.lit(cutoff))
    ).select("campaign_id", F.col("simhash").alias("c_simhash"), "last_seen", "confirmed")
    similar = tx.similarity(F.col("simhash"), F.col("c_simhash"))
    if newest is None:
        distance = int((1 - threshold) * 64 + 1e-9)
        pairs = texts.select("simhash", F.explode(band_keys(F.col("simhash"), bands, distance + 1))
                             .alias("k")).join(
            recent.select("*", F.explode(band_keys(F.col("c_simhash"), bands, distance + 1))
                          .alias("k")), "k")
        candidates = pairs.where(similar >= threshold)
    else:
        # reference behaviour: only the newest candidates are compared at all
        pairs = texts.select("simhash", F.explode(band_keys(F.col("simhash"), bands, 1)).alias("k")) \
            .join(recent.select("*", F.explode(band_keys(F.col("c_simhash"), bands, 1))
                                .alias("k")), "k") \
            .drop("k").distinct()
        rank = Window.partitionBy("simhash").orderBy(F.desc("last_seen"), "campaign_id")
        candidates = pairs.withColumn("_r", F.row_number().over(rank)).where(
            F.col("_r") <= newest).where(similar >= threshold)
    best = candidates.groupBy("simhash").agg(F.max_by(
        F.struct("campaign_id", similar.alias("similarity"), "confirmed"),
        F.struct(similar, "last_seen", _descending("campaign_id"))).alias("b"))
    return messages.select("message_id", "simhash").join(best, "simhash").select(
        "message_id", "b.campaign_id", F.bround("b.similarity", 3).alias("similarity"),
        F.coalesce("b.confirmed", F.lit(False)).alias("confirmed"))


def band_keys(fingerprint: Column, bands: int, pieces: int) -> Column:
    """Join keys: every slice with every one of ``pieces`` cuts of the other bits."""
    width = 64 // bands
    keys = []
    for band in range(bands):
        inside = range(band * width, (band + 1) * width)
        value = F.shiftrightunsigned(fingerprint, band * width).bitwiseAND(F.lit((1 << width) - 1))
        rest = [bit for bit in range(64) if bit not in inside]
        size = -(-len(rest) // pieces)
        for piece in range(pieces):
            mask = 0
            if pieces > 1:
                for bit in rest[piece * size:(piece + 1) * size]:
                    mask |= 1 << bit
            signed = mask - (1 << 64) if mask >= 1 << 63 else mask
            keys.append(F.struct(
                F.lit(band * pieces + piece).alias("slot"), value.alias("slice"),
                fingerprint.bitwiseAND(F.lit(signed).cast("long")).alias("rest")))
    return F.array(*keys)


def text_evidence(matches: DataFrame) -> DataFrame:
    hard = F.coalesce("confirmed", F.lit(False))
    row = signal(
        "similar_campaign_text", F.lit(True), weight=F.when(hard, 100).otherwise(55), hard=hard,
        severity=F.when(hard, S.CRITICAL).otherwise(S.WARNING), source="campaign_store",
        value=F.to_json(F.struct("campaign_id", "similarity", hard.alias("confirmed"))),
        summary=F.when(hard, "El texto coincide con una campaña de estafa confirmada.")
        .otherwise("El texto se parece a una campaña pendiente de revisión."))
    return matches.select("message_id", F.lit(5001).alias("ordinal"), row.alias("signal"))


# --- roll-up -----------------------------------------------------------------------------------

def independent_hard_hit(signals: str = "signals") -> Column:
    """A hard hit that does not itself come from campaign matching."""
    return F.exists(signals, lambda s: (s["status"] == S.HIT) & s["hard_rule"] & ~s[
        "check_name"].isin("known_campaign_artifacts", "similar_campaign_text"))


def record_campaigns(scored: DataFrame, campaigns: DataFrame, hints: DataFrame) -> DataFrame:
    """New state of the campaign table after a batch.

    ``scored(message_id, received_at, level, simhash, claimed_entity, seed)`` where ``seed`` is an
    independent hard hit, ``hints(message_id, campaign_id, by_artifacts)`` from earlier campaigns.
    A hinted scam joins its campaign; the others fall to the campaign of equal fingerprint, new or
    stored. Counting happens before the merge, so a campaign with most of the messages is one row
    per map task.
    """
    scams = scored.where((F.col("level") == S.LEVEL_SCAM) & (F.col("simhash") != 0)) \
        .join(hints, "message_id", "left")
    own = campaigns.groupBy("simhash").agg(F.min("campaign_id").alias("_own"))
    placed = scams.join(own, "simhash", "left").withColumn(
        "campaign_id", F.coalesce("campaign_id", "_own", campaign_id(F.col("simhash"))))
    batch = placed.groupBy("campaign_id").agg(
        F.count("*").alias("n_hits"), F.min("received_at").alias("n_first"),
        F.max("received_at").alias("n_last"), F.bool_or("seed").alias("n_seed"),
        F.bool_or(F.coalesce("by_artifacts", F.lit(False))).alias("n_art"),
        F.min_by(F.struct("simhash", F.col("claimed_entity").alias("entity")),
                 F.struct("received_at", "message_id")).alias("n_origin"))
    both = campaigns.join(batch, "campaign_id", "full")
    stored = F.col("verdict").isNotNull()
    return both.select(
        "campaign_id", F.coalesce("simhash", "n_origin.simhash").alias("simhash"),
        F.coalesce("first_seen", "n_first").alias("first_seen"),
        F.greatest("last_seen", "n_last").alias("last_seen"),
        (F.coalesce("hits", F.lit(0)) + F.coalesce("n_hits", F.lit(0))).alias("hits"),
        F.when(stored, F.col("entity")).otherwise(F.col("n_origin.entity")).alias("entity"),
        F.coalesce("verdict", F.lit(S.LEVEL_SCAM)).alias("verdict"),
        (F.coalesce("confirmed", F.lit(False)) | F.coalesce("n_seed", F.lit(False)))
        .alias("confirmed"),
        F.when(F.col("n_art"), "artifacts").otherwise(
            F.coalesce("cluster_method", F.lit("simhash"))).alias("cluster_method"))


def campaign_id(fingerprint: Column) -> Column:
    """Deterministic id of the campaign that a fingerprint founds."""
    return F.concat(F.lit("c-"), F.substring(F.sha2(fingerprint.cast("string"), 256), 1, 16))
