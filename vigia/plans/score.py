"""Messages to verdicts in one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from vigia import schemas as S
from vigia.dims import Brand, SenderAlias
from vigia.functions import pii, text, urls
from vigia.operators import campaigns, evidence, extract, intel, scoring
from vigia.session import stage_table


@dataclass(frozen=True)
class ScoreOptions:
    brands: tuple[Brand, ...] | None = None
    aliases: tuple[SenderAlias, ...] | None = None
    probability: str | None = None
    ml_threshold: float = S.ML_THRESHOLD
    typo: float = S.TYPO_SIMILARITY
    scam_score: int = S.SCAM_SCORE
    ruleset_version: str = S.RULESET_VERSION


def read_messages(messages: DataFrame, options: ScoreOptions = ScoreOptions(), *,
                  qr_payloads: DataFrame | None = None) -> DataFrame:
    """Facts, message type, links and local evidence. ``messages(message_id, body, sender, ...)``.
    Narrow unless QR payloads are joined in."""
    facts = extract.extract_facts(messages, brands=options.brands)
    if qr_payloads is not None:
        facts = extract.merge_qr(facts, qr_payloads)
    facts = extract.link_structs(extract.classify(facts))
    return evidence.type_evidence(evidence.local_evidence(
        facts, aliases=options.aliases, probability=options.probability,
        ml_threshold=options.ml_threshold, typo=options.typo))


def score_messages(messages: DataFrame, *joined_evidence: DataFrame,
                   options: ScoreOptions = ScoreOptions(),
                   qr_payloads: DataFrame | None = None) -> DataFrame:
    """Verdict per message. Without joined evidence the whole plan is a projection."""
    read = read_messages(messages, options, qr_payloads=qr_payloads)
    return judge(evidence.attach(read, *joined_evidence), options)


def judge(read: DataFrame, options: ScoreOptions = ScoreOptions()) -> DataFrame:
    return scoring.advise(scoring.decide(read, options.ruleset_version, options.scam_score))


# --- against the stored tables ------------------------------------------------------------------

@dataclass(frozen=True)
class Store:
    """Tables that joined evidence reads; leave out what a site does not have."""

    indicators: DataFrame | None = None
    snapshots: DataFrame | None = None
    artifacts: DataFrame | None = None
    campaigns: DataFrame | None = None
    domain_facts: DataFrame | None = None
    redirect_facts: DataFrame | None = None
    hash_list: DataFrame | None = None
    page_scans: DataFrame | None = None


def links_of(messages: DataFrame, body: str = "body") -> DataFrame:
    """Link facts straight from the bodies: only link extraction runs, no other text work."""
    return extract.url_facts(messages.select(
        "message_id", urls.extract_urls(F.col(body)).alias("urls")))


def stage_facts(messages: DataFrame, pepper: bytes, *, options: ScoreOptions = ScoreOptions(),
                qr_payloads: DataFrame | None = None) -> DataFrame:
    """Everything that the evidence of a batch asks of its messages, worked out once and written to the shared
    folder: facts and local signals (``read_messages``), link rows with canonical links, the fingerprint of the
    redacted text and the artifacts. Each source of evidence then scans only the columns it joins on."""
    read = read_messages(messages, options, qr_payloads=qr_payloads)
    read = read.withColumns({
        "simhash": text.pin(text.simhash(pii.redact(F.col("body")))),
        "link_rows": text.pin(F.transform("links", lambda link: F.struct(
            link["url"].alias("url"), link["host"].alias("host"), link["domain"].alias("domain"),
            urls.canonical_url(link["url"]).alias("canonical_url"))))})
    return stage_table(campaigns.with_artifacts(read, pepper, simhash=F.col("simhash")), "facts")


def staged_links(facts: DataFrame) -> DataFrame:
    """(message_id, position, url, host, domain, canonical_url) of staged facts."""
    return facts.select("message_id", F.posexplode("link_rows").alias("position", "link")).select(
        "message_id", "position", "link.*")


def store_evidence(facts: DataFrame, store: Store, now: datetime, *, consensus: int = S.PROVIDER_CONSENSUS,
                   window_days: int = S.CAMPAIGN_WINDOW_DAYS,
                   min_types: int = S.MIN_ARTIFACT_TYPES) -> list[DataFrame]:
    """Rows (message_id, ordinal, signal) of each stored source for staged facts."""
    links, joined = staged_links(facts), []
    if store.domain_facts is not None and store.redirect_facts is not None:
        joined.append(evidence.network_evidence(facts, store.domain_facts, store.redirect_facts, now))
    if store.indicators is not None and store.snapshots is not None:
        joined.append(intel.reputation_evidence(links, store.indicators, store.snapshots, now, consensus=consensus))
    else:
        joined.append(intel.shared_platform_evidence(links))
    if store.hash_list is not None:
        joined.append(evidence.hash_list_evidence(links, store.hash_list))
    if store.page_scans is not None:
        joined.append(evidence.page_evidence(facts, store.page_scans))
    if store.campaigns is not None:
        if store.artifacts is not None:
            joined.append(campaigns.artifact_evidence(campaigns.match_artifacts(
                campaigns.artifact_rows(facts), store.artifacts, store.campaigns, now, window_days=window_days,
                min_types=min_types)))
        joined.append(campaigns.text_evidence(campaigns.match_texts(
            facts.select("message_id", "simhash"), store.campaigns, now, window_days=window_days)))
    return joined


def score_facts(facts: DataFrame, store: Store, now: datetime, *, options: ScoreOptions = ScoreOptions(),
                **limits: int) -> DataFrame:
    """Verdicts of staged facts with all evidence that the stored tables can give. Each source contributes only
    the messages it matched; they meet the batch in one join on the message id. Every source's rows are staged, so
    the driver plans one source at a time and never all of them together."""
    joined = [stage_table(rows, "evidence") for rows in store_evidence(facts, store, now, **limits)]
    return judge(evidence.attach(facts.drop("link_rows", "artifacts"), *joined), options)


def score_against_store(messages: DataFrame, store: Store, now: datetime, pepper: bytes, *,
                        options: ScoreOptions = ScoreOptions(), qr_payloads: DataFrame | None = None,
                        **limits: int) -> DataFrame:
    """``score_facts`` of a batch that is staged first; ``limits`` as in ``store_evidence``."""
    return score_facts(stage_facts(messages, pepper, options=options, qr_payloads=qr_payloads), store, now,
                       options=options, **limits)
