"""Feeds, campaigns, retro-hunt, reviews, certificates, upkeep over derived stored tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from vigia import fixed
from vigia.functions import text as tx
from vigia.operators import campaigns, certs, extract, hunt, intel, upkeep
from vigia.plans.score import links_of
from vigia.session import stage_table
from vigia.sources import readers

from checks import ctes, score, text as text_checks
from checks.ctes import lit, sql
from checks.inputs import (FOREIGN, NOW, NOW_SQL, PEPPER, PROVIDERS, choose, events, feed_lines, foreign_feed,
                           foreign_urls, indicators, messages, snapshots, spread, table)

_EPOCH = lambda c: F.unix_micros(c).alias(c)


# --- feeds ----------------------------------------------------------------------------------------

def feed_values(spark, sf):
    lines = feed_lines(spark, sf)
    hosts = readers.feed_values(lines, "urlhaus_hosts", "hostfile", "domain")
    urls = readers.feed_values(lines.select(F.col("url").alias("value")), "openphish", "text", "url")
    cells = readers.feed_values(lines.select(F.concat(
        F.lit('"'), "page_id", F.lit('","'), "url", F.lit('",online')).alias("value")),
        "urlhaus", "csv", "url")
    foreign = foreign_urls(spark, sf)
    names = readers.feed_values(foreign.select(F.concat(F.lit("p"), "page_id", F.lit("."), F.upper("ending")).alias("value")),
                                "foreign", "text", "domain")
    links = readers.feed_values(foreign.select(F.col("url").alias("value")), "foreign", "text", "url")
    return hosts.unionByName(urls).unionByName(cells).unionByName(names).unionByName(links)


_FEED = f"""select distinct 'foreign' as provider, 'domain' as indicator_type, {ctes.idna("'p' || page_id || '.' || ending")} as value
    from foreign_pages
  union all select distinct 'foreign', 'url', {ctes.canonical('url')} from foreign_pages
  union all select distinct 'urlhaus_hosts' as provider, 'domain' as indicator_type, lower(v) as value from (
    select case page_id % 4 when 0 then string_split(value, ' ')[2] when 1 then string_split(value, chr(9))[2]
      when 2 then string_split(value, ' ')[1] end as v from feed_lines where page_id % 4 < 3)
  union all select distinct 'openphish', 'url', {ctes.canonical('url')} from feed_lines
  union all select distinct 'urlhaus', 'url', {ctes.canonical('url')} from feed_lines"""


def _syncs(spark, sf):
    return spark.createDataFrame(
        [("urlhaus", "s1", NOW), ("extra_feed", "s2", NOW)],
        "provider string, snapshot_id string, fetched_at timestamp")


def _incoming(spark, sf):
    pages = table(spark, sf, "pages")
    value = F.regexp_replace("url", "#.*$", "")
    return intel.as_indicators(pages.select(
        F.when(F.col("page_id") % 2 == 0, "urlhaus").otherwise("extra_feed").alias("provider"),
        F.lit("url").alias("indicator_type"), value.alias("value")))


def _merged(spark, sf, deactivate):
    merged = intel.merge_snapshot(indicators(spark, sf), _incoming(spark, sf), _syncs(spark, sf),
                                  deactivate=deactivate)
    return merged.select("provider", "snapshot_id", "indicator_type", "value_public", "status",
                         _EPOCH("first_seen"), _EPOCH("last_seen"))


def feed_merge(spark, sf):
    return _merged(spark, sf, True)


def feed_increment(spark, sf):
    return _merged(spark, sf, False)


def _merge_sql(deactivate: bool) -> str:
    gone = "case when o.provider in ('urlhaus', 'extra_feed') then 'inactive' else o.status end" \
        if deactivate else "o.status"
    return sql(f"""select coalesce(n.provider, o.provider) as provider, coalesce(n.sid, o.snapshot_id) as snapshot_id,
      coalesce(n.indicator_type, o.indicator_type) as indicator_type, coalesce(n.v, o.value_public) as value_public,
      case when n.v is not null then 'active' else {gone} end as status,
      epoch_us(coalesce(o.first_seen, {NOW_SQL})) as first_seen,
      epoch_us(case when n.v is not null then {NOW_SQL} else o.last_seen end) as last_seen
    from indicators o full join (select distinct case when page_id % 2 = 0 then 'urlhaus' else 'extra_feed' end as provider,
      case when page_id % 2 = 0 then 's1' else 's2' end as sid, 'url' as indicator_type,
      regexp_replace(url, '#.*$', '') as v from pages) n
      on n.provider = o.provider and n.indicator_type = o.indicator_type and n.v = o.value_public""", "indicators")


def snapshot_log(spark, sf):
    """Snapshot rows of two feeds, each with the root of its values' hash tree."""
    rows = intel.snapshot_rows(_incoming(spark, sf), NOW, "v9")
    roots = intel.tree_checksum(_incoming(spark, sf), "value_public", ("provider",))
    failed = intel.failed_snapshot(spark, "openphish", "HTTPError", NOW)
    return rows.unionByName(failed).drop("checksum").join(
        roots.select("provider", F.col("checksum").alias("root"), F.col("entry_count").alias("leaves")), "provider", "left").select(
        "provider", "entry_count", "version", F.col("succeeded").cast("int").alias("succeeded"), "error_type", "leaves", "root")


_LEVELS = [f"""l{k} as (select provider, left(place, {2 * k}) as place, sha256(string_agg(digest, '' order by digest)) as digest,
    sum(n) as n from l{k + 1} group by 1, 2)""" for k in (3, 2, 1, 0)]
_SNAPLOG = f"""with v as (select distinct case when page_id % 2 = 0 then 'urlhaus' else 'extra_feed' end as provider,
    regexp_replace(url, '#.*$', '') as u from pages), l4 as (select provider, sha256(u) as place, sha256(u) as digest, 1 as n from v),
  {', '.join(_LEVELS)}
  select provider, count(*) as entry_count, 'v9' as version, 1 as succeeded, null as error_type, any_value(l0.n)::bigint as leaves,
    any_value(l0.digest) as root from v join l0 using (provider) group by 1
  union all select 'openphish', 0, 'error', 0, 'HTTPError', null, null"""


def provider_delete(spark, sf):
    return intel.delete_provider(indicators(spark, sf), "urlhaus").groupBy("provider").agg(
        F.count("*").alias("entries"))


def latest_snapshots(spark, sf):
    return intel.latest_snapshots(snapshots(spark, sf)).select(
        "provider", "snapshot_id", "version", _EPOCH("fetched_at"))


def feed_health(spark, sf):
    return intel.feed_health(indicators(spark, sf), snapshots(spark, sf), NOW).select(
        "provider", "status", "entries", F.coalesce("age_seconds", F.lit(-1)).alias("age_seconds"))


_HEALTH = f"""select p.provider, case when l.fetched_at is null then 'not_synced'
    when epoch({NOW_SQL}) - epoch(l.fetched_at) > least(ttl_seconds, 21600) then 'stale' else 'ok' end as status,
  coalesce(i.n, 0) as entries, coalesce(epoch({NOW_SQL}) - epoch(l.fetched_at), -1)::bigint as age_seconds
from policies p left join latest l using (provider) left join (select provider, count(*) as n from indicators
  where status = 'active' group by 1) i using (provider)"""


def snapshot_as_of(spark, sf):
    times = events(spark, sf).select(
        "event_id", choose(F.col("user_id") % len(PROVIDERS), PROVIDERS).alias("provider"),
        F.col("ts").alias("at"))
    return intel.as_of_snapshots(times, snapshots(spark, sf), NOW).select("event_id", "snapshot_id")


_ASOF = f"""select event_id, s.snapshot_id from (select *, {ctes.cases(f'user_id % {len(PROVIDERS)}', PROVIDERS)}
    as provider from events) e asof left join (select * from snapshots where succeeded) s
    on e.provider = s.provider and e.ts >= s.fetched_at"""


def _foreign_messages(spark, sf):
    return foreign_urls(spark, sf).select("message_id", F.concat(F.lit("Vea "), "url").alias("body"))


def _foreign_indicators(spark, sf):
    """The international endings as read from two feeds: one value under one or two fresh providers."""
    feed = foreign_feed(spark, sf)
    read = None
    for provider in ("destroylist", "urlhaus_hosts"):
        own = readers.feed_values(feed.where(F.col("provider") == provider).select(F.col("ending").alias("value")),
                                  provider, "text", "domain")
        read = own if read is None else read.unionByName(own)
    return read.select("provider", "indicator_type", F.col("value").alias("value_public"), F.lit("active").alias("status"))


def reputation(spark, sf):
    """Feed evidence of all messages, of links with international names and rare suffixes too; some of those are
    listed by two fresh providers, which makes them hard."""
    links = links_of(messages(spark, sf).select("message_id", "body").unionByName(_foreign_messages(spark, sf)))
    known = indicators(spark, sf).select("provider", "indicator_type", "value_public", "status") \
        .unionByName(_foreign_indicators(spark, sf))
    rows = intel.reputation_evidence(links, known, snapshots(spark, sf), NOW)
    return rows.select("message_id", "signal.check_name", "signal.weight",
                       F.col("signal.hard_rule").cast("int").alias("hard"))


_REPUTATION = f"""
  select message_id, case when fresh > 0 then 'known_bad_indicator' else 'stale_threat_indicator' end as check_name,
    case when fresh = 0 then 0 when fresh >= 2 then 100 else 60 end as weight, (fresh >= 2)::int as hard from (
    select message_id, x, count(distinct case when fresh then provider end) as fresh from (
      select distinct l.message_id, l.domain as x, i.provider, s.fresh from every_link l join listed i
        on i.indicator_type = 'domain' and i.status = 'active' and contains(i.value_public, '.')
          and (l.domain = i.value_public or l.domain like '%.' || i.value_public)
        join provider_state s on s.provider = i.provider
      union all
      select distinct l.message_id, l.canonical_url, i.provider, s.fresh from every_link l join listed i
        on i.indicator_type = 'url' and i.status = 'active' and i.value_public = l.canonical_url
        join provider_state s on s.provider = i.provider) group by 1, 2)
  union all select message_id, 'shared_infrastructure_context', 0, 0 from shared"""


# --- campaigns --------------------------------------------------------------------------------------

def _prints(spark, sf):
    """Fingerprints of all documents, worked out once: whatever joins them reads numbers, and no plan above holds the
    text views' large tables of characters."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return stage_table(spread(docs, "doc_id").select(
        F.concat(F.lit("m"), "doc_id").alias("message_id"), "doc_id",
        tx.pin(tx.simhash(F.col("text"))).alias("simhash")), "prints")


def _campaigns(spark, sf, prints):
    """Toxic documents grouped by fingerprint: campaigns of earlier batches."""
    seen = events(spark, sf).select(F.col("event_id").alias("doc_id"), "ts")
    toxic = prints.where("simhash <> 0").join(table(spark, sf, "labels").where("toxic = 1").join(seen, "doc_id"), "doc_id")
    return toxic.groupBy("simhash").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("hits"),
        F.bool_or(F.col("quality") == 0).alias("confirmed")).select(
        campaigns.campaign_id(F.col("simhash")).alias("campaign_id"), "simhash", "first_seen",
        "last_seen", "hits", F.lit(None).cast("string").alias("entity"),
        F.lit("estafa").alias("verdict"), "confirmed", F.lit("simhash").alias("cluster_method"))


_CAMPAIGNS = {
    **text_checks.simhash_ctes("select doc_id as id, text from documents"),
    "camps": """select 'c-' || substr(sha256((case when fp > 9223372036854775807 then fp::hugeint - 18446744073709551616
          else fp end)::varchar), 1, 16) as campaign_id, fp, min(ts) as first_seen, max(ts) as last_seen,
        count(*) as hits, bool_or(quality = 0) as confirmed
      from prints join labels on doc_id = id join events on event_id = id where toxic = 1 and fp <> 0 group by fp""",
}
_SLICE = " or ".join(f"(p.fp >> {s}) & 65535 = (c.fp >> {s}) & 65535" for s in (0, 16, 32, 48))


def campaign_text(spark, sf):
    prints = _prints(spark, sf)
    found = campaigns.match_texts(prints.select("message_id", "simhash"), _campaigns(spark, sf, prints), NOW)
    found = stage_table(found, "found")
    return campaigns.text_evidence(found).join(found, "message_id").select(
        "message_id", "campaign_id", "similarity", "signal.weight")


_TEXTS = f"""select 'm' || id as message_id, campaign_id, round(sim, 3)::double as similarity,
  case when confirmed then 100 else 55 end as weight from (select p.id, c.campaign_id, c.confirmed,
    1 - bit_count(xor(p.fp, c.fp)) / 64.0 as sim, row_number() over (partition by p.id order by
      bit_count(xor(p.fp, c.fp)), c.last_seen desc, c.campaign_id) as r
    from prints p join camps c on {_SLICE} where p.fp <> 0 and bit_count(xor(p.fp, c.fp)) <= 6
      and c.last_seen >= {NOW_SQL} - interval 30 days) where r = 1"""


def artifact_sets(spark, sf):
    linked = extract.link_structs(extract.extract_facts(messages(spark, sf)))
    return campaigns.build_artifacts(linked, PEPPER).groupBy("artifact_type").agg(
        F.count("*").alias("n"), F.countDistinct("value_hash").alias("distinct_values"),
        F.max("value_hash").alias("largest"))


def _hmac(value: str) -> str:
    return text_checks._PSEUDONYM.replace("user_reference", value)


ARTIFACT_ROWS = f"""select distinct message_id, 'domain' as artifact_type, sha256(domain) as h from links
    union all select distinct message_id, 'url_path_template', sha256({score.TEMPLATE}) from links
    union all select distinct message_id, 'phone', {_hmac("v")} from (
      select message_id, regexp_replace(unnest(list_append(regexp_extract_all(body, {lit(text_checks._PHONE)}, 1),
        coalesce(sender_number, ''))), '[^0-9]', '', 'g') as v from read) where v <> ''
    union all select message_id, 'iban', {_hmac("'ES9121000418450200051332'")} from read where {text_checks._IBAN}
    union all select id, 'text_fingerprint', sha256((case when fp > 9223372036854775807
        then fp::hugeint - 18446744073709551616 else fp end)::varchar) from prints where fp <> 0"""
_ARTIFACTS = f"""select artifact_type, count(*) as n, count(distinct h) as distinct_values, max(h) as largest
    from ({ARTIFACT_ROWS}) group by 1"""


def _stored_artifacts(spark, sf):
    """Artifacts of past messages, three per event; purchases are assigned to campaigns."""
    ev = events(spark, sf)
    campaign = F.when(F.col("event_type") == "purchase", F.concat(F.lit("c"), F.col("user_id") % 40))
    kinds = F.array(
        F.struct(F.lit("domain").alias("t"), F.concat(F.lit("d"), F.col("user_id")).alias("v")),
        F.struct(F.lit("phone").alias("t"), F.concat(F.lit("p"), F.floor("value")).alias("v")),
        F.struct(F.lit("url_path_template").alias("t"), F.concat(F.lit("u"), "props").alias("v")),
        F.struct(F.lit("iban").alias("t"), F.lit("everyone").alias("v")))
    return ev.select(F.concat(F.lit("e"), "event_id").alias("message_id"), campaign.alias("campaign_id"),
                     F.explode(kinds).alias("k"), F.col("ts").alias("created_at")).select(
        "message_id", "campaign_id", F.col("k.t").alias("artifact_type"),
        F.sha2("k.v", 256).alias("value_hash"), F.col("k.v").alias("value_public"),
        F.lit("derived").alias("source"), "created_at")


def _event_campaigns(spark, sf):
    ids = events(spark, sf).where("event_type = 'purchase'").select((F.col("user_id") % 40).alias("k")).distinct()
    return ids.select(
        F.concat(F.lit("c"), "k").alias("campaign_id"), F.col("k").alias("simhash"),
        F.when(F.col("k") % 3 == 0, "no_puedo_confirmarlo").otherwise("estafa").alias("verdict"),
        (F.col("k") % 2 == 0).alias("confirmed"))


_STORED = {
    "stored": """select 'e' || event_id as message_id, case when event_type = 'purchase'
        then 'c' || (user_id % 40) end as campaign_id, t as artifact_type, v as value_public, ts as created_at,
        event_type from (select *, unnest(['domain', 'phone', 'url_path_template', 'iban']) as t,
          unnest(['d' || user_id, 'p' || floor(value)::bigint, 'u' || props, 'everyone']) as v from events)""",
    "ecamps": """select distinct 'c' || (user_id % 40) as campaign_id, user_id % 40 as k,
        user_id % 40 % 2 = 0 as confirmed from events where event_type = 'purchase'""",
}


def campaign_artifacts(spark, sf):
    stored = _stored_artifacts(spark, sf)
    wanted = stored.where("campaign_id is null")
    found = campaigns.match_artifacts(wanted, stored, _event_campaigns(spark, sf), NOW, window_days=20)
    return campaigns.artifact_evidence(found).join(found, "message_id").select(
        "message_id", "campaign_id", "match_count", F.array_join("artifact_types", "|").alias("types"),
        "signal.weight")


_BEST = f"""select message_id, campaign_id, n::int as match_count, types, case when confirmed then 100 else 60 end as weight
  from (select *, row_number() over (partition by message_id order by n desc, campaign_id) as r from (
    select w.message_id, h.campaign_id, count(distinct w.artifact_type) as n,
      array_to_string(list_sort(list(distinct w.artifact_type)), '|') as types
    from (select * from stored where campaign_id is null) w join (select distinct campaign_id, artifact_type, value_public
      from stored where campaign_id is not null and created_at >= {NOW_SQL} - interval 20 days) h
      using (artifact_type, value_public) group by 1, 2 having n >= 2)) join ecamps using (campaign_id)
  where r = 1 and k % 3 <> 0"""


def campaign_rollup(spark, sf):
    """Documents as a scored batch against the toxic campaigns."""
    seen = events(spark, sf).select(F.col("event_id").alias("doc_id"), "ts")
    prints = _prints(spark, sf)
    batch = prints.join(seen, "doc_id").select(
        "message_id", F.col("ts").alias("received_at"), "simhash",
        F.when(F.col("doc_id") % 3 == 0, "estafa").otherwise("no_puedo_confirmarlo").alias("level"),
        F.lit("X").alias("claimed_entity"), (F.col("doc_id") % 6 == 0).alias("seed"))
    known = _campaigns(spark, sf, prints)
    hints = campaigns.match_texts(batch.select("message_id", "simhash"), known, NOW).select(
        "message_id", "campaign_id", F.lit(False).alias("by_artifacts"))
    return campaigns.record_campaigns(batch, known, hints).select(
        "campaign_id", "hits", F.col("confirmed").cast("int").alias("confirmed"), _EPOCH("first_seen"),
        _EPOCH("last_seen"), "cluster_method")


_ROLLUP = f"""select coalesce(c.campaign_id, b.cid) as campaign_id, (coalesce(c.hits, 0) + coalesce(b.n, 0))::bigint as hits,
  (coalesce(c.confirmed, false) or coalesce(b.seed, false))::int as confirmed,
  epoch_us(coalesce(c.first_seen, b.f)) as first_seen, epoch_us(greatest(c.last_seen, b.l)) as last_seen,
  'simhash' as cluster_method
from camps c full join (select coalesce(t.campaign_id, 'c-' || substr(sha256((case when fp > 9223372036854775807
    then fp::hugeint - 18446744073709551616 else fp end)::varchar), 1, 16)) as cid, count(*) as n, min(ts) as f,
    max(ts) as l, bool_or(id % 6 = 0) as seed from prints join events on event_id = id
    left join texts t on t.message_id = 'm' || id where id % 3 = 0 and fp <> 0 group by 1) b on b.cid = c.campaign_id"""


# --- hunt and review ------------------------------------------------------------------------------------

def _verdicts(spark, sf):
    return events(spark, sf).select(
        F.concat(F.lit("e"), "event_id").alias("message_id"),
        F.when(F.col("event_type") == "signup", "estafa").otherwise("no_puedo_confirmarlo").alias("level"))


def _listed(spark, sf):
    """Indicators that name the stored domains: one per user, by provider."""
    users = events(spark, sf).select("user_id").distinct()
    provider = choose(F.col("user_id") % len(PROVIDERS), PROVIDERS)
    value = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("d"), "user_id")).otherwise(
        F.concat(F.lit("https://www.x"), "user_id", F.lit(".example.com/a")))
    return users.select(
        provider.alias("provider"), F.concat(provider, F.lit("-last")).alias("snapshot_id"),
        F.when(F.col("user_id") % 2 == 0, "domain").otherwise("url").alias("indicator_type"),
        value.alias("value_public"), F.lit("active").alias("status"))


def _candidates(spark, sf):
    stored = _stored_artifacts(spark, sf)
    domains = hunt.fresh_domains(_listed(spark, sf), snapshots(spark, sf), NOW)
    return hunt.hunt_feeds(domains, stored, _verdicts(spark, sf)).unionByName(
        hunt.hunt_campaigns(stored, _event_campaigns(spark, sf), _verdicts(spark, sf), 3))


def retro_hunt(spark, sf):
    """Feed and campaign hits among stored messages; links with international names against a feed of exact links."""
    foreign = _foreign_messages(spark, sf)
    carried = links_of(foreign).select("message_id", F.lit("domain").alias("artifact_type"), F.col("domain").alias("value_public"))
    listed = readers.feed_values(foreign_urls(spark, sf).select(F.col("url").alias("value")), "destroylist", "text", "url") \
        .select("provider", F.lit("destroylist-last").alias("snapshot_id"), "indicator_type", F.col("value").alias("value_public"),
                F.lit("active").alias("status"))
    doubtful = foreign.select("message_id", F.lit("no_puedo_confirmarlo").alias("level"))
    found = hunt.hunt_feeds(hunt.fresh_domains(listed, snapshots(spark, sf), NOW), carried, doubtful)
    return _candidates(spark, sf).unionByName(found).select("message_id", "reason", "reference")


_HUNT = f"""select message_id, 'new_threat_indicator' as reason, value_public as reference from stored
    where artifact_type = 'domain' and event_type <> 'signup' and try_cast(substr(value_public, 2) as bigint) % 2 = 0
      and case try_cast(substr(value_public, 2) as bigint) % 5 when 0 then 600 <= 1800 when 1 then 90000 <= 1800
        when 2 then 1700 <= 1800 when 3 then 3600 <= 3600 else false end
  union all
  select message_id, 'confirmed_campaign_match', campaign_id from (
    select w.message_id, h.campaign_id, count(distinct w.artifact_type) as n
    from (select * from stored where campaign_id is null and event_type <> 'signup') w
    join (select distinct campaign_id, artifact_type, value_public from stored join ecamps using (campaign_id)
      where confirmed) h using (artifact_type, value_public) group by 1, 2 having n >= 3)"""


def _queue(spark, sf, found=None):
    """Reviews queued earlier: the feed hits of even-numbered messages, some already closed. ``found``: the candidates,
    where they are hunted for already."""
    number = F.substring("message_id", 2, 20).cast("long")
    old = (_candidates(spark, sf) if found is None else found).where((number % 2 == 0) & (F.col("reason") == "new_threat_indicator"))
    empty = spark.createDataFrame([], "dedupe_key string")
    queue = hunt.enqueue(old, empty, NOW)
    seen = events(spark, sf).select(F.concat(F.lit("e"), "event_id").alias("message_id"), "ts")
    return queue.drop("created_at").join(seen, "message_id").select(
        "dedupe_key", "message_id", "reason",
        F.when(number % 10 == 0, "rejected").otherwise("pending").alias("status"), "payload",
        F.col("ts").alias("created_at"), "resolved_at")


def review_enqueue(spark, sf):
    answers = events(spark, sf).where("event_type = 'error'").select(
        F.concat(F.lit("e"), "event_id").alias("message_id"), F.lit("incorrecto").alias("user_said"),
        F.when(F.col("user_id") % 2 == 0, "false_alarm").alias("reason_code"))
    hunted = _candidates(spark, sf)
    found = hunted.unionByName(hunt.feedback_reviews(answers))
    return hunt.enqueue(found, _queue(spark, sf, hunted), NOW).select("dedupe_key", "message_id", "reason", "status")


_KEYS = "sha256(message_id || '|' || reason || '|' || reference)"
_ENQUEUE = f"""select {_KEYS} as dedupe_key, message_id, reason, 'pending' as status from (
    select * from hunted where not (reason = 'new_threat_indicator' and substr(message_id, 2)::bigint % 2 = 0)
    union all select 'e' || event_id, 'user_disagreed', case when user_id % 2 = 0 then 'false_alarm'
      else 'unspecified' end from events where event_type = 'error')"""
_QUEUED = f"""select {_KEYS} as dedupe_key, h.*, ts, case when substr(message_id, 2)::bigint % 10 = 0
    then 'rejected' else 'pending' end as status from hunted h join events on 'e' || event_id = message_id
    where reason = 'new_threat_indicator' and event_id % 2 = 0"""


def review_queue(spark, sf):
    bodies = table(spark, sf, "documents").select(
        F.concat(F.lit("e"), "doc_id").alias("message_id"), F.col("text").alias("body_redacted"))
    rows = hunt.review_queue(_queue(spark, sf), bodies, _verdicts(spark, sf), 100)
    return rows.select("dedupe_key", "message_id", "current_verdict", F.md5("body_redacted").alias("body"))


def _decisions(spark, sf):
    return _queue(spark, sf).select(
        "dedupe_key", F.when(F.substring("dedupe_key", 1, 1) < "8", "confirmed_scam").otherwise("false_alarm")
        .alias("resolution"), F.lit("seen").alias("notes"), F.lit(True).alias("confirm_campaign"))


def review_resolution(spark, sf):
    rows = hunt.resolve_reviews(_queue(spark, sf), _decisions(spark, sf), NOW)
    return rows.select("dedupe_key", "status", F.try_element_at("payload", F.lit("review_notes")).alias("notes"),
                       F.coalesce(F.unix_timestamp("resolved_at"), F.lit(-1)).alias("resolved_at"))


def campaign_confirmation(spark, sf):
    queue = hunt.enqueue(hunt.hunt_campaigns(
        _stored_artifacts(spark, sf), _event_campaigns(spark, sf), _verdicts(spark, sf), 3),
        spark.createDataFrame([], "dedupe_key string"), NOW)
    decisions = queue.select("dedupe_key", F.lit("confirmed_scam").alias("resolution"),
                             F.lit("n").alias("notes"), F.lit(True).alias("confirm_campaign"))
    unconfirmed = _event_campaigns(spark, sf).withColumn("confirmed", F.lit(False))
    return hunt.confirm_campaigns(unconfirmed, queue, decisions).groupBy("confirmed").agg(
        F.count("*").alias("campaigns")).select(F.col("confirmed").cast("int").alias("confirmed"), "campaigns")


def feedback_state(spark, sf):
    ev = events(spark, sf)
    answers = ev.select(
        F.concat(F.lit("u"), "user_id").alias("message_id"), F.col("event_type").alias("user_said"),
        F.col("props").alias("reason_code"), F.col("ts").alias("answered_at"))
    stored = ev.select(F.concat(F.lit("u"), "user_id").alias("message_id")).distinct().select(
        "message_id", F.lit("correcto").alias("user_said"), F.lit(None).cast("string").alias("reason_code"),
        F.lit(NOW).alias("created_at")).where(F.length("message_id") % 2 == 0)
    return hunt.upsert_feedback(stored, answers).select("message_id", "user_said", "reason_code")


def operations(spark, sf):
    received = events(spark, sf).select(F.col("ts").alias("received_at"))
    return hunt.operations(received, _queue(spark, sf), datetime(2024, 1, 30, 12))


def audit_log(spark, sf):
    actions = _decisions(spark, sf).select(
        F.lit("reviewer").alias("actor"), F.lit("review.resolve").alias("action"),
        F.col("dedupe_key").alias("target_id"), F.to_json(F.struct("resolution")).alias("metadata"))
    return hunt.audit_events(actions, NOW).groupBy("actor", "action", "metadata").agg(F.count("*").alias("n"))


# --- certificates ---------------------------------------------------------------------------------------

def _certificates(spark, sf):
    """Certificate rows for page hosts; some names put a brand in front."""
    pages = table(spark, sf, "pages").join(
        events(spark, sf).select(F.col("event_id").alias("page_id"), "ts"), "page_id")
    host = F.regexp_extract("url", "//([^/?#]*)", 1)
    last2 = F.substring_index(host, ".", -2)
    middle = F.regexp_extract(host, r"([^.]*)\.[^.]*\.[^.]*$", 1)
    name = choose(F.col("page_id") % 5, ("", "", "", "", ""))
    kind = F.col("page_id") % 5
    name = (
        F.when(kind == 0, F.concat(F.lit("*.bbva-"), middle, F.lit(".top")))
        .when(kind == 1, F.concat(F.lit("www.bankimter.es\nlogin.santander"), F.col("page_id"), F.lit(".com")))
        .when(kind == 2, F.concat(F.lit("caixabank.es\ncorreos-"), middle, F.lit(".online")))
        .when(kind == 3, host).otherwise(F.concat(F.lit("Some Company, S.L.\nsabadell."), last2)))
    return pages.select(
        F.col("page_id").cast("string").alias("id"), F.col("page_id").alias("position"),
        name.alias("name_value"),
        F.when(F.col("page_id") % 3 == 0, "C=US, O=Let's Encrypt, CN=R3")
        .when(F.col("page_id") % 3 == 1, "ZeroSSL RSA").otherwise("Corporate CA").alias("issuer_name"),
        F.lit(None).cast("string").alias("common_name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("entry_timestamp"),
        F.lit(None).cast("string").alias("not_before"), F.lit(None).cast("string").alias("not_after"))


def _observations(spark, sf):
    return certs.lookalikes(_certificates(spark, sf), datetime(2024, 1, 3))


def certificate_lookalikes(spark, sf):
    return _observations(spark, sf).select(
        F.col("value").alias("domain"), F.element_at("provenance", "claimed_entity").alias("entity"),
        "confidence", F.unix_timestamp("first_seen").alias("first_seen"),
        F.element_at("provenance", "ct_id").alias("ct_id"))


_MONITORED = [b for b in certs.monitored()]
_BRAND_TABLE = ",".join(
    f"({i}, {lit(b.name)}, {[*b.tokens]}, {[*b.domains]}, "
    f"{[ctes.token_literal(d.split('.')[0]) for d in b.domains]})" for i, b in enumerate(_MONITORED))
_CT_NOW = "timestamp '2024-01-03 00:00:00'"
_CERT = {
    "certs": """select page_id, ts, regexp_extract(url, '//([^/?#]*)', 1) as h,
        regexp_extract(url, '([^./]*)[.][^./]*[.][^./]*(?:/|[?]|#|$)', 1) as mid, case page_id % 3
          when 0 then 'C=US, O=Let''s Encrypt, CN=R3' when 1 then 'ZeroSSL RSA' else 'Corporate CA' end as issuer
        from pages join events on event_id = page_id""",
    "names": """select page_id, ts, issuer, unnest(string_split(case page_id % 5
          when 0 then '*.bbva-' || regexp_extract(h, '([^.]*)[.][^.]*[.][^.]*$', 1) || '.top'
          when 1 then 'www.bankimter.es' || chr(10) || 'login.santander' || page_id || '.com'
          when 2 then 'caixabank.es' || chr(10) || 'correos-' || regexp_extract(h, '([^.]*)[.][^.]*[.][^.]*$', 1) || '.online'
          when 3 then h else 'Some Company, S.L.' || chr(10) || 'sabadell.' || array_to_string(string_split(h, '.')[-2:], '.')
          end, chr(10))) as name from certs""",
    "doms": f"""select page_id, ts, issuer, {ctes.registrable('n')} as domain from (select *,
        ltrim(name, '*.') as n from names where not regexp_matches(name, '[ ,/]') and contains(name, '.'))""",
    "seen": f"""select d.*, b.entity, b.ord, round(least(1, (20 + case when issuer <> 'Corporate CA' then 30 else 0 end + 30
          + case when {' or '.join(f"domain like '%{t}'" for t in fixed.CERTIFICATE_RISKY_TLDS)} then 15 else 0 end
          + case when epoch({_CT_NOW}) - floor(epoch(ts)) between 0 and 259200 then 5 else 0 end) / 100.0), 2)::double as confidence
        from (select *, {ctes.token('domain')} as bare, {ctes.token("string_split(domain, '.')[1]")} as cand from doms) d
        join (values {_BRAND_TABLE}) b(ord, entity, tokens, official, labels)
          on len(list_filter(official, lambda o: domain = o or domain like '%.' || o)) = 0
          and (len(list_filter(tokens, lambda t: length(t) >= 4 and contains(bare, t))) > 0
            or list_max(list_transform(labels, lambda o: 1 - levenshtein(cand, o)::double /
              greatest(length(cand), length(o), 1))) >= 0.82)
        where issuer <> 'Corporate CA'""",
    "observed": """select * from (select *, row_number() over (partition by domain order by ord, page_id) as r
        from seen where confidence >= 0.5) where r = 1""",
}


def phish_matches(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.col("page_id").cast("string").alias("phish_id"),
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://bankinter-"), "page_id", F.lit(".xyz/a")))
        .otherwise(F.col("url")).alias("url"),
        F.when(F.col("page_id") % 4 == 0, "Banco Sabadell").otherwise("Other").alias("target"),
        F.lit("2024-01-02T00:00:00").alias("submission_time"), F.lit("").alias("phish_detail_url"),
        F.when(F.col("page_id") % 7 == 0, "no").otherwise("YES").alias("verified"), F.lit("yes").alias("online"))
    return certs.match_phish(readers.verified_phish(pages)).groupBy("target_brand").agg(
        F.count("*").alias("n"), F.countDistinct("domain").alias("domains"))


_PHISH = f"""select brand as target_brand, count(*) as n, count(distinct domain) as domains from (
    select 'Bankinter' as brand, 'bankinter-' || page_id || '.xyz' as domain from pages where page_id % 7 <> 0 and page_id % 3 = 0
    union all select 'Banco Sabadell', case when page_id % 3 = 0 then 'bankinter-' || page_id || '.xyz'
      else {ctes.registrable(ctes.host('url'))} end from pages where page_id % 7 <> 0 and page_id % 4 = 0) group by 1"""


def certificate_log(spark, sf):
    logged = _observations(spark, sf).where(F.col("value") < "c").select(
        F.to_date("retrieved_at").alias("day"), F.col("value").alias("domain"))
    return certs.audit_entries(_observations(spark, sf), logged).groupBy("claimed_entity").agg(
        F.count("*").alias("n"), F.round(F.sum("risk_score"), 2).alias("risk"))


def certificate_identities(spark, sf):
    """The three certificate tables from pages, hosts and sources."""
    pages = table(spark, sf, "pages").join(
        events(spark, sf).select(F.col("event_id").alias("page_id"), "ts"), "page_id")
    identities = pages.select(
        F.col("page_id").alias("certificate_id"),
        F.when(F.col("page_id") % 6 == 0, "commonName").otherwise("dNSName").alias("name_type"),
        F.regexp_extract("url", "//([^/?#]*)", 1).alias("name_value"))
    held = pages.select(F.col("page_id").alias("id"), (F.col("page_id") % 9).alias("issuer_ca_id"),
                        F.col("ts").alias("not_before"), (F.col("ts") + F.expr("interval 90 days")).alias("not_after"))
    issuers = pages.select((F.col("page_id") % 9).alias("id")).distinct().select(
        "id", F.concat(F.lit("CA "), "id").alias("name"))
    return certs.recent_identities(identities, held, issuers, ("com", "net"), NOW, 30) \
        .groupBy("issuer_name").agg(F.count("*").alias("n"))


_IDENTITIES = f"""select 'CA ' || (page_id % 9) as issuer_name, count(*) as n from pages join events on event_id = page_id
  where page_id % 6 <> 0 and regexp_matches(lower(regexp_extract(url, '//([^/?#]*)', 1)), 'com|net')
    and ts > {NOW_SQL} - interval 30 days group by 1"""


def _lead_log(spark, sf):
    log = certs.audit_entries(_observations(spark, sf), spark.createDataFrame([], "day date, domain string"))
    public = _observations(spark, sf).select(
        F.when(F.length("value") % 3 == 0, "crtsh_ct").otherwise("openphish").alias("provider"),
        F.sha2("value", 256).alias("value_hash"), F.col("value").alias("value_public"),
        (F.col("first_seen") + F.expr("interval 36 hours")).alias("first_seen"))
    return certs.cross_reference(log, public).withColumn("active_clone", F.length("domain") % 2 == 0)


def lead_time_metrics(spark, sf):
    return certs.lead_time_metrics(_lead_log(spark, sf))


_LEAD = f"""with lt as (select domain, entity, issuer, length(domain) % 2 = 0 as clone, case when length(domain) % 3 <> 0 then
    round((floor(epoch(ts)) + 129600 - epoch({_CT_NOW})) / 86400, 2) end as d from observed)
select count(*) as total_domains_monitored, count_if(clone) as active_clones_documented,
  count(d) as corroborated_phishing_domains, round(avg(d), 2)::double as mean_days, min(d)::double as min_days,
  max(d)::double as max_days, round(count_if(d > 0) * 100.0 / count(d), 1)::double as advance_detection_rate_pct,
  (list_sort(list(d) filter (d is not null)))[(count(d) // 2 + 1)::int]::double as median_days from lt"""


def lead_time_breakdown(spark, sf):
    return certs.lead_time_breakdown(_lead_log(spark, sf))


def lead_over_messages(spark, sf):
    first = indicators(spark, sf).where("indicator_type = 'url'")
    arrived = links_of(messages(spark, sf)).select("message_id", F.col("canonical_url").alias("link")).distinct() \
        .join(messages(spark, sf).select("message_id", "received_at"), "message_id")
    return certs.lead_over_messages(first, arrived, "link").select(
        "message_id", "link", F.round("lead_seconds", 3).alias("lead_seconds"))


def run_log(spark, sf):
    records = table(spark, sf, "pages").select(
        (F.col("page_id") % 4).alias("run_at"), F.concat(F.lit("b"), "page_id").alias("entity"),
        F.when(F.col("page_id") % 3 == 0, "crtsh_http").otherwise("crtsh_postgres").alias("source"),
        (F.col("page_id") % 5 > 0).alias("ok"), F.col("page_id").alias("certificates_seen"),
        F.lit(1).alias("attempts"), F.lit(200).alias("last_status"), F.lit("").alias("error"),
        F.lit(NOW).alias("checked_at"))
    feed = table(spark, sf, "pages").where("page_id % 2 = 0").select(
        F.concat(F.lit("b"), "page_id").alias("target_brand"))
    return certs.run_log(certs.supplement_sources(records, feed)).select(
        "run_at", "entities_queried", "queries_ok", "queries_failed",
        F.array_join("sources_used", "|").alias("sources"),
        F.aggregate("results", F.lit(0).cast("long"), lambda a, r: a + r["certificates_seen"]).alias("seen"))


_RUNLOG = """select page_id % 4 as run_at, count(*) as entities_queried, count_if(page_id % 5 > 0) as queries_ok,
  count_if(page_id % 5 = 0) as queries_failed, array_to_string(list_sort(list(distinct
    case when page_id % 3 = 0 then 'crtsh_http' else 'crtsh_postgres' end || '+phishtank')), '|') as sources,
  sum(page_id + case when page_id % 2 = 0 then 1 else 0 end)::bigint as seen from pages group by 1"""


# --- upkeep ------------------------------------------------------------------------------------------------

def retention(spark, sf):
    stored = messages(spark, sf).select(
        "message_id", F.col("body").alias("body_redacted"), F.col("user_reference").alias("user_hash"), "received_at",
        F.when(F.col("doc_id") % 10 == 0, F.col("received_at")).alias("purged_at"))
    now = datetime(2024, 1, 4)
    once = upkeep.purge_expired(stored, now)
    return upkeep.purge_expired(once, now).select(
        "message_id", F.length("body_redacted").alias("n"), "user_hash",
        F.coalesce(F.unix_micros("purged_at"), F.lit(-1)).alias("purged_at"))


_RETENTION = """select message_id, case when due then 0 else length(body) end as n,
  case when not due then user_reference end as user_hash, coalesce(case when due then epoch_us(timestamp '2024-01-04')
    when doc_id % 10 = 0 then epoch_us(received_at) end, -1) as purged_at
from (select *, received_at < timestamp '2024-01-03' and doc_id % 10 <> 0 as due from messages)"""


def sliding_minute(spark, sf):
    return upkeep.sliding_counts(events(spark, sf), window_seconds=3600, limit=2).select(
        "event_id", "in_window", F.col("over_limit").cast("int").alias("over"))


_SLIDING = """select event_id, n as in_window, (n > 2)::int as over from (select event_id, count(*) over (
  partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) as n from events)"""


def minute_buckets(spark, sf):
    return upkeep.minute_buckets(events(spark, sf), limit=1).select(
        "user_id", F.unix_timestamp("minute").alias("minute"), "requests", F.col("allowed").cast("int").alias("allowed"))


def trailing_day(spark, sf):
    return upkeep.trailing_day(events(spark, sf)).select(F.unix_timestamp("until").alias("until"), "analyses")


_TRAILING = """select epoch(h + to_hours(k))::bigint as until, count(*) as analyses from (
  select date_trunc('hour', ts)::timestamp as h, unnest(range(1, 25)) as k from events) group by 1"""

_EVENT_EXTRA = {**_STORED}
QUERIES = {
    "feed_values": (feed_values, sql(_FEED, "feed_lines", "foreign_pages")),
    "feed_merge": (feed_merge, _merge_sql(True)),
    "feed_increment": (feed_increment, _merge_sql(False)),
    "snapshot_log": (snapshot_log, _SNAPLOG),
    "provider_delete": (provider_delete, sql(
        "select provider, count(*) as entries from indicators where provider <> 'urlhaus' group by 1", "indicators")),
    "latest_snapshots": (latest_snapshots, sql(
        "select provider, snapshot_id, version, epoch_us(fetched_at) as fetched_at from latest", "latest")),
    "feed_health": (feed_health, sql(_HEALTH, "latest", "indicators", "policies")),
    "snapshot_as_of": (snapshot_as_of, sql(_ASOF, "snapshots")),
    "reputation": (reputation, sql(_REPUTATION, "links", "indicators", "provider_state", "foreign_pages", extra={
        "every_link": f"""select message_id, domain, canonical_url from links
          union all select message_id, domain, {ctes.canonical('url')} from foreign_pages""",
        "listed": f"""select provider, indicator_type, status, value_public from indicators union all
          select distinct unnest(case when k % 2 = 0 then ['destroylist', 'urlhaus_hosts'] else ['destroylist'] end), 'domain',
            'active', {ctes.cases('k', [f[1] for f in FOREIGN])} from foreign_pages""",
        "shared": score.EVIDENCE["shared"].replace("from links", "from every_link")})),
    "campaign_text": (campaign_text, sql(_TEXTS, extra=_CAMPAIGNS)),
    "artifact_sets": (artifact_sets, sql(_ARTIFACTS, "links", extra={
        **text_checks.REDACTED, **text_checks.simhash_ctes("select message_id as id, t as text from redacted")})),
    "campaign_artifacts": (campaign_artifacts, sql(_BEST, extra=_STORED)),
    "campaign_rollup": (campaign_rollup, sql(_ROLLUP, extra={**_CAMPAIGNS, "texts": _TEXTS})),
    "retro_hunt": (retro_hunt, sql(f"""{_HUNT}
      union all select message_id, 'new_threat_indicator', domain from foreign_pages""", "foreign_pages", extra=_STORED)),
    "review_enqueue": (review_enqueue, sql(_ENQUEUE, extra={**_STORED, "hunted": _HUNT})),
    "review_queue": (review_queue, sql(
        """select dedupe_key, message_id, case when event_type = 'signup' then 'estafa' else 'no_puedo_confirmarlo' end
          as current_verdict, md5(text) as body from (select * from queued where status = 'pending'
            order by ts, dedupe_key limit 100) join documents on message_id = 'e' || doc_id
          join events on message_id = 'e' || event_id""",
        extra={**_STORED, "hunted": _HUNT, "queued": _QUEUED})),
    "review_resolution": (review_resolution, sql(
        f"""select dedupe_key, case when status = 'pending' then case when substr(dedupe_key, 1, 1) < '8'
            then 'confirmed_scam' else 'false_alarm' end else status end as status,
          case when status = 'pending' then 'seen' end as notes,
          case when status = 'pending' then epoch({NOW_SQL})::bigint else -1 end as resolved_at from queued""",
        extra={**_STORED, "hunted": _HUNT, "queued": _QUEUED})),
    "campaign_confirmation": (campaign_confirmation, sql(
        """select (campaign_id in (select reference from hunted where reason = 'confirmed_campaign_match'))::int
          as confirmed, count(*) as campaigns from ecamps group by 1""", extra={**_STORED, "hunted": _HUNT})),
    "feedback_state": (feedback_state, """select 'u' || user_id as message_id,
        arg_max(event_type, (ts, event_type, props)) as user_said, arg_max(props, (ts, event_type, props)) as reason_code
        from events group by 1"""),
    "operations": (operations, sql(
        """select (select count(*) from events where ts >= timestamp '2024-01-29 12:00:00')::bigint as analyses_last_24h,
          (select count(*) from queued where status = 'pending')::bigint as pending_reviews""",
        extra={**_STORED, "hunted": _HUNT, "queued": _QUEUED})),
    "audit_log": (audit_log, sql(
        """select 'reviewer' as actor, 'review.resolve' as action, '{"resolution":"' || case when
          substr(dedupe_key, 1, 1) < '8' then 'confirmed_scam' else 'false_alarm' end || '"}' as metadata,
          count(*) as n from queued group by 3""", extra={**_STORED, "hunted": _HUNT, "queued": _QUEUED})),
    "certificate_lookalikes": (certificate_lookalikes, sql(
        "select domain, entity, confidence, floor(epoch(ts))::bigint as first_seen, page_id::varchar as ct_id "
        "from observed", extra=_CERT)),
    "certificate_log": (certificate_log, sql(
        "select entity as claimed_entity, count(*) as n, round(sum(confidence), 2)::double as risk from observed "
        "where domain >= 'c' group by 1", extra=_CERT)),
    "phish_matches": (phish_matches, sql(_PHISH)),
    "certificate_identities": (certificate_identities, _IDENTITIES),
    "lead_time_metrics": (lead_time_metrics, sql(
        _LEAD[_LEAD.index("select count(*)"):], extra={
            **_CERT, "lt": _LEAD[len("with lt as ("):_LEAD.index(")\nselect count(*)")]})),
    "lead_time_breakdown": (lead_time_breakdown, sql(
        "select 'entity' as dimension, entity as value, count(*) as domains from observed group by 2 union all "
        "select 'issuer', issuer, count(*) from observed group by 2", extra=_CERT)),
    "lead_over_messages": (lead_over_messages, sql(
        """select distinct l.message_id, l.canonical_url as link, round((epoch_us(m.received_at) - epoch_us(i.f)) / 1e6, 3)::double
          as lead_seconds from links l join messages m using (message_id) join (select value_public, min(first_seen) as f
          from indicators where indicator_type = 'url' group by 1) i on i.value_public = l.canonical_url""",
        "links", "indicators")),
    "run_log": (run_log, _RUNLOG),
    "retention": (retention, sql(_RETENTION, "messages")),
    "sliding_minute": (sliding_minute, _SLIDING),
    "minute_buckets": (minute_buckets, """select user_id, epoch(date_trunc('minute', ts))::bigint as minute,
        count(*) as requests, (count(*) <= 1)::int as allowed from events group by 1, 2"""),
    "trailing_day": (trailing_day, _TRAILING),
}
