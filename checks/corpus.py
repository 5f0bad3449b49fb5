"""Corpora, evaluation, classifier and exports."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from vigia.operators import campaigns, corpus, evidence, extract, ml, stix
from vigia.plans.score import read_messages
from vigia.session import stage_table
from vigia.sources import readers, writers

from checks import ctes, score, text as text_checks
from checks.ctes import lit, sql
from checks.inputs import PEPPER, events, messages, spread, table


def _raw_rows(spark, sf):
    """A corpus file: toxic labels as scams, source as campaign, arrival day as date."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").join(
        events(spark, sf).select(F.col("event_id").alias("doc_id"), "ts"), "doc_id")
    return docs.select(
        "doc_id", F.col("text").alias("Message"), F.col("toxic").cast("string").alias("label"),
        F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("Campaign"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("lang").alias("language"))


def imported_cases(spark, sf):
    cases = corpus.import_cases(_raw_rows(spark, sf), "generic", "lab", row_number="doc_id")
    return cases.groupBy("split", "label", "language", "expected_level").agg(
        F.count("*").alias("cases"), F.countDistinct("campaign_id").alias("campaigns"))


_IMPORT = {
    "messages": """select doc_id::varchar as message_id, doc_id, text as body, lang, toxic, source, ts
        from documents join labels using (doc_id) join events on event_id = doc_id""",
    **text_checks.REDACTED,
    "imported": """select r.t, m.*, case when toxic = 1 then 'scam' else 'legitimate' end as label,
        case when doc_id % 2 = 0 then source else 'derived-' || substr(sha256(regexp_replace(lower(trim(t)),
          '\\s+', '', 'g')), 1, 16) end as campaign_id
        from redacted r join messages m using (message_id)""",
}
_BUCKET = "('0x' || substr(sha256(campaign_id), 1, 8))::bigint % 5"


def time_split(spark, sf):
    cases = corpus.import_cases(_raw_rows(spark, sf), "generic", "lab", row_number="doc_id",
                                validation_after=date(2024, 1, 3))
    return cases.groupBy("split").agg(F.count("*").alias("cases"),
                                      F.countDistinct("campaign_id").alias("campaigns"))


def leakage_checks(spark, sf):
    cases = corpus.import_cases(_raw_rows(spark, sf), "generic", "lab", row_number="doc_id")
    moved = cases.withColumn("split", F.when(F.dayofmonth("observed_at") % 2 == 0, "tuning")
                             .otherwise("validation"))
    return corpus.leakage(moved).withColumn("time_cut_broken", F.col("time_cut_broken").cast("int"))


def _results(spark, sf):
    """Verdicts of the messages against the labels."""
    labels = table(spark, sf, "labels").select(
        F.concat(F.lit("m"), "doc_id").alias("id"),
        F.when(F.col("toxic") == 1, "scam").otherwise("legitimate").alias("label"),
        F.when(F.col("toxic") == 1, "estafa").otherwise("no_puedo_confirmarlo").alias("expected_level"),
        F.when(F.col("quality") == 1, "good").alias("lure"),
        F.array(F.lit("requested_action"), F.lit("urgency_language")).alias("required_signals"))
    cases = labels.join(messages(spark, sf).select(
        F.col("message_id").alias("id"), F.col("lang").alias("language"),
        F.concat(F.lit("s"), F.col("doc_id") % 3).alias("scam_type"),
        F.when(F.col("doc_id") % 2 == 0, "tuning").otherwise("validation").alias("split")), "id")
    return corpus.evaluate(cases, score.scored(spark, sf))


_RES = {**score.LOCAL, "results": """select d.*, toxic = 1 as scam, level = 'estafa' as flagged,
    level = (case when toxic = 1 then 'estafa' else 'no_puedo_confirmarlo' end) as exact, lang as language,
    's' || (m.doc_id % 3) as scam_type, case when quality = 1 then 'good' end as lure,
    case when m.doc_id % 2 = 0 then 'tuning' else 'validation' end as split
    from decided d join messages m using (message_id) join labels l on l.doc_id = m.doc_id"""}


def gate(spark, sf):
    rows = corpus.gate_metrics(_results(spark, sf), {
        "min_scam_recall": 0.9, "max_false_alarm_rate": 0.1, "min_exact_agreement": 0.9})
    return rows.withColumn("passed", F.col("passed").cast("int"))


_GATE = """select count(*) as total, count_if(scam) as scam_total, count_if(not scam) as non_scam_total,
  count_if(scam and flagged) as true_positives, count_if(not scam and flagged) as false_alarms,
  count_if(exact) as exact_matches, round(count_if(scam and flagged) / count_if(scam), 4)::double as scam_recall,
  round(count_if(not scam and flagged) / count_if(not scam), 4)::double as false_alarm_rate,
  round(count_if(exact) / count(*), 4)::double as exact_agreement,
  (count_if(scam and flagged) / count_if(scam) >= 0.9 and count_if(not scam and flagged) / count_if(not scam) <= 0.1
    and count_if(exact) / count(*) >= 0.9)::int as passed from results"""


def slices(spark, sf):
    return corpus.slice_metrics(_results(spark, sf))


_SLICES = """select dimension, value, count(*) as total,
  round(case when count_if(scam) > 0 then count_if(scam and flagged) / count_if(scam) end, 4)::double as scam_recall,
  round(case when count_if(not scam) > 0 then count_if(not scam and flagged) / count_if(not scam) end, 4)::double
    as false_alarm_rate, round(count_if(exact) / count(*), 4)::double as exact_agreement
from (select *, unnest(['language', 'scam_type', 'lure', 'split']) as dimension,
    unnest([language, scam_type, lure, split]) as value from results) where value is not null group by 1, 2"""


def missing_signals(spark, sf):
    return corpus.missing_signals(_results(spark, sf)).select(
        "id", F.array_join("missing_required_signals", "|").alias("missing"))


_MISSING = """select * from (select message_id as id, array_to_string(list_filter(['requested_action', 'urgency_language'],
    lambda s: not list_contains(names, s)), '|') as missing
  from results join (select message_id, list(distinct check_name) as names from hits group by 1) using (message_id))
  where missing <> ''"""


def benchmark(spark, sf):
    return corpus.benchmark(_results(spark, sf))


_PCT = """round(coalesce(100.0 * tp / nullif(tp + fn, 0), 0), 4)::double as recall_pct,
  round(coalesce(100.0 * fp / nullif(fp + tn, 0), 0), 4)::double as false_positive_pct,
  round(coalesce(100.0 * tp / nullif(tp + fp, 0), 0), 4)::double as precision_pct,
  round(coalesce(200.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 4)::double as f1_pct"""
_BENCH = f"""select tp, fn, fp, tn, {_PCT}, round(coalesce(100.0 * tn / nullif(fp + tn, 0), 0), 4)::double as specificity_pct,
  round(100.0 * (tp + tn) / (tp + fn + fp + tn), 4)::double as accuracy_pct from (select count_if(scam and flagged) as tp,
    count_if(scam and not flagged) as fn, count_if(not scam and flagged) as fp, count_if(not scam and not flagged) as tn
    from results)"""


def category_counts(spark, sf):
    return corpus.category_counts(_results(spark, sf), "scam_type")


def threshold_sweep(spark, sf):
    return corpus.threshold_sweep(_results(spark, sf))


_SWEEP = f"""select threshold, tp, fn, fp, tn, {_PCT} from (select threshold,
    count_if(scam and (hard_rule or score >= threshold)) as tp, count_if(scam and not (hard_rule or score >= threshold)) as fn,
    count_if(not scam and (hard_rule or score >= threshold)) as fp,
    count_if(not scam and not (hard_rule or score >= threshold)) as tn
    from results, (select unnest([40, 45, 50, 55, 60, 65, 70, 75, 80]) as threshold) group by 1)"""


def top_signals(spark, sf):
    return corpus.top_signals(evidence.evidence_rows(read_messages(messages(spark, sf), score.WITH_ALIASES)))


def verdict_counters(spark, sf):
    timed = score.scored(spark, sf).withColumn("duration_ms", F.length("body"))
    return corpus.verdict_counters(timed)


def distinct_counts(spark, sf):
    return corpus.distinct_counts(table(spark, sf, "events"), ["event_id", "user_id", "event_type"])


def training_rows(spark, sf):
    """Documents as an e-mail corpus, conversations as an SMS corpus, united."""
    mail = spread(table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id"), "doc_id").select(
        F.lit("").alias("subject"), F.col("text").alias("body"), F.col("toxic").cast("string").alias("Label"),
        "doc_id")
    sms = table(spark, sf, "conversations").select(
        F.col("text").alias("texto"), F.when(F.col("role") == "user", "Ham").when(
            F.col("role") == "assistant", "spam").otherwise("x").alias("etiqueta"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("n"))
    both = corpus.unite(corpus.training_rows(mail, "email", "doc_id"), corpus.training_rows(sms, "sms", "n"))
    return both.groupBy("label").agg(F.count("*").alias("rows"), F.min("digest").alias("first_digest"))


_TRAIN_SRC = """select 'd' || doc_id as message_id, doc_id as ord, text as body, case when toxic = 1 then 'phishing'
    else 'legitimate' end as label, 'mail' as kind from documents join labels using (doc_id)
  union all select 'c' || (conv_id * 1000 + turn), conv_id * 1000 + turn, text, case role when 'user' then 'legitimate'
    when 'assistant' then 'spam' end, 'sms' from conversations"""
_TRAIN = """select label, count(*) as rows, min(digest) as first_digest from (select *, row_number() over (
    partition by kind, digest order by ord) as r from (select *, sha256(lower(trim(regexp_replace(t, {url}, '[ENLACE]', 'g'))))
    as digest from redacted join messages using (message_id) where label is not null and trim(t) <> '')) where r = 1 group by 1"""


def stratified_split(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").cast("string").alias("key"), F.col("toxic").alias("label"))
    return ml.stratified_split(docs, "key", "label").groupBy("label", "part").agg(F.count("*").alias("rows"))


def ngram_counts(spark, sf):
    """Character n-grams of all documents, turns and benchmark items, the vectoriser's terms."""
    texts = [table(spark, sf, name).select("text") for name in ("documents", "conversations", "benchmark")]
    talk = texts[0].unionByName(texts[1]).unionByName(texts[2]).select(F.explode(ml.char_ngrams(F.col("text"))).alias("gram"))
    return talk.groupBy(F.length("gram").alias("size")).agg(
        F.count("*").alias("n"), F.countDistinct("gram").alias("distinct_grams"))


_NGRAMS = """with w as (select ' ' || unnest(string_split_regex(trim(lower(text)), '\\s+')) || ' ' as w from (select text from documents union all
    select text from conversations union all select text from benchmark)),
  g as (select unnest(list_concat(list_concat(
      list_transform(range(1, greatest(length(w) - 1, 2)), lambda i: substr(w, i, 3)),
      case when length(w) > 3 then list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) else [] end),
      case when length(w) > 4 then list_transform(range(1, length(w) - 3), lambda i: substr(w, i, 5)) else [] end)) as gram
    from w)
  select length(gram) as size, count(*) as n, count(distinct gram) as distinct_grams from g group by 1"""


def ranking_measures(spark, sf):
    """Areas under both curves of a score that any engine can repeat: the text's length, with many ties."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.when(F.col("toxic") == 1, "phishing").otherwise("legitimate").alias("label"),
        (F.length("text") % 1001 / F.lit(1000.0)).alias("phishing_probability"))
    return ml.ranking_table(rows)


_RANKING = """with g as (select length(text) % 1001 / 1000.0::double as p, count_if(toxic = 1) as pos,
    count_if(toxic is distinct from 1) as neg from documents join labels using (doc_id) where text is not null group by 1),
  pairs as (select sum(a.pos * b.neg * case when a.p > b.p then 1 when a.p = b.p then 0.5 else 0 end) as won from g a, g b),
  curve as (select *, sum(pos) over (order by p desc) as tp, sum(neg) over (order by p desc) as fp from g)
  select sum(pos)::bigint as positives, sum(neg)::bigint as negatives,
    round(any_value(won)::double / (sum(pos) * sum(neg)), 4) as roc_auc,
    round(sum(pos * (tp / (tp + fp))) / sum(pos), 4) as average_precision from curve, pairs"""


def stix_export(spark, sf):
    """Bundles of a scored batch; it is scored once for its verdicts, links and artifacts."""
    linked = stage_table(score.scored(spark, sf), "scored")  # facts, links and verdicts
    tables = writers.analysis_tables(linked, PEPPER)
    found = stix.observables(tables["extractions"], campaigns.build_artifacts(linked, PEPPER))
    return stix.bundles(tables["verdicts"], found, namespace=uuid.NAMESPACE_URL, system="Vigia")


def stored_analysis(spark, sf):
    """Row counts and digests of the five tables a scored batch is stored as; the batch is scored once for all."""
    tables = writers.analysis_tables(stage_table(score.scored(spark, sf), "scored"), PEPPER)
    return writers.table_digests(tables)


QUERIES = {
    "imported_cases": (imported_cases, sql(
        f"""select case when {_BUCKET} = 0 then 'validation' else 'tuning' end as split, label, lang as language,
          case when label = 'scam' then 'estafa' else 'no_puedo_confirmarlo' end as expected_level,
          count(*) as cases, count(distinct campaign_id) as campaigns from imported where trim(t) <> '' group by 1, 2, 3""",
        extra=_IMPORT)),
    "time_split": (time_split, sql(
        """select split, count(*) as cases, count(distinct campaign_id) as campaigns from (select *,
          case when ts >= timestamp '2024-01-03' then 'validation' else 'tuning' end as split,
          count(distinct case when ts >= timestamp '2024-01-03' then 1 else 0 end) over (partition by campaign_id) as sides
          from imported where trim(t) <> '') where sides = 1 group by 1""", extra=_IMPORT)),
    "leakage_checks": (leakage_checks, sql(
        """select (select count(*) from (select campaign_id from s group by 1 having count(distinct split) > 1)) as leaked_campaigns,
          (select count(*) from (select regexp_replace(lower(t), '[^\\p{L}\\p{N}_]+', '', 'g') from s group by 1
            having count(distinct split) > 1)) as leaked_messages,
          ((select max(ts::date) from s where split = 'tuning') > (select min(ts::date) from s where split = 'validation'))::int
            as time_cut_broken""",
        extra={**_IMPORT, "s": """select *, case when day(ts) % 2 = 0 then 'tuning' else 'validation' end as split
            from imported where trim(t) <> ''"""})),
    "gate": (gate, sql(_GATE, "links", extra=_RES)),
    "slices": (slices, sql(_SLICES, "links", extra=_RES)),
    "missing_signals": (missing_signals, sql(_MISSING, "links", extra=_RES)),
    "benchmark_quality": (benchmark, sql(_BENCH, "links", extra=_RES)),
    "category_counts": (category_counts, sql(
        """select case when scam then 'scam' else 'legitimate' end as label, scam_type, count_if(flagged) as flagged,
          count_if(not flagged) as not_flagged from results group by 1, 2""", "links", extra=_RES)),
    "threshold_sweep": (threshold_sweep, sql(_SWEEP, "links", extra=_RES)),
    "top_signals": (top_signals, sql(
        """select check_name, count(*) as hits, count_if(hard_rule) as hard_hits from hits where weight > 0 group by 1
          order by hits desc, check_name limit 10""", "links", extra=score.EVIDENCE)),
    "verdict_counters": (verdict_counters, sql(
        """select level, message_type, count(*) as analyses, sum(length(body))::bigint as duration_ms
          from decided join typed using (message_id) group by 1, 2""", "links",
        extra={**score.LOCAL, **text_checks.TYPED})),
    "distinct_counts": (distinct_counts, """select count(distinct event_id) as event_id, count(distinct user_id) as user_id,
        count(distinct event_type) as event_type from events"""),
    "training_rows": (training_rows, sql(
        _TRAIN.replace("{url}", lit("(?i)" + ctes.fixed.URL)),
        extra={"messages": _TRAIN_SRC, **text_checks.REDACTED})),
    "stratified_split": (stratified_split, """select toxic as label, case when (r - 1) * 5 < n then 'test' else 'train' end
        as part, count(*) as rows from (select toxic, row_number() over (partition by toxic order by sha256('20260818|' || doc_id)) as r,
          count(*) over (partition by toxic) as n from documents join labels using (doc_id)) group by 1, 2"""),
    "ngram_counts": (ngram_counts, _NGRAMS),
    "ranking_measures": (ranking_measures, _RANKING),
    "stix_export": (stix_export, None),
    "stored_analysis": (stored_analysis, None),
}
