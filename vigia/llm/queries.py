"""The operators' queries over the given tables, and SQL where SQL can say the same."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigia.llm import audit, exact, mixing, ngrams, ordinal, repeats, shards, similar, tokens, topk, toxicity, turntrie, urlrules
from vigia.llm.common import table

# ---------------------------------------------------------------- 1 quality rules


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures, perplexity band and verdict of every document."""
    return ngrams.quality_rules(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 2 pieces

#: Folder of public tokenizer files; read by the driver only.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE_FILE = "piece_bpe_32k.model"


def vocabulary() -> tokens.Vocabulary:
    with open(os.path.join(TOKENIZERS, PIECE_FILE), "rb") as file:
        return tokens.Vocabulary(file.read())


def encoded_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: token count, chunks, digest of the ids, and whether they decode to the text."""
    v = vocabulary()
    rows = tokens.encode(docs, v)
    checked = rows.select(
        "row_no", "doc_id", "chunk", F.size("ids").alias("n"), F.xxhash64("chunk", "ids").alias("h"),
        (F.crc32(tokens.decode_column(v, rows)) == F.col("source_crc")).alias("same"))
    return checked.groupBy("row_no", "doc_id").agg(
        F.sum("n").alias("n_tokens"), (F.max("chunk") + 1).alias("n_chunks"), F.bit_xor("h").alias("ids_digest"),
        F.bool_and("same").alias("round_trip")).drop("row_no")


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return encoded_documents(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 3 mixing

MIX_SEED, MIX_EPOCHS, MIX_PERCENT = 7, 3, 60
MIX_DOMAINS = {"crawl": 30, "reference": 50, "forum": 20}
MIX_LANGS = {"en": 40, "de": 25, "fr": 20, "es": 15}
REFERENCE_SOURCES = ("src1", "src2", "src3", "src4", "src5", "src6")


def _weight(column: str, values: dict[str, int], other: int) -> F.Column:
    out = F.lit(other)
    for name, weight in values.items():
        out = F.when(F.col(column) == name, weight).otherwise(out)
    return out


def mix_weights() -> dict[str, F.Column]:
    """src0 is the crawl, six sources are reference works, the rest forums; sources weigh alike."""
    return {
        "domain_of": F.when(F.col("source") == "src0", "crawl")
        .when(F.col("source").isin(*REFERENCE_SOURCES), "reference").otherwise("forum"),
        "domain": _weight("domain", MIX_DOMAINS, 10), "lang": _weight("lang", MIX_LANGS, 5), "source": F.lit(1)}


def mix_documents(docs: DataFrame) -> DataFrame:
    budget = F.expr(f"all_tokens * {MIX_PERCENT} div 100")
    return mixing.mix(docs, mix_weights(), budget, MIX_SEED, MIX_EPOCHS)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a mix of 60 % of all tokens takes, once for each time it takes them."""
    return mix_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__n_tokens").alias("n_tokens"),
        F.col("__epoch").alias("epoch"), F.col("__budget").alias("leaf_budget"))


def _fill_sql(children: str, parent: str, child: str) -> str:
    """One level of water filling over a table with weight, supply and parent_budget."""
    w = f"partition by {parent} order by ratio, {child} rows between"
    return f"""(select *, case when not is_open then supply when pool_weight > 0
        then least((weight::hugeint * pool // pool_weight)::bigint, supply) else 0 end as budget from (
      select *, first_value(case when is_open then l end ignore nulls) over ({w} unbounded preceding and unbounded following) as pool,
        first_value(case when is_open then heavier end ignore nulls) over ({w} unbounded preceding and unbounded following) as pool_weight
      from (select *, max(o) over ({w} unbounded preceding and current row) as is_open from (
        select *, supply::hugeint * heavier > weight::hugeint * l as o from (
          select *, greatest(parent_budget - coalesce(sum(supply) over ({w} unbounded preceding and 1 preceding), 0), 0)::bigint as l,
            (sum(weight) over ({w} current row and unbounded following))::bigint as heavier
          from (select *, case when weight > 0 then supply / weight else 'infinity'::double end as ratio from {children}))))))"""


def _case(column: str, values: dict[str, int], other: int) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + f" else {other} end"


OP3_SQL = f"""
with d as (select doc_id, lang, source, coalesce(lang, '') as g, coalesce(source, '') as s,
    case when source = 'src0' then 'crawl' when source in {REFERENCE_SOURCES} then 'reference' else 'forum' end as domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n from documents),
leaves as (select domain, g, s, sum(n)::bigint as tokens, (sum(n) * {MIX_EPOCHS})::bigint as supply, 1 as weight from d group by all),
roots as (select domain, 0 as root, sum(supply)::bigint as supply, {_case('domain', MIX_DOMAINS, 10)} as weight,
    (select sum(n)::bigint * {MIX_PERCENT} // 100 from d) as parent_budget from leaves group by domain),
domains as (select domain, budget from {_fill_sql('roots', 'root', 'domain')}),
lang_level as (select l.domain, g, sum(supply)::bigint as supply, {_case('g', MIX_LANGS, 5)} as weight,
    any_value(budget) as parent_budget from leaves l join domains using (domain) group by l.domain, g),
langs as (select domain, g, budget from {_fill_sql('lang_level', 'domain', 'g')}),
leaf_level as (select l.*, k.budget as parent_budget from leaves l join langs k using (domain, g)),
plan as (select domain, g, s, budget, case when tokens > 0 then budget // tokens else 0 end as epochs,
    case when tokens > 0 then budget % tokens else 0 end as rest from {_fill_sql('leaf_level', 'domain, g', 's')}),
placed as (select d.*, budget, epochs, rest,
    md5('{MIX_SEED}:' || epochs || ':' || coalesce(doc_id::varchar, '')) as place from d join plan using (domain, g, s)),
run as (select *, sum(n) over (partition by domain, g, s order by place) as upto from placed),
times as (select *, epochs + case when rest > 0 and upto <= rest then 1 else 0 end as k from run)
select doc_id, domain, lang, source, n as n_tokens, unnest(range(k))::int as epoch, budget::bigint as leaf_budget
from times where k > 0"""

# ---------------------------------------------------------------- 4 url filters

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def _url_rules_sql() -> str:
    fits = " ".join(
        f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}') then '{{}}'"
        .replace("{}", f"{h}{p}") for h, p, _ in sorted(URL_RULES, key=lambda r: (-r[0].count("."), -len(r[1]))))
    verdicts = " ".join(f"when '{h}{p}' then '{v}'" for h, p, v in URL_RULES)
    return f"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r as (select *, case {fits} end as rule from p)
select page_id, host, path, rule, coalesce(case rule {verdicts} end, 'allow') as verdict from r"""


# ---------------------------------------------------------------- 5 repeated passages


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to passages of 400 bytes that start anywhere else."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- 6 similar documents


def op6_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 4-word shingle similarity 0.85."""
    return similar.similar_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id")


# ---------------------------------------------------------------- 7 exact duplicates

def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which row stays for every row of documents."""
    return exact.exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = """
with d as (select doc_id, coalesce(length(text), 0) as n,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as t from documents),
h as (select doc_id, n, sha256(t) as text_sha256 from d)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
  row_number() over w = 1 as kept, text_sha256
from h window w as (partition by text_sha256 order by n desc, doc_id nulls last)"""

# ---------------------------------------------------------------- 8 quality classifier

KEEP_FROM = 0.5  # a document stays if its grade is 1 or more with this probability


def quality_rated(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return ordinal.rate(docs, ordinal.train(docs, ordinal.graded(labels), 3))


def op8_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and verdict of every document."""
    rated = quality_rated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    tails = F.col("__tails")
    return rated.select("doc_id", F.col("__expected").alias("expected_grade"), tails[0].alias("p_grade_1"),
                        tails[1].alias("p_grade_2"), (tails[0] >= KEEP_FROM).alias("kept"))


# ---------------------------------------------------------------- 9 shards


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document in 40 shards of nearly equal bytes."""
    return shards.shard(table(spark, sf_dir, "documents"), 40)


# ---------------------------------------------------------------- 10 toxicity


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ---------------------------------------------------------------- 11 conversation prefixes


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of all rebuilt conversations."""
    return turntrie.conversation_trie(table(spark, sf_dir, "conversations"), rebuilt=True)


OP11_SQL = """
with t as (select conv_id, k, id, words, conv_id - conv_id % 20 as base from (
    select *, row_number() over (partition by conv_id order by turn nulls first, id) as k from (
      select conv_id, turn, sha256(concat(strlen(coalesce(role, ''))::varchar, ':', coalesce(role, ''), coalesce(text, ''))) as id,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as words from conversations where conv_id is not null))),
crc as (select list(e order by n) as c from (select n, list_reduce(list_prepend(n, range(8)),
    lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as e from range(256) r(n))),
h as (select conv_id, base, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1),
    lambda i: ascii(substr(conv_id::varchar, i::int, 1))::bigint)), lambda a, d: xor(a >> 8, c[(xor(a, d) & 255) + 1])), 4294967295) % 4 as h
  from (select distinct conv_id, base from t), crc),
own as (select base, max(k) as n from t where conv_id = base group by base),
r as (select h.conv_id, t.k as pos, t.id, t.words from h join t on t.conv_id = h.base where t.k <= h.h
  union all select h.conv_id, t.k - h.h + least(h.h, coalesce(own.n, 0)), t.id, t.words
    from h join t on t.conv_id = h.conv_id left join own on own.base = h.base where t.k > h.h),
m as (select conv_id, 0::bigint as depth, '' as path, 0::bigint as words from h
  union all select conv_id, row_number() over w, string_agg(id, '') over w, words from r
    window w as (partition by conv_id order by pos rows between unbounded preceding and current row)),
n as (select path, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from m group by path),
kids as (select left(path, (depth - 1)::int * 64) as path, count(*) as n_children from n where depth > 0 group by all),
whole as (select conv_id, max(depth) as depth from m group by conv_id),
ends as (select path, sha256(string_agg(m.conv_id::varchar, ',' order by m.conv_id)) as ends from m join whole using (conv_id, depth) group by path),
below as (select left(n.path, d::int * 64) as path, sum(case when kids.path is null then 1 else 0 end) as n_leaves, sum((n_convs - 1) * words) as saved
  from n left join kids using (path), range(0, 10000) r(d) where d <= depth group by all)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves,
  saved::bigint as saved_tokens, coalesce(ends, sha256('')) as ends_sha256
from n join below using (path) left join kids using (path) left join ends using (path)
left join n p on n.depth > 0 and p.path = left(n.path, (n.depth - 1)::int * 64)"""


# ---------------------------------------------------------------- 12 exact search


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best products of every 50th vector with all other vectors."""
    return topk.top_products(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


OP12_SQL = """
with v as (select row_number() over () as row_no, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.row_no, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.row_no <> c.row_no and len(q.e) = len(c.e) where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by row_no order by score desc, vec_id nulls last)::int as rank from s) where rank <= 5"""


# ---------------------------------------------------------------- 13 filter audit


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in each of their 120 orders, by language."""
    return audit.interaction_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = """
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as ws, min(doc_id) over (partition by t) as first_id from d),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels group by doc_id),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    len(ws) < 100 as a, 100 * len(list_distinct(ws)) < 80 * len(ws) as b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as d, coalesce(w.doc_id > first_id, false) as e
  from w left join l on w.doc_id = l.doc_id),
g as (select part, concat(case when a then 'A' else '' end, case when b then 'B' else '' end, case when c then 'C' else '' end,
    case when d then 'D' else '' end, case when e then 'E' else '' end) as fails,
    count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select concat(p.x, q.x, r.x, s.x, t.x) as o from letters p, letters q, letters r, letters s, letters t
  where p.x not in (q.x, r.x, s.x, t.x) and q.x not in (r.x, s.x, t.x) and r.x not in (s.x, t.x) and s.x <> t.x),
steps as (select o, k::int as k, substr(o, k::int, 1) as x, substr(o, 1, k::int - 1) as earlier from orders, range(1, 6) r(k)),
m as (select part, o, k, x,
    case when contains(fails, x) then 1 else 0 end as hit,
    case when earlier <> '' and len(translate(fails, earlier, '')) < len(fails) then 1 else 0 end as gone,
    case when fails = x then 1 else 0 end as alone, n, good, toxic from g, steps),
s as (select part, o as filter_order, k as step, x,
    sum(case when hit = 0 and gone = 0 then n else 0 end)::bigint as kept, sum(hit * (1 - gone) * n)::bigint as removed,
    sum(hit * gone * n)::bigint as redundant, sum(alone * n)::bigint as unique_fails,
    sum(hit * (1 - gone) * good)::bigint as good_lost, sum(hit * (1 - gone) * toxic)::bigint as toxic_lost from m group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) over (partition by part, x))::bigint as shapley from s"""


QUERIES = {
    "op1_quality_rules": (op1_quality_rules, None),
    "op2_pieces": (op2_pieces, None),
    "op3_source_mix": (op3_source_mix, OP3_SQL),
    "op4_url_rules": (op4_url_rules, _url_rules_sql()),
    "op5_repeats": (op5_repeats, None),
    "op6_similar": (op6_similar, None),
    "op7_exact_dedup": (op7_exact_dedup, OP7_SQL),
    "op8_quality_grades": (op8_quality_grades, None),
    "op9_sharding": (op9_sharding, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_conversation_trie": (op11_conversation_trie, OP11_SQL),
    "op12_exact_search": (op12_exact_search, OP12_SQL),
    "op13_filter_audit": (op13_filter_audit, OP13_SQL),
}
