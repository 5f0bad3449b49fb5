"""N-gram Jaccard join by a token-group matrix.

Documents with one shingle set are a class. Classes are partitioned into groups of similar ones, each group
keeps the union of its tokens, a query's overlap with a union bounds its similarity with every member, and
only groups that pass are opened.

1. Seeds: classes that share a minimum under one of several hashes meet their bucket's two leaders, others
   under each hash, so that a family of edited copies is tied together by many texts. Of those pairs, the ones
   with ``AGREE`` equal minima are compared exactly, and connected classes get one label. A bucket of any
   size costs two comparisons a member.
2. Bounds on whole classes, linear in the tokens. Linked sets of different labels share only tokens that
   occur under several labels ("crossing"). A set of n tokens keeps its ``n - o + l`` smallest token hashes
   (o: overlap it needs with any partner, l: one more than a twentieth of n); without l crossing tokens of
   its size among them it has no partner. For the sets that pass, the same is asked of all their tokens: o
   of them must cross. In an edited copy the edits cross nowhere, so most fall out here.
3. The matrix: the remaining sets are partitioned into groups of about ``GROUP``: those of a label with so many
   by label, others by their most widespread crossing token and size, so that a family's scattered members
   share few groups. A token column of a group is set if the token is in a member's prefix, its
   ``n - o + 1`` rarest tokens. Groups without a common column hold no link. For the others each query of one group is bounded by its overlap
   with the other's union, and opens the group only if that reaches o; the exact similarity decides.

Links under one label add nothing to its component, so they are not enumerated; no link between different
labels is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vigia.llm.common import (
    LOWER, BitFilter, Prefix, bit_filter, keep_rows, mix, per_piece, raw, small_batches, stage, word_spans)

SIGNATURES = 8
AGREE = 3
_LOWEST = "min(struct(doc_id is null as none, doc_id, row_no))"
GROUP = 32  # sets of a group
GROUP_TOKENS = 400_000  # and their tokens: long texts make smaller groups
SIZE_STEP = 1.25  # sizes in a group of small labels differ by this factor at most


def token_sets(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of the distinct word shingles of each text, sorted by row and token."""
    data, at = raw(text)
    start, end, row = word_spans(data, at)
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none.astype(np.uint64)
    h = Prefix(LOWER[data]).of(start, end)
    factor = np.uint64(0x9E3779B97F4A7C15)
    n = np.bincount(row, minlength=len(at) - 1)
    first = np.cumsum(n) - n
    rows, tokens = [none], [none.astype(np.uint64)]
    if len(h) >= words:
        token = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            token = mix(token * factor + h[k:len(h) - words + 1 + k] + np.uint64(k))
        whole = np.flatnonzero(row[:len(token)] == row[words - 1:])
        rows.append(row[whole])
        tokens.append(token[whole])
    for r in np.flatnonzero((n > 0) & (n < words)):  # short texts: the whole sequence is the only shingle
        token = np.uint64(n[r])
        with np.errstate(over="ignore"):
            for x in h[first[r]:first[r] + n[r]]:
                token = mix(np.array([token * factor + x + np.uint64(977)], np.uint64))[0]
        rows.append(np.array([r]))
        tokens.append(np.array([token], np.uint64))
    row, token = np.concatenate(rows), np.concatenate(tokens)
    order = np.lexsort((token, row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    return row[new], token[new]


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Overlap that a set of n tokens has at least with any linked one."""
    return -(-percent * n // 100)


def spare(n):
    return 1 + n // 20


def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row for each input row: set key, size, minima under several hashes, and its smallest tokens."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, token = token_sets(batch.column("text"), words)
        size = np.bincount(row, minlength=batch.num_rows).astype(np.int64)
        first = np.cumsum(size) - size
        some = size > 0
        def by_row(values, ufunc):
            out = np.zeros(batch.num_rows, np.uint64)
            if len(values):
                out[some] = ufunc.reduceat(values, first[some])
            return out
        k1 = by_row(mix(token ^ np.uint64(0xA5A5A5A5)), np.add)
        k2 = by_row(mix(token + np.uint64(0x1234567)), np.add)
        minima = [by_row(mix(token ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))), np.minimum)
                  for k in range(SIGNATURES)]
        prints = sum(((m & np.uint64(255)) << np.uint64(8 * k)) for k, m in enumerate(minima))
        keep = np.where(some, size - needed(size, percent) + spare(size), 0)
        keep = np.minimum(keep, size)
        place = np.arange(len(token)) - first[row]
        small = token[place < keep[row]]
        ends = np.concatenate([[0], np.cumsum(keep)]).astype(np.int32)
        signature = pa.FixedSizeListArray.from_arrays(
            pa.array(np.stack(minima, 1).ravel().view(np.int64)), SIGNATURES).cast(pa.list_(pa.int64()))
        return pa.record_batch([
            batch.column("row_no"), batch.column("doc_id"), batch.column("tx"), pa.array(k1.view(np.int64)),
            pa.array(k2.view(np.int64)), pa.array(size), pa.array(prints.view(np.int64)), signature,
            pa.ListArray.from_arrays(pa.array(ends), pa.array(small.view(np.int64)))],
            names=["row_no", "doc_id", "tx", "k1", "k2", "n", "print", "signature", "small"])

    return per_piece(docs, "row_no long, doc_id long, tx long, k1 long, k2 long, n long, print long, "
                           "signature array<long>, small array<long>", work)


def _agreeing(a: str, b: str):
    """How many minima two prints (eight bits of each minimum) have in common."""
    return sum(F.expr(f"cast(((`{a}` ^ `{b}`) >> {8 * k}) & 255 = 0 as int)") for k in range(SIGNATURES))


# ---------------------------------------------------------------- exact comparison

def linked_pairs(a: pa.Array, b: pa.Array, words: int, percent: int) -> np.ndarray:
    """Whether the texts of each pair are linked."""
    ra, ta = token_sets(a, words)
    rb, tb = token_sets(b, words)
    n = len(a)
    sa, sb = np.bincount(ra, minlength=n), np.bincount(rb, minlength=n)
    both = np.concatenate([ra, rb]).astype(np.int64), np.concatenate([ta, tb])
    order = np.lexsort((both[1], both[0]))
    row, token = both[0][order], both[1][order]
    same = (row[1:] == row[:-1]) & (token[1:] == token[:-1])
    shared = np.bincount(row[1:][same], minlength=n)
    return (shared > 0) & (100 * shared >= percent * (sa + sb - shared))


def open_group(p: list[pa.Array], q: list[pa.Array], words: int, percent: int) -> list[tuple[int, int]]:
    """Links between two groups (ids, labels, texts), enough to connect all that are linked. A query of the
    first is bounded by its overlap with the second's token union; where it can reach its need, the second
    is opened and its overlaps with all members are counted along the union's columns."""
    ra, ta = token_sets(p[2], words)
    rb, tb = token_sets(q[2], words)
    ids_a, ids_b = p[0].to_pylist(), q[0].to_pylist()
    label_a, label_b = np.asarray(p[1]), np.asarray(q[1])
    na, nb = np.bincount(ra, minlength=len(ids_a)), np.bincount(rb, minlength=len(ids_b))
    if not len(tb) or not len(ta):
        return []
    union, member = np.unique(tb, return_inverse=True)
    at = np.minimum(np.searchsorted(union, ta), len(union) - 1)
    inside = union[at] == ta
    bound = np.bincount(ra[inside], minlength=len(ids_a))
    first = np.searchsorted(ra, np.arange(len(ids_a) + 1))
    out = []
    for x in np.flatnonzero((na > 0) & (bound >= needed(na, percent))):
        has = np.zeros(len(union), bool)
        mine = slice(first[x], first[x + 1])
        has[at[mine][inside[mine]]] = True
        shared = np.bincount(rb[has[member]], minlength=len(ids_b))
        linked = (shared > 0) & (100 * shared >= percent * (na[x] + nb - shared)) & (label_b != label_a[x])
        out.extend((ids_a[x], ids_b[y]) for y in np.flatnonzero(linked))
    return _spanning(out)


def _spanning(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As many of the pairs as connect what all connect."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            top[x] = y
            out.append((a, b))
    return out


# ---------------------------------------------------------------- components

def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): its component's smallest node, by alternating large
    and small stars. All of it stays in tables; each round is written, so a lost executor costs one round."""
    now = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
                "edges")
    seen = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(
            least.select("a", F.col("m").alias("b"))).distinct()
        now = stage(small, "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return stage(now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("comp"))).distinct(), "components")


# ---------------------------------------------------------------- the join

def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of the wanted (cid, doc_id, tx): a bounded filter leaves the other texts where they are."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tx")).where(_near(wanted.select("tx"), "tx"))
    same = (rows.doc_id.eqNullSafe(wanted.doc_id)) & (rows.tx == wanted.tx)
    return rows.join(wanted, same).select("cid", "text").dropDuplicates(["cid"])


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The linked ones of (a, b)."""
    both = pairs.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("ta")), "a").join(
        texts.select(F.col("cid").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ok = linked_pairs(batch.column("ta"), batch.column("tb"), words, percent)
        return batch.select(["a", "b"]).filter(pa.array(ok))

    return per_piece(both, "a long, b long", work, "ta")


def _near(keys: DataFrame, column: str):
    """Filter column over ``column``: passes all of ``keys``, and few others."""
    shared = keys.sparkSession.sparkContext.broadcast(bit_filter(keys))

    @F.arrow_udf("boolean")
    def near(values: pa.Array) -> pa.Array:
        return pa.array(shared.value.hits(np.asarray(values).view(np.uint64)))

    return near(column)


def _crossing(rows: DataFrame) -> DataFrame:
    """(token) that occur under several labels, from (token, g)."""
    return rows.groupBy("token").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y").select("token")


def _all_tokens(texts: DataFrame, words: int, only: BitFilter | None = None) -> DataFrame:
    """(cid, g, n, token) of every shingle of (cid, g, n, text), or of those in a filter."""
    shared = texts.sparkSession.sparkContext.broadcast(only)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, token = token_sets(batch.column("text"), words)
        if shared.value is not None:
            hit = shared.value.hits(token)
            row, token = row[hit], token[hit]
        owner = pa.array(row)
        return pa.record_batch([*(batch.column(c).take(owner) for c in ("cid", "g", "n")),
                                pa.array(token.view(np.int64))], names=["cid", "g", "n", "token"])

    return per_piece(texts, "cid long, g long, n long, token long", work)


def _links_between(source: DataFrame, sized: DataFrame, words: int, percent: int) -> DataFrame | None:
    """Links between classes of different labels: (a, b). ``sized``: (cid, g, n, doc_id, tx, small)."""
    small = sized.select("cid", "g", "n", F.explode("small").alias("token"))
    crossing = stage(_crossing(small), "crossing")
    votes = small.where(_near(crossing, "token")).join(crossing, "token").groupBy("cid", "n").agg(F.count("*").alias("k"))
    floor = F.expr(f"1 + ({percent} * n + 99) div 100 div 20")
    able = votes.where(F.col("k") >= floor).select("cid")
    wanted = stage(sized.join(able, "cid", "left_semi").select("cid", "g", "n", "doc_id", "tx"), "able")
    if wanted.isEmpty():
        return None
    texts = stage(_texts_of(source, wanted.select("cid", "doc_id", "tx")).join(
        wanted.select("cid", "g", "n"), "cid"), "able_texts")
    shared = stage(_crossing(_all_tokens(texts, words)), "shared")
    # all crossing tokens of each set, and in how many labels they occur
    rows = _all_tokens(texts, words, bit_filter(shared)).join(shared, "token")
    needed_ = F.expr(f"({percent} * n + 99) div 100")
    rich = stage(rows.groupBy("cid", "n").agg(F.count("*").alias("k")).where(F.col("k") >= needed_).select("cid", "k"), "rich")
    rows = stage(rows.join(rich, "cid"), "matrix")
    if rows.isEmpty():
        return None
    spread = rows.groupBy("token", "g").agg(F.lit(1).alias("one")).groupBy("token").agg(F.count("*").alias("labels"))
    # of the tokens that cross, those that still do among the sets left; the others come first in a prefix and join nothing
    own = Window.partitionBy("cid")
    ranked = rows.drop("k").join(stage(spread.where("labels > 1"), "spread"), "token").withColumns({
        "place": F.row_number().over(own.orderBy("labels", "token")), "k": F.count("*").over(own),
        "hot": F.max(F.struct("labels", "token")).over(own)})
    prefix = stage(ranked.where((F.col("k") >= needed_) & (F.col("place") + F.col("n") - F.col("k") <= F.col("n") - needed_ + 1))
                   .select("cid", "g", "n", "token", F.col("hot.token").alias("hot")), "prefix")
    if prefix.isEmpty():
        return None
    members = prefix.groupBy("cid").agg(*[F.first(c).alias(c) for c in ("g", "n", "hot")])
    wide = members.groupBy("g").count().where(F.col("count") >= GROUP).select("g", F.lit(True).alias("wide"))
    alike = F.xxhash64("hot", F.floor(F.log("n") / math.log(SIZE_STEP)))
    members = stage(members.join(wide, "g", "left").select(
        "cid", "n", F.when(F.col("wide"), F.xxhash64("g")).otherwise(alike).alias("bucket")), "members")
    count = members.groupBy("bucket").agg(
        F.ceil(F.greatest(F.count("*") / GROUP, F.sum("n") / GROUP_TOKENS)).alias("parts"))
    parted = stage(members.join(count, "bucket").select(
        "cid", F.xxhash64("bucket", F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("group")), "parted")
    columns = stage(prefix.join(parted, "cid").groupBy("token", "group").agg(
        F.min("g").alias("x"), F.max("g").alias("y"), F.min("n").alias("low"), F.max("n").alias("high")), "columns")
    a, b = columns.alias("a"), columns.alias("b")
    met = a.join(b, F.expr("a.token = b.token and a.group <= b.group")).where(
        (100 * F.col("a.high") >= percent * F.col("b.low")) & (100 * F.col("b.high") >= percent * F.col("a.low"))
        & ~((F.col("a.x") == F.col("a.y")) & (F.col("a.x") == F.col("b.x")) & (F.col("b.x") == F.col("b.y"))))
    met = stage(met.select(F.col("a.group").alias("p"), F.col("b.group").alias("q")).distinct(), "met")
    bodies = stage(texts.join(parted, "cid").groupBy("group").agg(
        F.collect_list("cid").alias("cids"), F.collect_list("g").alias("gs"), F.collect_list("text").alias("texts")), "groups")
    one, two = (bodies.select(F.col("group").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in ("cids", "gs", "texts")])
                for k in "pq")

    def work(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                p = [batch.column(f"p_{c}")[r].values for c in ("cids", "gs", "texts")]
                q = [batch.column(f"q_{c}")[r].values for c in ("cids", "gs", "texts")]
                found = open_group(p, q, words, percent)
                if found:
                    x, y = zip(*found)
                    yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    small_batches(source.sparkSession, 20)
    try:
        return stage(met.join(one, "p").join(two, "q").mapInArrow(work, "a long, b long"), "opened")
    finally:
        small_batches(source.sparkSession)


def similar_components(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_shingles, component_id, kept, row_no, text_xx.

    Sets hold distinct shingles of ``words`` lower-cased (A-Z) words; texts with fewer words have one, of the
    whole sequence; null texts and texts without words have none and are linked with nothing. Two rows are
    linked if 100 * intersection >= ``percent`` * union; component_id is the smallest doc_id reachable (null
    ids count only where a component has no other); kept marks the first row of that id, one in each component. Repeated rows are linked; an empty table gives no rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("doc_id"),
                       F.xxhash64(text).alias("tx"), text.alias("text"))
    all_ = stage(sketches(rows, words, percent), "sketches")
    classes = stage(all_.where("n > 0").groupBy("k1", "k2").agg(F.min("row_no").alias("cid"),
                                                               F.expr(_LOWEST).alias("lowest")), "classes")
    reps = all_.join(classes.select(F.col("cid").alias("row_no")), "row_no", "left_semi").withColumnRenamed("row_no", "cid")
    # grouping by minima
    minima = reps.select("cid", "print", F.posexplode("signature").alias("k", "v"))
    member = F.struct(F.xxhash64("cid", "k").alias("place"), F.col("cid").alias("b"), F.col("print").alias("print_b"))
    leaders = minima.groupBy("k", "v").agg(F.min(member).alias("x"), F.max(member).alias("y"), F.count("*").alias("m")).where(
        "m > 1").select("k", "v", F.inline(F.array("x", "y"))).drop("place")
    pairs = stage(minima.join(leaders, ["k", "v"]).where(F.col("cid") != F.col("b")).where(
        _agreeing("print", "print_b") >= AGREE).select(
        F.greatest("cid", "b").alias("a"), F.least("cid", "b").alias("b")).distinct(), "pairs")
    active = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    wanted = stage(reps.join(active, "cid", "left_semi").select("cid", "doc_id", "tx"), "wanted")
    texts = stage(_texts_of(source, wanted), "texts")
    edges = stage(_verified(pairs, texts, words, percent), "links")
    groups = components(edges)
    # links between labels
    sized = stage(reps.select("cid", "n", "doc_id", "tx", "small").join(
        groups.withColumnRenamed("node", "cid"), "cid", "left").select(
        "cid", F.coalesce("comp", "cid").alias("g"), "n", "doc_id", "tx", "small"), "sized")
    more = _links_between(source, sized, words, percent)
    if more is not None and not more.isEmpty():
        groups = components(edges.unionByName(more))
    member = classes.join(groups.withColumnRenamed("node", "cid"), "cid", "left").withColumn("g", F.coalesce("comp", "cid"))
    lowest = member.groupBy("g").agg(F.min("lowest").alias("first"))
    named = stage(member.join(lowest, "g").select("k1", "k2", "first.doc_id", "first.row_no"), "named")
    first = named.select("k1", "k2", F.col("doc_id").alias("low_id"), F.col("row_no").alias("low_row"))
    empty = F.col("n_shingles") == 0
    return all_.select("doc_id", "row_no", "tx", F.col("n").alias("n_shingles"), "k1", "k2").join(
        first, ["k1", "k2"], "left").select(
        "doc_id", "n_shingles", F.when(empty, F.col("doc_id")).otherwise(F.col("low_id")).alias("component_id"),
        (empty | (F.col("row_no") == F.col("low_row"))).alias("kept"), "row_no", F.col("tx").alias("text_xx"))


def drop_similar(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each component."""
    rows = stage(similar_components(docs, words, percent, id_col, text_col).select(
        "doc_id", "text_xx", "kept", "n_shingles"), "kept")
    repeated = rows.where("n_shingles > 0").groupBy("doc_id", "text_xx").count().where("count > 1")
    return keep_rows(docs, rows.where("kept"), repeated, id_col, text_col)
