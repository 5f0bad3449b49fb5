"""Each operator against a brute-force version, and on nulls, empty texts, ties, repeated rows and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigia.llm import exact, mixing, ngrams, ordinal, queries, repeats, shards, similar, tokens, toxicity, urlrules
from vigia.llm.common import bit_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, token string"
ODD = [(900, None), (901, ""), (902, " \n"), (903, "A b"), (904, "a B"), (905, "x"), (905, "x"), (None, "no id here")]


def frame(spark, docs):
    rows = [(i, t, "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, 0, "g", "t") for k, (i, t) in enumerate(docs)]
    return spark.createDataFrame(rows, SCHEMA)


def texts(seed, n=40):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    line = " ".join(rnd.choice(words) for _ in range(12))
    out = []
    for _ in range(n):
        base = [rnd.choice(words) for _ in range(rnd.randrange(2, 90))]
        for _ in range(rnd.randrange(1, 5)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            out.append((len(out), (line + " " if rnd.random() < 0.4 else "") + " ".join(copy)))
    return out + ODD


def null_last(i):
    return (i is None, i)


# ---------------------------------------------------------------- 1

def test_base_measures_match_a_plain_version():
    cases = ["a b c a b c d", "", "x\nx\n\ny x\nx", "é# é# é#\t**", "one two", "l\n" * 4, "a b c", "q q q q q"]
    got = np.stack(ngrams.base_measures(pa.array(cases)), 1).tolist()
    for text, row in zip(cases, got):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert row == [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
                       len(hit)], text


def test_model_sums_to_one_and_bands_reject(spark):
    rnd = random.Random(1)
    docs = [(i, " ".join(rnd.choice(["th", "an", "er"]) + rnd.choice(["en", "ing", "ou", "ed", "at", "on", "is", "le"]) for _ in range(80))) for i in range(60)]
    docs += [(500, " ".join("".join(rnd.choices("bcdfgjkpqvwxz#%&", k=7)) for _ in range(80)))] + ODD
    df = frame(spark, docs)
    model = ngrams.train(df.select("text"))
    for context in ("the", "zzz", " an"):
        keys = ngrams.grams(*ngrams.symbols(pa.array([context])))[0][-1:]
        every = ((keys & np.uint32((1 << 18) - 1)) << np.uint32(6)) | np.arange(64, dtype=np.uint32)
        assert np.exp(model.logp(every)).sum() == pytest.approx(1, abs=0.05)
    got = {r["doc_id"]: r for r in ngrams.quality_rules(df).collect()}
    assert got[3]["kept"] and not got[500]["kept"] and not got[500]["base_failed"]
    assert got[900]["perplexity"] is None and got[900]["base_failed"]
    assert ngrams.quality_rules(df.limit(0), model=model).count() == 0


def test_senseless_word_order_is_rejected(spark):
    """Texts of real words in random order, and the same in a script without spaces, leave the band."""
    rnd = random.Random(5)
    names = ["".join(rnd.choice(["th", "an", "er", "in", "ou"]) for _ in range(3)) + str(k) for k in range(200)]
    signs = [chr(0x4E00 + 97 * k) for k in range(200)]
    after = list(zip(*(rnd.sample(range(200), 200) for _ in range(3))))  # all words are equally common
    docs = []
    for i in range(240):
        k, walk = rnd.randrange(200), []
        for _ in range(150):
            walk.append(k)
            k = rnd.choice(after[k])
        if i % 40 == 0:
            rnd.shuffle(walk)
        docs.append((i, " ".join(names[k] for k in walk)))
        docs.append((1000 + i, " ".join("".join(signs[k] for k in walk[j:j + 3]) for j in range(0, 150, 3))))
    df = frame(spark, docs).withColumn("lang", F.when(F.col("doc_id") < 1000, "en").otherwise("zh"))
    got = {r["doc_id"]: r for r in ngrams.quality_rules(df).collect()}
    assert not any(r["base_failed"] for r in got.values())
    lost = {i for i, r in got.items() if not r["kept"]}
    assert lost == {i + more for i in range(0, 240, 40) for more in (0, 1000)}


def test_word_model_sums_to_one(spark):
    """Over the words seen after a context and all others by spelling, each half's probabilities stay below
    one and those of seen words make up what the discounts leave."""
    rnd = random.Random(6)
    docs = [(i, " ".join(rnd.choice(["a", "b", "c", "d"]) for _ in range(60))) for i in range(40)]
    df = frame(spark, docs).withColumn("t", F.xxhash64("text"))
    spelling = ngrams.train(df)
    counts = ngrams.count_words(df, spelling).cache()
    seen = counts.join(ngrams.word_model(counts), "gram").where("a <> 0 and b <> 0")
    for r in seen.groupBy("a", "b").agg(F.sum(F.exp("p0")), F.sum(F.exp("p1")), F.count("*")).collect():
        assert r[4] == 4 and 0.97 < r[2] <= 1 + 1e-9 and 0.97 < r[3] <= 1 + 1e-9


# ---------------------------------------------------------------- 2

def lattice_ids(v, text):
    plain = tokens._plain(text)
    return tokens._ids(v, text, tokens.path(tokens.lattice(v, plain, [0], len(plain))[1], len(plain)))


def test_chunks_give_the_whole_texts_pieces_and_decode(spark):
    v, rnd = queries.vocabulary(), random.Random(4)
    cases = ["plain words here, and more of them " * 9, "a" * 500, "".join(rnd.choice("abcdefgh漢é🎉") for _ in range(600)),
             " " * 200 + "end", None, "", "▁ mark ▁▁", "".join(rnd.choice(["the", "ing", " ", "▁", "\n", "aa"]) for _ in range(400))]
    df = frame(spark, list(enumerate(cases)) + [(5, "again"), (5, "again")])
    rows = tokens.encode(df, v, chunk=40)
    back = rows.withColumn("text", tokens.decode_column(v, rows)).collect()
    for i, text in enumerate(cases[:5] + [None] + cases[6:]):
        mine = sorted((r for r in back if r["doc_id"] == i), key=lambda r: r["chunk"])
        if i != 5:
            assert [x for r in mine for x in r["ids"]] == (lattice_ids(v, " " + text) if text else [])
            assert "".join(r["text"] for r in mine) == (text or "")
    assert sum(r["doc_id"] == 5 for r in back) == 3
    assert tokens.encode(df.limit(0), v).count() == 0


# ---------------------------------------------------------------- 3

def test_shortages_go_to_siblings_first(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "1", 5), ("b", "x", "1", 1000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long").selectExpr(
        "*", "1L as n_rows", "1L as w_domain", "1L as w_lang", "1L as w_source")
    got = {tuple(r)[:3]: r["budget"] for r in mixing.leaf_budgets(df, 400, 1).collect()}
    # y lacks 95 of its 100: its sibling x takes them; 1 lacks: its sibling 2 takes it; b keeps its half
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 185, ("a", "y", "1"): 5, ("b", "x", "1"): 200}


def test_mix_is_a_prefix_of_seeded_epochs(spark):
    docs = frame(spark, texts(5))
    mixed = queries.mix_documents(docs).collect()
    assert queries.mix_documents(docs.limit(0)).count() == 0
    per_leaf = defaultdict(list)
    for r in mixed:
        per_leaf[(r["__domain"], r["lang"], r["source"])].append(r)
    for rows in per_leaf.values():
        assert sum(r["__n_tokens"] for r in rows) <= rows[0]["__budget"]
    assert sorted(map(repr, mixed)) == sorted(map(repr, queries.mix_documents(docs.repartition(5)).collect()))


# ---------------------------------------------------------------- 4

def test_longest_rule_wins_in_trie_and_join(spark):
    urls = ["https://a.example.org/es/1?x", "http://example.org/en/17", "http://EXAMPLE.org/en/2", "http://x.com/fr/1",
            "http://x.com/de", "http://x.com/de/", "http://xexample.org/es/", "http://org", "nothing", None, "http://q.net/a#b",
            "http://a.com/fr//x", "://example.org/es/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = queries.URL_RULES
    want = {}
    for i, url in enumerate(urls):
        m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fit, key=lambda r: (r[0].count("."), len(r[1])), default=None)
        want[i] = (host, path, best and best[0] + best[1], best[2] if best else "allow")
    for limit in (1 << 20, 0):
        assert {r[0]: tuple(r)[1:] for r in urlrules.judge_urls(df, rules, max_bytes=limit).collect()} == want
    assert urlrules.judge_urls(df.limit(0), rules).count() == 0


def test_host_only_and_slashless_rules_agree(spark):
    urls = ["http://bad.org", "http://a.bad.org/x/y", "http://bad.org/ok/1", "http://bad.org?q=/ok/", "http://c.net/es/1",
            "http://c.net", "http://d.net/e", "http://notbad.org/", "http:///x", "nothing", None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("bad.org", "", "block"), ("bad.org", "/ok/", "allow"), ("org", "/", "allow"), ("c.net", "es", "block"),
             ("c.net", "es/1", "block"), ("D.net", "", "block")]
    block, ok, none = ("bad.org", "block"), ("bad.org/ok/", "allow"), (None, "allow")
    want = [block, block, ok, block, none, none, ("D.net", "block"), ("org/", "allow"), none, none, none]
    for limit in (1 << 20, 0):
        got = urlrules.judge_urls(df, rules, max_bytes=limit).select("page_id", "rule", "verdict").collect()
        assert [tuple(r)[1:] for r in sorted(got)] == want


# ---------------------------------------------------------------- 5

def brute_repeats(docs, n):
    seen = Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(b[p:p + n] for p in range(len(b) - n + 1))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, int)
        for p in range(len(b) - n + 1):
            if seen[b[p:p + n]] > 1:
                gone[p + 1:p + n + 1] = 1
        kept = bytes(x for x, y in zip(b, gone[1:]) if not y)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [400, 1])
def test_repeats_match_brute_force(spark, most):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcd é") for _ in range(n))
    parts = [word(60) for _ in range(5)]
    docs = [(i, word(rnd.randrange(60)) + rnd.choice(parts)[rnd.randrange(20):] + word(20) + rnd.choice(parts)[:50])
            for i in range(40)]
    docs += [(100, "a" * 200), (101, "ab" * 90), (102, docs[3][1]), (102, docs[3][1])] + ODD
    got = repeats.remove_repeats(frame(spark, docs), 24, gram=8, max_segments=most)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_repeats(docs, 24)


def test_interval_tree_lists_left_diverse_repeats():
    # suffixes: abcx, abcy share 3 and are preceded by different bytes; all three share 2
    tree = repeats.interval_tree([0, 3, 2], [1, 2, 3])
    assert [(t[0], t[1], t[2], t[4]) for t in tree if t[0] > 0] == [(3, 0, 1, True), (2, 0, 2, True)]
    assert not any(t[4] for t in repeats.interval_tree([0, 3], [7, 7]) if t[0] > 0)


# ---------------------------------------------------------------- 6

def brute_components(docs, words, percent):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    top = list(range(len(docs)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                top[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(docs):
        low[root(k)] = min(low.get(root(k), i), i, key=null_last)
    return sorted(((docs[k][0], len(sets[k]), low[root(k)]) for k in range(len(docs))), key=repr)


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_components_match_brute_force(spark, words, percent):
    docs = texts(6, 25)
    got = similar.similar_components(frame(spark, docs), words, percent)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == brute_components(docs, words, percent)
    assert similar.similar_components(frame(spark, docs).limit(0)).count() == 0


def test_matrix_finds_all_links_without_seeds(spark, monkeypatch):
    monkeypatch.setattr(similar, "AGREE", similar.SIGNATURES + 1)
    monkeypatch.setattr(similar, "GROUP", 3)
    docs = texts(7, 25)
    got = similar.similar_components(frame(spark, docs), 5, 80)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=repr) == brute_components(docs, 5, 80)


def test_opened_groups_link_across_labels():
    a, b = ["one two three four five six"], ["one two three four five six", "seven eight nine ten"]
    arrays = lambda ids, labels, t: [pa.array(ids), pa.array(labels), pa.array(t)]
    assert similar.open_group(arrays([1], [1], a), arrays([2, 3], [2, 3], b), 4, 85) == [(1, 2)]
    assert similar.open_group(arrays([1], [1], a), arrays([2, 3], [1, 3], b), 4, 85) == []


# ---------------------------------------------------------------- 7

def test_exact_groups_and_clashing_identifiers(spark):
    docs = texts(7, 20) + [(1000, "a  b"), (1001, "ab"), (1002, "a b "), (1003, "x y" * 9000), (1004, "xy" * 9000)]
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), null_last(i), i))
    want = sorted(((i, min(groups[n])[2], len(groups[n]), hashlib.sha256(n.encode()).hexdigest())
                   for i, t in docs for n in [re.sub(r"[\x20\x09-\x0D]", "", t or "")]), key=repr)
    for bits in (64, 3):  # three bits clash and are widened
        rows = exact.exact_groups(frame(spark, docs), id_bits=bits).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=repr) == want
        assert sum(r["kept"] for r in rows) == len(groups)
    assert exact.drop_copies(frame(spark, docs)).count() == len(groups)
    assert exact.drop_copies(frame(spark, docs).limit(0)).count() == 0


# ---------------------------------------------------------------- 8

def test_ordinal_grades_are_ordered_and_learned(spark):
    rnd = random.Random(8)
    kinds = [["bad!!", "junk!!", "spam%%"], ["fair", "plain", "text"], ["good", "fine", "prose"]]
    docs = [(i, " ".join(rnd.choice(kinds[i % 3]) for _ in range(20))) for i in range(240)]
    df = frame(spark, docs + ODD)
    ratings = spark.createDataFrame([(i, i % 3) for i in range(180)] + [(181, None)], "doc_id long, grade int")
    model = ordinal.train(df, ratings, 3)
    assert model.thresholds[0] < model.thresholds[1]
    rows = {r["doc_id"]: r for r in ordinal.rate(df, model).collect()}
    assert all(round(rows[i]["__expected"]) == i % 3 for i in range(180, 240))
    assert rows[900]["__tails"][0] >= rows[900]["__tails"][1]
    empty = ordinal.train(df, ratings.limit(0), 3)
    assert ordinal.rate(df, empty).where(F.col("__tails")[0] < 0.5).count() == 0


# ---------------------------------------------------------------- 9

def test_capacity_is_the_smallest_and_slots_have_no_gaps(spark, monkeypatch):
    monkeypatch.setattr(shards, "RANGES", 16)
    rnd = random.Random(9)
    sizes = [(rnd.randrange(-(1 << 63), 1 << 63), rnd.randrange(1, 50)) for _ in range(300)]
    cuts, best = shards.minimax_cuts(spark.createDataFrame(sizes, "key long, bytes long"), 7)
    ordered = [b for _, b in sorted(sizes)]

    def fits(capacity):
        used, n = 0, 1
        for b in ordered:
            if b > capacity:
                return False
            used, n = (used + b, n) if used + b <= capacity else (b, n + 1)
        return n <= 7

    assert fits(best) and not fits(best - 1)
    sums = Counter()
    for key, b in sizes:
        sums[sum(c <= key for c in cuts)] += b
    assert max(sums.values()) <= best
    docs = texts(9, 30) * 2
    rows = shards.shard(frame(spark, docs), 5).collect()
    where = defaultdict(set)
    for r in rows:
        where[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values()) and len(rows) == len(docs)
    for s in range(5):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert shards.shard(frame(spark, docs).limit(0), 5).count() == 0


# ---------------------------------------------------------------- 10

def test_grammar_contexts_and_held_out_labels(spark):
    out = np.zeros(len(toxicity.EVENTS))
    T, O, N, R, I = toxicity.TARGET, toxicity.OTHER, toxicity.NEGATION, toxicity.REPORT, toxicity.INSULT
    toxicity.run_clause([O, I], [0, 1.0], out)
    toxicity.run_clause([T, N, I], [0, 0, 1.0], out)
    toxicity.run_clause([R, O, O, O, O, O, I], [0] * 6 + [1.0], out)
    assert {e: w for e, w in zip(toxicity.EVENTS, out) if w} == {"I": 1, "I+target+negated": 1, "I+reported": 1}
    rnd = random.Random(10)
    words = [f"word{chr(97 + i)}" for i in range(20)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(30)) + (" you zorkface. " if i % 4 == 0 else ". ")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(7, None)], "doc_id long, toxic int")
    df = frame(spark, docs + ODD)
    rows = toxicity.toxicity(df, labels).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in rows if r["doc_id"] is not None and r["doc_id"] < 400)
    import zlib
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows if r["doc_id"] is not None)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(df, flipped).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))  # held-out labels are never read


def test_filter_has_no_false_negative(spark):
    keys = [random.Random(3).randrange(-(1 << 63), 1 << 63) for _ in range(500)]
    f = bit_filter(spark.createDataFrame([(k,) for k in keys], "k long"), 1 << 18)
    assert f.hits(np.array(keys, np.int64).view(np.uint64)).all()


def test_pipeline_stages_keep_columns_and_drop_copies(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, step in corpus_pipeline.STAGES[1:3]:
        after = step(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns
        docs = after
    assert docs.groupBy("text").count().where("count > 1").count() == 0
