"""Conversation trie, exact search and filter audit against brute force, on nulls, ties, repeated rows, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import numpy as np
import pytest

from vigia.llm import audit, topk, turntrie


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


# ---------------------------------------------------------------- conversation trie

def plain_trie(rows, rebuilt):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns[conv].append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in turns.items()}
    if rebuilt:
        new = {}
        for c, seq in own.items():
            h = zlib.crc32(str(c).encode()) % 4
            new[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + seq[h:]
        own = new
    members = defaultdict(list)
    for c, seq in own.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    out = []
    for node, convs in members.items():
        leaves = saved = 0
        todo = [node]
        while todo:
            x = todo.pop()
            leaves += not kids[x]
            saved += (len(members[x]) - 1) * (len(words(x[-1][1])) if x else 0)
            todo += kids[x]
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(own[c]) == len(node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids[node]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n, hot=0):
    rnd, rows = random.Random(seed), []
    for c in range(n):
        length = rnd.choice([1, 1, 2, 3, 5])
        rows += [(c, k, rnd.choice(["user", "bot", None]), rnd.choice(["a b", "c", "", None, "long text here"])) for k in range(length)]
    for c in range(n, n + hot):
        rows += [(c, 0, "system", "same"), (c, 1, "user", "hot turn"), (c, 2, "bot", "reply")]
        rows += [(c, 3, "user", f"q{c % 7}")] if c % 5 == 0 else []
    return rows + [(None, 0, "user", "no id"), (-21, None, "user", "neg"), (-20, 1, "user", "base"), (-20, 2, "bot", "base b")]


CONV = "conv_id long, turn long, role string, text string, key string, id string, words long, base long"


def trie(spark, rows, rebuilt, parts=5):
    df = spark.createDataFrame([(*r, "k", "i", 1, 2) for r in rows], CONV).repartition(parts)
    got = turntrie.conversation_trie(df, rebuilt).collect()
    return sorted((tuple(r) for r in got), key=repr)


@pytest.mark.parametrize("rebuilt", [False, True])
def test_trie_equals_brute_force(spark, rebuilt):
    rows = conversations(3, 120, hot=150)
    assert trie(spark, rows, rebuilt) == plain_trie(rows, rebuilt)


def test_trie_over_many_tasks_blocks_and_pieces(spark, monkeypatch):
    """Tasks see the patched sizes through the module they import; here the functions run on batches directly."""
    import pyarrow as pa
    rows = conversations(4, 60, hot=200)
    keyed = sorted((bytes(r["key"]), r["conv_id"], r["words"]) for r in turntrie.keyed_conversations(
        turntrie.with_borrowed_beginnings(turntrie.turn_keys(spark.createDataFrame(rows, CONV.split(", key")[0])))).collect())
    monkeypatch.setattr(turntrie, "BLOCK_KEYS", 7)
    monkeypatch.setattr(turntrie, "PIECE_TEXT", 200)
    rnd = random.Random(1)
    for tasks in (1, 2, 9, 40):
        cuts = [0, *sorted(rnd.randrange(len(keyed)) for _ in range(tasks - 1)), len(keyed)]
        made = []
        for a, b in zip(cuts, cuts[1:]):
            names = ("key", "conv_id", "words")
            batches = [pa.table({n: [r[i] for r in keyed[j:min(j + 11, b)]] for i, n in enumerate(names)}).to_batches()[0]
                       for j in range(a, b, 11)]
            made += [r for batch in turntrie.task_rows(iter(batches)) for r in batch.to_pylist()]
        edges = sorted((r for r in made if r["kind"] == "edge"), key=lambda r: (r["body"], r["conv_id"]))
        fixes = [r for b in turntrie.corrections(iter([pa.RecordBatch.from_pylist(edges, turntrie.ARROW)])) for r in b.to_pylist()]
        merged = {}
        for r in [r for r in made if r["kind"] == "part"] + fixes:
            m = merged.setdefault(r["ident"], {"conv_id": None, "ends": None, "parent": None, "depth": 0, **dict.fromkeys(("n_convs", "n_children", "n_leaves", "saved"), 0)})
            for c in ("n_convs", "n_children", "n_leaves", "saved"):
                m[c] += r[c]
            m["depth"], m["parent"], m["ends"] = r["depth"], m["parent"] or r["parent"], m["ends"] or r["ends"]
            m["conv_id"] = r["conv_id"] if m["conv_id"] is None else m["conv_id"] if r["conv_id"] is None else min(m["conv_id"], r["conv_id"])
        texts = sorted((r for r in made if r["kind"] == "text"), key=lambda r: (r["ident"], r["conv_id"]))
        if texts:
            for b in turntrie.text_hashes(iter([pa.RecordBatch.from_pylist(texts, turntrie.ARROW)])):
                for r in b.to_pylist():
                    merged[r["ident"]]["ends"] = r["sha"]
        out = [(m["conv_id"], m["depth"], merged[m["parent"]]["conv_id"] if m["parent"] else None, m["n_convs"], m["n_children"], m["n_leaves"],
                m["saved"], m["ends"] or turntrie.EMPTY_SHA) for m in merged.values()]
        out += [(r["conv_id"], r["depth"], merged[r["parent"]]["conv_id"] if r["parent"] else r["parent_conv"], r["n_convs"], r["n_children"],
                 r["n_leaves"], r["saved"], r["ends"] or turntrie.EMPTY_SHA) for r in made if r["kind"] == "node"]
        assert sorted(out, key=repr) == plain_trie(rows, True), tasks


def test_radix_tree_layouts_and_paths():
    rnd = random.Random(2)
    keys = sorted({bytes(rnd.choices(range(rnd.choice([2, 20, 60, 256])), k=rnd.randrange(0, 6))) for _ in range(3000)})
    root = turntrie.Node(b"")
    for k in rnd.sample(keys, len(keys)):
        turntrie.insert(root, k, k)
    found, seen, todo = [], set(), [root]
    while todo:
        node = todo.pop()
        seen.add(node.layout)
        if node.value is not None:
            found.append(node.value)
        todo += reversed(list(node.ordered()))
    assert found == keys and seen == {4, 16, 48, 256}


def test_trie_of_nothing_long_and_turnless(spark):
    assert trie(spark, [], True) == []
    rows = [(20, k, "user", f"turn {k % 3}") for k in range(400)] + [(21, 0, "user", "x " * 200_000), (22, 0, None, None), (22, 0, None, None)]
    for rebuilt in (False, True):
        assert trie(spark, rows, rebuilt) == plain_trie(rows, rebuilt)


# ---------------------------------------------------------------- exact search

def plain_search(rows, step, k):
    fine = [(i, v and [math.floor(256 * float(x)) for x in v], n) for n, (i, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q, qn in fine:
        if qi is None or qi % step:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, v)), i is None, i or 0) for i, v, n in fine if n != qn and len(v) == len(q))
        out += [(qi, r, None if null else i, -s) for r, (s, null, i) in enumerate(found[:k], 1)]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(6, 12))
    rows = []
    for i in range(700):
        v = centres[i % 6] + rnd.normal(size=12) * 0.2
        rows.append((i, [float(x) for x in v * rnd.choice([0.01, 0.3, 1, 4])]))
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(3, rows[3][1]), (3, rows[3][1])]
    rows += [(None, rows[0][1]), (50, None), (100, [1.0, None]), (150, [float("nan")] * 12), (200, []), (250, []), (300, [0.0] * 12),
             (350, [1.0, 2.0]), (400, [float("inf")] * 12)]
    df = spark.createDataFrame([(*r, 0, "s", 1.0) for r in rows], "vec_id long, embedding array<double>, grp int, side string, norm double")
    got = sorted((tuple(r) for r in topk.top_products(df.repartition(3), "vec_id % 50 = 0").collect()), key=repr)
    assert got == plain_search(rows, 50, 5)
    assert topk.top_products(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_each_way_of_pruning_loses_nothing():
    """Blocks and buckets of many lengths: coordinate and length pruning both happen and agree with all products."""
    rnd = np.random.default_rng(6)
    def bucket(body, ids):
        norms = np.sqrt((body ** 2).sum(1))
        order = np.argsort(-norms)
        return topk.Bucket({"dim": body.shape[1], "ids": ids[order].tobytes(), "nulls": np.zeros(len(ids), bool).tobytes(),
                            "rows": ids[order].tobytes(), "norms": norms[order].tobytes(), "thetas": np.full(len(ids), -np.inf).tobytes(),
                            "body": body[order].tobytes()})
    centres = rnd.normal(size=(4, 16))
    centres *= 900 / np.sqrt((centres ** 2).sum(1))[:, None]
    body = np.floor((np.repeat(centres, 200, 0) + rnd.normal(size=(800, 16)) * 150) * rnd.choice([0.3, 0.98, 1, 1.02], size=(800, 1)))
    order = np.argsort(-np.sqrt((body ** 2).sum(1)))
    ids = np.arange(800, dtype=np.int64)
    buckets = [bucket(body[part], ids[part]) for part in np.array_split(order, 10)]
    block = bucket(body[::50], ids[::50])
    calls = Counter()
    real = topk.coordinate_candidates
    def counted(q, b, cosine):
        at = real(q, b, cosine)
        calls["coordinate"] += 1
        calls["left out"] += len(b.rows) - len(at)
        return at
    topk.coordinate_candidates = counted
    try:
        got = topk.search(block, buckets, 5)
    finally:
        topk.coordinate_candidates = real
    table = body[::50] @ body.T
    want = []
    for n, row in enumerate(table):
        found = sorted((-s, i) for i, s in enumerate(row.astype(int)) if i != 50 * n)[:5]
        want += [(50 * n, -s, i) for s, i in found]
    assert sorted((q, s, i) for q, _, s, i, _ in got) == sorted(want)
    assert calls["coordinate"] > 20 and calls["left out"] > 1000


def test_huge_components_stay_exact(spark):
    rows = [(0, [2.0 ** 40, 3.0]), (1, [2.0 ** 22, -5.0]), (2, [-2.0 ** 40, 1.0]), (50, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_products(df, "vec_id % 50 = 0").collect()}
    assert got[0, 1] == 2 ** 63 - 1  # 2^78 in full, held at the end of a long
    assert got[0, 2] == -2 ** 63 and got[0, 50] == 2 ** 63 - 1


# ---------------------------------------------------------------- filter audit

def plain_audit(docs, labels):
    marks = defaultdict(lambda: [0, 0])
    for i, quality, toxic in labels:
        if i is not None:
            marks[i][0] |= quality == 1
            marks[i][1] |= toxic == 1
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = defaultdict(list)
    for i, text, lang in docs:
        t = text or ""
        w = words(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[lang or ""].append(({f for f in fails if fails[f]}, marks[i] if i is not None else [0, 0]))
    out, shares = [], Counter()
    for part, rows in parts.items():
        made = []
        for order in map("".join, permutations("ABCDE")):
            left = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shares[part, f] += len(gone)
                made.append((part, order, step, len(left), len(gone), sum(f in r[0] for r in rows) - len(gone),
                             sum(r[0] == {f} for r in rows), sum(r[1][0] for r in gone), sum(r[1][1] for r in gone), f))
        out += [(*m[:-1], shares[part, m[-1]]) for m in made]
    return sorted(out)


def test_audit_equals_brute_force(spark):
    rnd = random.Random(9)
    long_text = " ".join(f"w{i}" for i in range(130))
    texts = [long_text, long_text + " #", "SHOUT " * 10, long_text.upper(), "a b c", "", None, " \n", "x " * 150, "| & one", "é" * 9 + "A", "w " * 300_000]
    docs = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for i in range(90)]
    docs += [(5, long_text, "en"), (5, long_text, "en"), (None, long_text, "en"), (None, "only without id", "fr")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 1), (None, 1, 1), (9999, 1, 1)]
    df = spark.createDataFrame([(*d, 7, "m", True) for d in docs], "doc_id long, text string, lang string, mask int, digest string, good boolean")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in audit.interaction_audit(df.repartition(3), lab).collect())
    assert got == plain_audit(docs, labels)
    assert audit.interaction_audit(df.limit(0), lab).count() == 0
    assert {r["good_lost"] for r in audit.interaction_audit(df, lab.limit(0)).collect()} == {0}


def test_least_squares_gives_the_mean_over_orders():
    rnd = random.Random(3)
    for n in (1, 2, 3, 4, 5):
        v = [Fraction(rnd.randrange(-50, 50)) for _ in range(1 << n)]
        orders = list(permutations(range(n)))
        for i, row in enumerate(audit.shapley_matrix(n)):
            total = sum(v[before | 1 << i] - v[before] for o in orders for before in [sum(1 << j for j in o[:o.index(i)])])
            assert sum(c * x for c, x in zip(row, v)) == total
