"""Brand indexes against every name beside every brand."""

import random

from pyspark.sql import functions as F

from vigia.functions import urls as ur
from vigia.operators import lookalike


def words(rnd, n):
    parts = ["banco", "caja", "pago", "ing", "net", "sol", "mar", "credi", "fin", "bank", "uno", "telco"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) + rnd.choice(["", "x", "24", "es"]) for _ in range(n)]


def typo(rnd, word):
    word = list(word)
    for _ in range(rnd.randrange(0, 4)):
        at = rnd.randrange(len(word) + 1)
        kind = rnd.random()
        if kind < 0.4 and at < len(word):
            word[at] = rnd.choice("abcxyz")
        elif kind < 0.7:
            word.insert(at, rnd.choice("abcxyz"))
        elif word and at < len(word) and len(word) > 1:
            del word[at]
    return "".join(word)


def test_indexes_lose_nothing_with_thousands_of_brands(spark):
    rnd = random.Random(7)
    tokens = sorted(set(words(rnd, 1_200)) | {"abc", "ab", "x", "añob"})
    texts = sorted({typo(rnd, rnd.choice(tokens)) for _ in range(120)} | {rnd.choice(tokens) + "-" + rnd.choice(tokens) for _ in range(60)} | {"", "a", "añobx"})
    left = spark.createDataFrame([(t,) for t in texts], "text string")
    every = left.crossJoin(spark.createDataFrame([(t,) for t in tokens], "token string"))
    want = {(r["text"], r["token"]) for r in every.where(F.col("text").contains(F.col("token")) & (F.char_length("token") >= 4)).collect()}
    right = spark.createDataFrame([(t,) for t in tokens], "token string")
    got = {tuple(r) for r in lookalike.containing(left, right).collect()}
    assert got == want and len(want) > 100
    for bound in (0.82, 0.6, 0.9):
        near = every.where((F.col("text") != "") & (ur.token_similarity(F.col("text"), F.col("token")) >= bound))
        want = {(r["text"], r["token"]) for r in near.collect()}
        got = {(r["text"], r["label"]) for r in lookalike.resembling(left, right.withColumnRenamed("token", "label"), bound).collect()}
        assert got == want and len(want) > 50


def test_ten_thousand_brands_give_few_candidates(spark):
    """Rows compared by the part index stay far below names times brands."""
    rnd = random.Random(8)
    labels = sorted({"".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(6, 16))) for _ in range(10_000)})
    texts = [typo(rnd, rnd.choice(labels)) for _ in range(2_000)]
    left = spark.createDataFrame([(t,) for t in texts], "text string")
    found = lookalike.resembling(left, spark.createDataFrame([(x,) for x in labels], "label string"), 0.82)
    found.collect()
    joined = [n for n in _numbers(found) if n is not None]
    assert found.count() > 800 and max(joined) < 300_000  # of 20 million pairs; keys of both sides included


def _numbers(df):
    """Output rows of every node of the executed plan."""
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        metrics = node.metrics()
        if metrics.contains("numOutputRows"):
            out.append(metrics.apply("numOutputRows").value())
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        else:
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return out
