"""What a chain of document filters removes in every order, and each filter's fair share of it.

A document is reduced to the set of filters it fails. Counting documents by part and set gives, for each of the
32 coalitions of filters, how many documents it removes (those that fail one of its filters at least); everything
else follows from these 32 numbers. The step that adds filter f to the filters P removes v(P + f) - v(P). The
Shapley values are the solution of a least squares problem: of all additive games with the same total, the one
nearest to v under the Shapley kernel. Its normal equations do not depend on the data, so they are solved once,
in rationals, for every possible right-hand side; times 120 the solution is a matrix of whole numbers.

The text is read once. What is shuffled is a digest, an id and a few bits a row, added up before each shuffle, so
a text that fills a third of the table is no hot key. Defined results: null texts are empty; a null id is neither
smaller nor larger than another, so it never fails E nor makes others fail; rows with the same id and text fail E
only for a smaller id; repeated label rows count as one that has every mark; an empty table gives no rows; very
long texts are handled whole, one row at a time; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, functions as F

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
ORDERS = ["".join(p) for p in permutations(FILTERS)]
WORD_GAP = r"[\x20\x09-\x0D]+"


# ---------------------------------------------------------------- exact constrained least squares

def solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """X with ``matrix`` X = ``right``, by elimination in rationals."""
    rows = [list(a) + list(b) for a, b in zip(matrix, right)]
    n = len(rows)
    for k in range(n):
        pivot = next(i for i in range(k, n) if rows[i][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i in range(n):
            if i != k and rows[i][k]:
                rows[i] = [x - rows[i][k] * y for x, y in zip(rows[i], rows[k])]
    return [row[n:] for row in rows]


def shapley_matrix(n: int) -> list[list[int]]:
    """n! times the linear map from coalition values v(0..2^n - 1) to Shapley values.

    Minimises sum over S of k(S) (v(S) - sum of phi over S)^2 with k(S) = (n - 1) / (C(n, s) s (n - s)), under
    sum of phi = v(all): n normal equations and the constraint with its multiplier, one right-hand side for each
    coalition."""
    full = (1 << n) - 1
    if n == 1:
        return [[-1, 1]]
    inner = [s for s in range(1, full)]
    kernel = {s: Fraction(n - 1, comb(n, b := s.bit_count()) * b * (n - b)) for s in inner}
    has = lambda s, i: s >> i & 1
    left = [[sum((kernel[s] for s in inner if has(s, i) and has(s, j)), Fraction(0)) for j in range(n)] + [Fraction(1)]
            for i in range(n)] + [[Fraction(1)] * n + [Fraction(0)]]
    right = [[kernel[s] * has(s, i) if s in kernel else Fraction(0) for s in range(full + 1)] for i in range(n)]
    right.append([Fraction(int(s == full)) for s in range(full + 1)])
    scaled = [[factorial(n) * x for x in row] for row in solve(left, right)[:n]]
    for row in scaled:  # v(nothing) = 0 in the fit; a game with another start is shifted
        row[0] -= sum(row)
    assert all(x.denominator == 1 for row in scaled for x in row)
    return [[int(x) for x in row] for row in scaled]


# ---------------------------------------------------------------- failures of one row

def text_failures(text: Column) -> Column:
    """Bits 0 to 3: the text fails A (under 100 words), B (100 * distinct < 80 * words), C (100 * capitals > 10 *
    code points), D (holds one of #$%&*|)."""
    words = F.array_remove(F.split(text, WORD_GAP), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bits = [n < 100, F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * F.lit(80).cast("long"),
            capitals * F.lit(100).cast("long") > F.length(text) * F.lit(10).cast("long"), text.rlike(r"[#$%&*|]")]
    return sum((b.cast("int") * F.lit(1 << i) for i, b in enumerate(bits[1:], 1)), bits[0].cast("int"))


def failing_sets(docs: DataFrame, labels: DataFrame, part_col: str = "lang", id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters that they fail."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        text.alias("t"))
            .select("id", "part", F.unhex(F.sha2("t", 256)).alias("digest"), text_failures(F.col("t")).alias("mask"))
            .groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")))
    marks = (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")))
    # ids are unique within a group here, so the rows of the smallest id are known from one
    groups = (rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
              .groupBy("digest", "part", "mask", "good", "toxic")
              .agg(F.min("id").alias("first"), F.min_by("n", "id").alias("n_first"), F.sum("n").alias("n"),
                   F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null")))
    least = groups.groupBy("digest").agg(
        F.min("first").alias("least"), F.collect_list(F.struct("part", "mask", "good", "toxic", "first", "n_first", "n", "n_null")).alias("g"))
    each = least.select("least", F.explode("g").alias("g")).select("least", "g.*")
    fresh = F.col("n_null") + F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    split = each.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), fresh.alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - fresh).alias("n")))).alias("e")).where("e.n > 0")
    return split.groupBy("part", F.col("e.mask").alias("mask")).agg(
        F.sum("e.n").alias("n"), F.sum(F.when(F.col("good"), F.col("e.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("e.n")).otherwise(0)).alias("toxic"))


# ---------------------------------------------------------------- all orders

def coalition_table(sets: DataFrame) -> DataFrame:
    """(part, total, and arrays of 32: removed, good, toxic): what each coalition of filters removes."""
    hit = lambda value, s: F.sum(F.when(F.col("mask").bitwiseAND(s) != 0, F.col(value)).otherwise(0))
    arrays = {name: F.array(*(hit(value, s) for s in range(ALL + 1)))
              for name, value in (("removed", "n"), ("good", "good"), ("toxic", "toxic"))}
    return sets.groupBy("part").agg(F.sum("n").alias("total"), *(a.alias(k) for k, a in arrays.items()))


def interaction_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row for each part, order of the filters and step; see the module's text for the method and odd inputs."""
    table = coalition_table(failing_sets(docs, labels, **columns))
    shares = F.array(*(
        sum((F.col("removed")[s] * F.lit(c).cast("long") for s, c in enumerate(row) if c), F.lit(0).cast("long"))
        for row in shapley_matrix(len(FILTERS))))
    steps = (table.withColumn("shares", shares)
             .withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
             .withColumn("step", F.explode(F.array(*(F.lit(k) for k in range(1, len(FILTERS) + 1))))))
    place = [F.instr("filter_order", f) for f in FILTERS]
    before = sum(((p < F.col("step")).cast("int") * F.lit(1 << i) for i, p in enumerate(place)), F.lit(0))
    own = sum(((p == F.col("step")).cast("int") * F.lit(i) for i, p in enumerate(place)), F.lit(0))
    steps = steps.withColumns({"__p": before, "__f": own}).withColumn("__bit", F.expr("shiftleft(1, __f)"))
    value = lambda name, at: F.col(name)[at]
    after, bit = F.col("__p") + F.col("__bit"), F.col("__bit")
    gain = lambda name: value(name, after) - value(name, F.col("__p"))
    return steps.select(
        "part", "filter_order", "step", (F.col("total") - value("removed", after)).alias("kept"),
        gain("removed").alias("removed"), (value("removed", bit) - gain("removed")).alias("redundant"),
        (F.col("removed")[ALL] - value("removed", F.lit(ALL) - bit)).alias("unique_fails"),
        gain("good").alias("good_lost"), gain("toxic").alias("toxic_lost"),
        F.col("shares")[F.col("__f")].alias("shapley"))
