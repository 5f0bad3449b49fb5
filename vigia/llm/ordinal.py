"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds t1 < t2 < ... turn a
text's score s into tail probabilities P(grade >= k) = sigmoid(s - tk), whose sum is the expected grade.
Features are hashed words, hashed word shapes and bins of document measures, with logarithmic counts and
unit length. The fit takes a bounded sample of labelled rows (``MAX_LABELLED``); scoring is one pass over all
documents, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigia.llm.common import LOWER, Prefix, mix, per_piece, pieces, raw, word_spans
from vigia.llm.ngrams import base_measures

FEATURES = 1 << 18
MAX_LABELLED = 8_000  # at most about so many labelled rows are fitted on
ROUNDS, RATE, RIDGE = 120, 0.25, 1e-4


def _shapes() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[97:123] = out[128:] = 97  # small and non-ASCII letters
    out[65:91] = 65
    out[48:58] = 48
    return out


_SHAPE = _shapes()


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of every non-zero feature; each row's values have unit length."""
    data, at = raw(text)
    n = len(at) - 1
    start, end, row = word_spans(data, at)
    words = Prefix(LOWER[data]).of(start, end)
    shape = _SHAPE[data]
    turns = np.ones(len(data), bool)
    turns[1:] = shape[1:] != shape[:-1]
    turns[start] = True
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(turns, out=before[1:])
    shapes = Prefix(shape[turns]).of(before[start], before[end]) ^ np.uint64(0x5A5A5A5A5A5A5A5A)
    n_words, chars, marks, dup_lines, repeat = base_measures(text)
    some = np.maximum(n_words, 1)
    bins = [np.log2(n_words + 1), 10 * repeat / some, 2 * chars / some, 20 * marks / np.maximum(chars, 1),
            np.log2(dup_lines + 1)]
    binned = [mix(np.minimum(b, 255).astype(np.uint64) + np.uint64((k + 1) << 32)) for k, b in enumerate(bins)]
    rows = np.concatenate([row, row, *[np.arange(n)] * len(bins)])
    keys = np.concatenate([words, shapes, *binned]) & np.uint64(FEATURES - 1)
    kinds, count = np.unique(rows.astype(np.int64) * FEATURES + keys.astype(np.int64), return_counts=True)
    row, key = kinds // FEATURES, kinds % FEATURES
    value = np.log1p(count)
    length = np.sqrt(np.bincount(row, weights=value * value, minlength=n))
    return row, key, value / length[row]


def scores(text: pa.Array, weights: np.ndarray) -> np.ndarray:
    row, key, value = features(text)
    return np.bincount(row, weights=weights[key] * value, minlength=len(text))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


class OrdinalModel:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @staticmethod
    def fit(at: np.ndarray, key: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> "OrdinalModel":
        """Adam on the mean negative log-likelihood of P(grade = k) = tail(k) - tail(k + 1). Thresholds are
        a first value and positive steps, so their order cannot break. Row i has the features ``at[i]`` to
        ``at[i + 1]``; a round takes the rows in parts, so its temporaries stay small."""
        parts = [(a, b, at[a], at[b]) for a, b in _row_parts(at)]
        n = max(len(grade), 1)
        tail = np.array([(np.sum(grade >= k) + 1) / (n + 2) for k in range(1, grades)])
        start = -np.log(tail / (1 - tail))
        theta = np.concatenate([np.zeros(FEATURES), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, ROUNDS + 1):
            w, cut = theta[:FEATURES], np.cumsum(np.concatenate([theta[FEATURES:FEATURES + 1],
                                                                 np.exp(theta[FEATURES + 1:])]))
            s = np.zeros(len(grade))
            for a, b, i, j in parts:
                row = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(at[a:b + 1]))
                s[a:b] = np.bincount(row, weights=w[key[i:j]] * value[i:j], minlength=b - a)
            edge = np.concatenate([[-1e9], cut, [1e9]])
            upper, lower = _sigmoid(s - edge[grade]), _sigmoid(s - edge[grade + 1])
            p = np.maximum(upper - lower, 1e-9)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
            ds = -(du - dl) / n
            dcut = np.zeros(grades - 1)
            for k in range(grades - 1):
                dcut[k] = (du[grade == k + 1].sum() - dl[grade == k].sum()) / n
            slope = RIDGE * w / n ** 0.5
            for a, b, i, j in parts:
                slope += np.bincount(key[i:j], weights=np.repeat(ds[a:b], np.diff(at[a:b + 1])) * value[i:j], minlength=FEATURES)
            grad = np.concatenate([
                slope,
                [dcut.sum()], [dcut[k:].sum() * np.exp(theta[FEATURES + k]) for k in range(1, grades - 1)]])
            m = 0.9 * m + 0.1 * grad
            v = 0.99 * v + 0.01 * grad * grad
            theta = theta - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        cut = np.cumsum(np.concatenate([theta[FEATURES:FEATURES + 1], np.exp(theta[FEATURES + 1:])]))
        return OrdinalModel(theta[:FEATURES].astype(np.float32), cut)


def _row_parts(at: np.ndarray, size: int = 1 << 18) -> list[tuple[int, int]]:
    """Ranges of whole rows with about ``size`` features each; a longer row comes alone."""
    out, start = [], 0
    while start < len(at) - 1:
        end = max(start + 1, int(np.searchsorted(at, at[start] + size, "right")) - 1)
        out.append((start, end))
        start = end
    return out


def bounded_labels(labels: DataFrame, limit: int) -> DataFrame:
    """About ``limit`` labelled rows at most, picked by the hash of their id: the same rows on every run."""
    n = labels.count()
    if n <= limit:
        return labels
    return labels.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * limit / n))


def train(docs: DataFrame, ratings: DataFrame, grades: int, limit: int = MAX_LABELLED) -> OrdinalModel:
    """``docs`` (doc_id, text) and ``ratings`` (doc_id, grade in 0..grades-1); null grades are left out."""
    picked = bounded_labels(ratings.where(f"grade between 0 and {grades - 1}").select(
        F.col("doc_id").cast("long"), F.col("grade").cast("int")), limit)
    rated = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        F.broadcast(picked), "doc_id").select("grade", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, key, value = features(batch.column("text"))
        first = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in
                 (key.astype(np.int32), value.astype(np.float32))]
        return pa.record_batch([batch.column("grade"), *lists], names=["grade", "keys", "values"])

    got = per_piece(rated, "grade int, keys array<int>, values array<float>", work).toArrow().combine_chunks()
    if not got.num_rows:
        return OrdinalModel(np.zeros(FEATURES, np.float32), np.arange(grades - 1) - 1e3)  # keeps everything
    keys, values = got.column("keys").combine_chunks(), got.column("values").combine_chunks()
    fitted = OrdinalModel.fit(np.asarray(keys.offsets).astype(np.int64), np.asarray(keys.flatten()), np.asarray(values.flatten()),
                              np.asarray(got.column("grade")).astype(np.int64), grades)
    del got, keys, values
    pa.default_memory_pool().release_unused()
    return fitted


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the two labels: 0 poor, 1 sound but toxic, 2 sound; null if quality is unknown."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(
        F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2)).alias("grade"))


def score_column(model: OrdinalModel, text: Column, docs: DataFrame) -> Column:
    weights = docs.sparkSession.sparkContext.broadcast(model.weights)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        batch = pa.record_batch([column], names=["text"])
        parts = [scores(p.column("text"), weights.value) for p in pieces(batch, "text")]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return score(text)


def rate(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__tails`` (P(grade >= 1), P(grade >= 2), ...) and ``__expected``, the expected grade.

    Null and empty texts have only the bins of an empty document; repeated rows score alike; columns of any
    other name are kept; an empty table stays empty."""
    scored = docs.withColumn("__s", score_column(model, F.coalesce(F.col(text_col).cast("string"), F.lit("")), docs))
    tails = F.array(*[1 / (1 + F.exp(F.lit(float(t)) - F.col("__s"))) for t in model.thresholds])
    return scored.withColumn("__tails", tails).withColumn("__expected", F.aggregate(
        "__tails", F.lit(0.0), lambda a, x: a + x)).drop("__s")
