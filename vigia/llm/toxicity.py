"""Toxicity by a weighted finite-state pattern grammar.

Four small transducers read the words of a clause as classes (insult, threat, target, negation, report):
one notes a recent negation, one a recent target, one reported speech, one emits an event at an insult or
threat. Their product is one table: state x class -> next state and event. A clause's events, weighted by
the lexicon entries that fired, are what is scored: an insult that is aimed, plain, negated or reported
counts differently. Lexicon entries (words and word beginnings) and the weights of the events are learned
from labelled rows only, on a bounded sample (``MAX_LABELLED``); seed words of threats, targets, negations
and reports are fixed.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigia.llm.common import LOWER, Prefix, code_points, keyed, per_piece, raw
from vigia.llm.ordinal import bounded_labels

MAX_LABELLED = 10_000
STEMS = (4, 5, 6)
MAX_LEXICON = 5_000

# Word lists in English, German, French and Spanish.
THREATS = ("kill hurt destroy beat punch stab shoot attack die töten umbringen schlagen verletzen vernichten "
           "tuer frapper détruire blesser mourir matar golpear destruir herir morir").split()
TARGETS = "you your yours u he she they du dich dir ihr euch dein tu te toi vous ton ta tú ti usted ustedes tus".split()
NEGATIONS = "not no never isn't aren't don't nicht kein keine nie ne pas jamais aucun nunca jamás sin".split()
REPORTS = ("said says say wrote claimed called quoted sagte schrieb nannte behauptete dit écrit appelle prétend "
           "dijo escribió llamó afirmó").split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
EVENTS = [f"{kind}{aim}{neg}{rep}" for kind in "IT" for aim in ("", "+target") for neg in ("", "+negated")
          for rep in ("", "+reported")]
N_FEATURES = len(EVENTS) + 2

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;\n"]] = True


# ---------------------------------------------------------------- transducers

def countdown(trigger: int, reach: int) -> tuple[int, list[list[int]]]:
    """(states, next state by state and class): remembers ``trigger`` for ``reach`` further words."""
    return reach + 1, [[reach if c == trigger else max(s - 1, 0) for c in range(6)] for s in range(reach + 1)]


def latch(trigger: int) -> tuple[int, list[list[int]]]:
    """Remembers ``trigger`` to the end of the clause."""
    return 2, [[1 if s or c == trigger else 0 for c in range(6)] for s in range(2)]


def compose() -> tuple[list[list[int]], list[list[int]]]:
    """(next state, event or -1) of the product of negation, target and report memories with the matcher."""
    memories = [countdown(NEGATION, 3), countdown(TARGET, 5), latch(REPORT)]
    states = list(itertools.product(*[range(n) for n, _ in memories]))
    number = {s: i for i, s in enumerate(states)}
    after, event = [], []
    for s in states:
        after.append([number[tuple(t[x][c] for x, (_, t) in zip(s, memories))] for c in range(6)])
        context = (1 if s[1] else 0) * 4 + (1 if s[0] else 0) * 2 + s[2]
        event.append([-1, context, 8 + context, -1, -1, -1])
    return after, event


_AFTER, _EVENT = compose()


def run_clause(classes: list[int], weights: list[float], out: np.ndarray) -> None:
    """Adds the weights of the clause's events to ``out``."""
    state = 0
    for c, w in zip(classes, weights):
        if (e := _EVENT[state][c]) >= 0:
            out[e] += w
        state = _AFTER[state][c]


# ---------------------------------------------------------------- lexicon

class Lexicon:
    """Hashes of words and word beginnings with class and weight, sorted for search."""

    def __init__(self, learned: dict[str, float]):
        entries: dict[tuple[int, int], tuple[int, float]] = {}
        for cls, names in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            for name in names:
                entries[(0, self.code(name))] = (cls, 1.0)
        for term, weight in learned.items():  # "stem*" is a beginning, other terms are whole words
            entries[(len(term) - 1, self.code(term[:-1])) if term.endswith("*") else (0, self.code(term))] = (
                INSULT, weight)
        self.by_length = {}
        for length in (0, *STEMS):
            found = sorted((h, c, w) for (n, h), (c, w) in entries.items() if n == length)
            self.by_length[length] = (np.array([f[0] for f in found], np.uint64),
                                      np.array([f[1] for f in found], np.int8),
                                      np.array([f[2] for f in found], np.float64))

    @staticmethod
    def code(term: str) -> int:
        data = LOWER[np.frombuffer(term.encode(), np.uint8)]
        return int(Prefix(data).of(np.array([0]), np.array([len(data)]))[0])

    def classify(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, weight) of each word; the longest entry decides, whole words first."""
        low = LOWER[data]
        prefix, points = Prefix(low), code_points(low)
        begins = np.append(np.flatnonzero((low & 0xC0) != 0x80), len(low))
        cls, weight = np.zeros(len(start), np.int8), np.zeros(len(start))
        for length in (*STEMS, 0):  # later ones overrule
            if length:
                long_enough = np.flatnonzero(points[end] - points[start] >= length)
                keys = prefix.of(start[long_enough], begins[points[start[long_enough]] + length])
            else:
                long_enough, keys = np.arange(len(start)), prefix.of(start, end)
            known, c, w = self.by_length[length]
            if len(known) and len(keys):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[at] == keys
                cls[long_enough[hit]], weight[long_enough[hit]] = c[at[hit]], w[at[hit]]
        return cls, weight


def letter_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = _LETTER[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def clause_features(text: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of event sums for each text, then the number of matched clauses and the largest weight."""
    data, at = raw(text)
    out = np.zeros((len(at) - 1, N_FEATURES))
    start, end, row = letter_runs(data, at)
    cls, weight = lexicon.classify(data, start, end)
    hits = np.flatnonzero((cls == INSULT) | (cls == THREAT))
    if not len(hits):
        return out
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_STOP[data], out=stops[1:])
    clause = stops[start] + row  # both grow along the text, so each clause has a number of its own
    left = np.searchsorted(clause, clause[hits], "left")
    for a in np.unique(left):
        b = int(np.searchsorted(clause, clause[a], "right"))
        r = row[a]
        run_clause(cls[a:b].tolist(), weight[a:b].tolist(), out[r, :len(EVENTS)])
        out[r, -2] += 1
        out[r, -1] = max(out[r, -1], weight[a:b][cls[a:b] == INSULT].max(initial=0.0))
    return out


# ---------------------------------------------------------------- learning

_WORDS = re.compile(r"[a-zA-Z'\u0080-\U0010ffff]+")


def term_counts(rated: DataFrame) -> DataFrame:
    """(term, toxic documents, other documents) over (text, toxic): words and word beginnings."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        counts: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = {w.translate(_ASCII_LOWER) for w in _WORDS.findall(text or "")}
            for term in words.union(*({w[:n] + "*" for w in words if len(w) >= n} for n in STEMS)):
                counts.setdefault(term, [0, 0])[0 if toxic else 1] += 1
        if not counts:
            return None
        return pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array([c[0] for c in counts.values()]),
                                pa.array([c[1] for c in counts.values()])], names=["term", "t", "n"])

    return per_piece(rated, "term string, t long, n long", work).groupBy("term").agg(
        F.sum("t").alias("t"), F.sum("n").alias("n"))


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def learn_lexicon(rated: DataFrame) -> dict[str, float]:
    """Terms whose documents are toxic far more often than chance allows, with their log-odds. The bar is a
    likelihood ratio above the logarithm of the number of terms tried, so that chance finds pass nowhere."""
    counts = term_counts(rated)
    t_all, n_all = rated.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    if not t_all or not n_all:
        return {}
    prior = t_all / (t_all + n_all)
    p = F.col("t") / (F.col("t") + F.col("n"))
    gain = F.col("t") * F.log(p / prior) + F.when(F.col("n") > 0, F.col("n") * F.log((1 - p) / (1 - prior))).otherwise(0)
    odds = F.log(((F.col("t") + 0.5) / (t_all + 1)) / ((F.col("n") + 0.5) / (n_all + 1)))
    kept = (counts.where("t >= 3").withColumn("p", p).where(F.col("p") > min(0.5, 3 * prior))
            .select("term", gain.alias("gain"), odds.alias("odds"))
            .orderBy(F.desc("gain"), "term").limit(MAX_LEXICON).collect())
    bar = math.log(max(10, (t_all + n_all) * 100)) + 3
    return {r["term"]: float(r["odds"]) for r in kept if r["gain"] >= bar}


def shrink(x: np.ndarray) -> np.ndarray:
    return np.log1p(x)


def fit_events(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic weights and bias by Newton steps."""
    a = np.hstack([shrink(x), np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 0.5 * (1 + np.tanh(a @ w / 2))
        grad = a.T @ (p - y) + 0.1 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(hess, grad)
    return w


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: pa.Array) -> np.ndarray:
        x = shrink(clause_features(text, self.lexicon))
        return 0.5 * (1 + np.tanh((x @ self.weights[:-1] + self.weights[-1]) / 2))


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> ToxicityModel:
    """``docs`` (doc_id, text), ``labels`` (doc_id, toxic 0/1; null labels are left out)."""
    picked = bounded_labels(labels.where("toxic in (0, 1)").select(
        F.col("doc_id").cast("long"), F.col("toxic").cast("int")), limit)
    rated = docs.join(F.broadcast(picked), "doc_id").select("text", "toxic")
    lexicon = Lexicon(learn_lexicon(rated))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = clause_features(batch.column("text"), shared.value)
        return pa.record_batch([batch.column("toxic"), pa.FixedSizeListArray.from_arrays(
            pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))], names=["toxic", "x"])

    got = per_piece(rated, "toxic int, x array<double>", work).toArrow().combine_chunks()
    if not got.num_rows:
        return ToxicityModel(lexicon, np.zeros(N_FEATURES + 1))
    x = np.asarray(got.column("x").combine_chunks().flatten()).reshape(-1, N_FEATURES)
    return ToxicityModel(lexicon, fit_events(x, np.asarray(got.column("toxic")).astype(float)))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row. Null and empty texts match nothing and get the score of no evidence;
    repeated rows score alike; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")))],
                               names=["doc_id", "score"])

    return per_piece(docs, "doc_id long, score double", work)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             folds: int = 5, limit: int = MAX_LABELLED) -> DataFrame:
    """One row for each input row: doc_id, held_out, score, predicted. Rows whose crc32 of the id is a
    multiple of ``folds`` are held out: their labels are never read. A null id is not held out."""
    rows = keyed(docs, id_col, text_col)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == 0, F.lit(False))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    model = train(rows, known.where(~held), limit)
    return score_documents(rows, model).select(
        "doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
