"""Quality rules with n-gram perplexity, by characters and by words.

The character model is a 4-gram model with interpolated modified Kneser-Ney smoothing over an alphabet of 64
symbols: letters, marks and classes of other characters. It sees spelling and marks, not sense. Spark counts
the 4-grams of all texts; lower orders, continuation counts and discounts follow from those counts by further
grouping. The alphabet bounds it: 64^4 + 64^3 + 64^2 + 64 entries of 8 bytes at most (136 MB), however large
the corpus, so it may be broadcast at any scale. A language's band runs from its lower to its upper perplexity
limit: the median of the log-perplexities of that language's documents, some robust deviations up and down.

The word model counts word trigrams of whole texts, smoothed alike down to single words and then to spelling
by the character model. Its tables grow with the corpus: they stay partitioned and are joined with each text's
own trigrams; nothing of them is broadcast. Texts fall into two halves by their hash (equal texts into the
same one), and each half is scored by the counts of the other, as a text's own rare words would otherwise
vouch for themselves. A language has an upper limit of the word perplexity. Documents outside their
language's limits are rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vigia.llm.common import LOWER, SPACE, code_points, keyed, mix, per_piece, raw, stage, word_spans, Prefix

ORDER, BITS = 4, 6
SPREAD = 7.0        # robust standard deviations on either side of the median
WORD_SPREAD = 5.0   # the same for words, upwards only
LEAST_SPREAD = 0.1   # and never less than this in log-perplexity
_TOP = np.uint32((1 << (BITS * ORDER)) - 1)


def _alphabet() -> np.ndarray:
    """Symbol of each code point below 0x250; 1 is the text's edge, 2 a line break, 3 other white space,
    4 a digit, 5 a capital letter, 6-31 the letters, 32-47 marks, 48-63 other characters by code point."""
    out = np.zeros(0x250, np.uint8)
    for c in range(0x250):
        ch = chr(c)
        if ch in "\n\r":
            out[c] = 2
        elif ch.isspace():
            out[c] = 3
        elif ch.isdigit():
            out[c] = 4
        elif "a" <= ch <= "z":
            out[c] = 6 + c - 97
        elif ch.isupper():
            out[c] = 5
        elif c < 128:
            out[c] = 32 + c % 16
        else:
            out[c] = 48 + c % 16
    return out


_SYMBOL = _alphabet()


def symbols(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all rows, row offsets); each row begins with ``ORDER - 1`` edge symbols."""
    data, at = raw(text)
    lead = data < 0x80
    value = data.astype(np.uint32)
    two, three, four = (data & 0xE0) == 0xC0, (data & 0xF0) == 0xE0, (data & 0xF8) == 0xF0
    follow = np.zeros(len(data) + 3, np.uint32)
    follow[:len(data)] = data & 0x3F
    n = len(data)
    value[two] = ((value & 0x1F) << 6 | follow[1:n + 1])[two]
    value[three] = ((value & 0x0F) << 12 | follow[1:n + 1] << 6 | follow[2:n + 2])[three]
    value[four] = ((value & 0x07) << 18 | follow[1:n + 1] << 12 | follow[2:n + 2] << 6 | follow[3:n + 3])[four]
    begins = lead | two | three | four
    points = code_points(data)[at]
    value = value[begins]
    small = np.minimum(value, 0x24F)
    coded = np.where(value < 0x250, _SYMBOL[small], (48 + value % 16).astype(np.uint8))
    rows = len(at) - 1
    out_at = points + (ORDER - 1) * np.arange(rows + 1)
    out = np.ones(int(out_at[-1]), np.uint8)
    inside = np.ones(len(out), bool)
    for k in range(ORDER - 1):
        inside[out_at[:-1] + k] = False
    out[inside] = coded
    return out, out_at


def grams(coded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed 4-gram that ends at each character, number of characters of each row)."""
    wide = coded.astype(np.uint32)
    keys = np.zeros(len(wide), np.uint32)
    for k in range(ORDER):
        keys[ORDER - 1:] |= wide[k:len(wide) - (ORDER - 1) + k] << np.uint32(BITS * (ORDER - 1 - k))
    inside = np.ones(len(wide), bool)
    for k in range(ORDER - 1):
        inside[at[:-1] + k] = False
    return keys[inside], np.diff(at) - (ORDER - 1)


def count_grams(docs: DataFrame) -> DataFrame:
    """(gram long, n long): counts of all packed 4-grams of all texts; a task sends each gram once a piece."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        coded, at = symbols(batch.column("text"))
        if len(coded) < ORDER:
            return None
        found, n = np.unique(grams(coded, at)[0], return_counts=True)
        return pa.record_batch([pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                               names=["gram", "n"])

    counted = per_piece(docs.select("text"), "gram long, n long", work)
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified smoothing from the counts of counts (Chen and Goodman)."""
    row = counts.agg(*[F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"c{k}") for k in (1, 2, 3, 4)]).first()
    c = [float(x or 0) for x in row]
    if min(c) == 0:
        return 0.5, 1.0, 1.5  # too few kinds of counts to estimate them
    y = c[0] / (c[0] + 2 * c[1])
    return tuple(max(0.0, k - (k + 1) * y * c[k] / c[k - 1]) for k in (1, 2, 3))


def model_table(counts: DataFrame) -> DataFrame:
    """(level, gram, logp, backoff) for all orders: logp is the interpolated log-probability of the gram's
    last symbol after the others; backoff is the log-weight of the gram as a context that lacks a symbol."""
    step = 1 << BITS
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        # continuation count: the number of different symbols that precede the shorter gram
        levels[k] = stage(levels[k + 1].groupBy(F.pmod("gram", F.lit(1 << (BITS * k))).alias("gram"))
                          .agg(F.count("*").alias("n")), f"level{k}")
    lower, out = None, []
    for k in range(1, ORDER + 1):
        d1, d2, d3 = discounts(levels[k])
        less = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        with_context = levels[k].withColumn("context", F.expr(f"gram div {step}"))
        contexts = with_context.groupBy("context").agg(F.sum("n").alias("total"), F.sum(less).alias("kept_back"))
        rows = with_context.join(contexts, "context").withColumn("shorter", F.pmod("gram", F.lit(1 << (BITS * (k - 1)))))
        gamma = F.col("kept_back") / F.col("total")
        own = F.greatest(F.col("n") - less, F.lit(0.0)) / F.col("total")
        if lower is None:
            rows = rows.withColumn("p", own + gamma / step)
        else:
            rows = rows.join(lower.select(F.col("gram").alias("shorter"), F.col("p").alias("p_lower")), "shorter")
            rows = rows.withColumn("p", own + gamma * F.col("p_lower"))
        lower = stage(rows.select("gram", "p"), f"p{k}")
        out.append(lower.select(F.lit(k).alias("level"), "gram", F.log("p").alias("logp")))
        out.append(contexts.select(F.lit(-k).alias("level"), F.col("context").alias("gram"), F.log(
            F.greatest(gamma, F.lit(1e-12))).alias("logp")))
    table = out[0]
    for more in out[1:]:
        table = table.unionByName(more)
    return table


class Model:
    """Sorted gram arrays of each order with log-probabilities, and contexts with their back-off weights."""

    def __init__(self, parts: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.parts = parts

    def look_up(self, level: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams_, values = self.parts.get(level, (np.zeros(0, np.uint32), np.zeros(0, np.float32)))
        if not len(grams_):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        at = np.minimum(np.searchsorted(grams_, keys), len(grams_) - 1)
        return grams_[at] == keys, values[at]

    def logp(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of each 4-gram's last symbol; unseen grams back off to shorter ones."""
        out = np.zeros(len(keys), np.float64)
        todo = np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            shorter = keys[todo] & np.uint32((1 << (BITS * k)) - 1)
            found, value = self.look_up(k, shorter)
            out[todo[found]] += value[found]
            todo, shorter = todo[~found], shorter[~found]
            known, weight = self.look_up(-k, shorter >> np.uint32(BITS))
            out[todo[known]] += weight[known]
        out[todo] -= np.log(1 << BITS)
        return out


def train(docs: DataFrame) -> Model:
    """Count, smooth and store; ``docs`` needs a column ``text``."""
    counts = stage(count_grams(docs), "grams")
    table = stage(model_table(counts).repartitionByRange(8, "level", "gram").sortWithinPartitions("level", "gram"),
                  "model")
    parts: dict[int, list] = {}
    for level in [*range(1, ORDER + 1), *range(-ORDER, 0)]:
        rows = table.where(F.col("level") == level).select(
            F.col("gram").cast("long"), F.col("logp").cast("float")).toArrow()
        keys = rows.column("gram").to_numpy().astype(np.uint32)
        order = np.argsort(keys, kind="stable")
        parts[level] = (keys[order], rows.column("logp").to_numpy()[order])
    return Model(parts)


# ---------------------------------------------------------------- words

_SOLO = np.zeros(256, bool)  # marks that are words by themselves
_SOLO[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'-_"]] = True
#: Code points (by their upper bits, from the seventh) of scripts without spaces: each is a word.
_UNSPACED = ((0x38, 0x42), (0x5E, 0x5F), (0xBA, 0x293), (0x3E4, 0x3EB), (0x3FC, 0x3FF))


def model_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the model's words: runs between spaces, single marks, single unspaced characters."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside, lead = ~SPACE[data], (data & 0xC0) != 0x80
    solo = _SOLO[data] | (data >= 0xF0)
    three = np.flatnonzero((data & 0xF0) == 0xE0)
    upper = (data[three] & 0x0F).astype(np.int64) << 6 | data[np.minimum(three + 1, n - 1)] & 0x3F
    solo[three] = np.any([(upper >= low) & (upper <= high) for low, high in _UNSPACED], axis=0)
    solo = solo[np.flatnonzero(lead)[np.cumsum(lead) - 1]]  # for all bytes of the character
    first = inside & lead
    first[1:] &= ~inside[:-1] | solo[1:] | solo[:-1]
    cut = at[(at > 0) & (at < n)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


class Words:
    """The words of a piece in lower case: hash, row and the two words before each (0 beyond the text's edge)."""

    def __init__(self, text: pa.Array):
        data, self.at = raw(text)
        self.data = LOWER[data]
        self.start, self.end, self.row = model_words(self.data, self.at)
        self.c = Prefix(self.data).of(self.start, self.end)
        self.b, self.a = np.zeros_like(self.c), np.zeros_like(self.c)
        self.b[1:] = np.where(self.row[1:] == self.row[:-1], self.c[:-1], np.uint64(0))
        self.a[2:] = np.where(self.row[2:] == self.row[:-2], self.c[:-2], np.uint64(0))
        k1, k2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        self.gram = mix(mix(mix(self.a * k1 + k2) + self.b * k1) + self.c)

    def spelled(self, which: np.ndarray, model: Model) -> np.ndarray:
        """Log-probability that these words are spelled as they are, between two spaces."""
        kinds, pick, back = np.unique(self.c[which], return_index=True, return_inverse=True)
        if not len(kinds):
            return np.zeros(0)
        take = which[pick]
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.at) - 1, [
            None, pa.py_buffer(self.at.astype(np.int64).tobytes()), pa.py_buffer(self.data.tobytes())])
        coded, points, lead = symbols(text)[0], code_points(self.data), ORDER - 1
        length = points[self.end[take]] - points[self.start[take]]
        out_at = np.concatenate([[0], np.cumsum(length + lead + 1)])
        out = np.zeros(int(out_at[-1]), np.uint8)  # symbol 0 occurs nowhere: the model backs off from it
        out[out_at[:-1] + lead - 1] = out[out_at[1:] - 1] = 3
        of = np.repeat(np.arange(len(take)), length)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
        out[out_at[of] + lead + nth] = coded[(points[self.start[take]] + lead * (self.row[take] + 1))[of] + nth]
        keys, n = grams(out, out_at)
        few, again = np.unique(keys, return_inverse=True)
        return np.bincount(np.repeat(np.arange(len(n)), n), weights=model.logp(few)[again], minlength=len(n))[back]


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def count_words(docs: DataFrame, spelling: Model) -> DataFrame:
    """(gram, a, b, c, n0, n1, spelled): word trigrams a b c of all texts with their counts in both halves."""
    shared = docs.sparkSession.sparkContext.broadcast(spelling)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        half = (batch.column("t").to_numpy() & 1)[words.row]
        kinds, pick, back = np.unique(words.gram, return_index=True, return_inverse=True)
        n = [np.bincount(back, weights=half == k, minlength=len(kinds)).astype(np.int64) for k in (0, 1)]
        return pa.record_batch([_longs(kinds), *(_longs(x[pick]) for x in (words.a, words.b, words.c)),
                                *map(pa.array, n), pa.array(words.spelled(pick, shared.value))],
                               names=["gram", "a", "b", "c", "n0", "n1", "spelled"])

    counted = per_piece(docs.select("t", "text"), "gram long, a long, b long, c long, n0 long, n1 long, "
                        "spelled double", work)
    return counted.groupBy("gram").agg(*[F.first(x).alias(x) for x in "abc"], F.sum("n0").alias("n0"),
                                       F.sum("n1").alias("n1"), F.first("spelled").alias("spelled"))


def _less(counts: DataFrame, k: int) -> F.Column:
    """The discount of a row's count in half ``k``."""
    n, (d1, d2, d3) = F.col(f"n{k}"), discounts(counts.select(F.col(f"n{k}").alias("n")))
    return F.when(n == 0, 0.0).when(n == 1, d1).when(n == 2, d2).otherwise(d3)


def word_model(counts: DataFrame) -> DataFrame:
    """(gram, p0, p1): log-probability of each trigram's last word by the counts of either half.

    What a half has not seen is left to the shorter context, down to the spelling."""
    seen = lambda k: F.sum(F.when(F.col(f"n{k}") > 0, 1).otherwise(0)).alias(f"n{k}")
    both = lambda make: [make(k) for k in (0, 1)]
    spelled = F.first("spelled").alias("spelled")
    levels = {3: counts}
    levels[2] = stage(counts.groupBy("b", "c").agg(*both(seen), spelled), "words2")
    levels[1] = stage(levels[2].groupBy("c").agg(*both(seen), spelled), "words1")
    lower = None
    for k, context, shorter, keys in ((1, [], [], ["c"]), (2, ["b"], ["c"], ["b", "c"]),
                                      (3, ["a", "b"], ["b", "c"], ["gram"])):
        less = both(lambda h: _less(levels[k], h))
        sums = levels[k].groupBy(*context).agg(*both(lambda h: F.sum(f"n{h}").alias(f"total{h}")),
                                               *both(lambda h: F.sum(less[h]).alias(f"kept{h}")))
        rows = levels[k].join(sums, context) if context else levels[k].crossJoin(F.broadcast(sums))
        if lower is not None:
            rows = rows.join(lower.withColumnsRenamed({"p0": "l0", "p1": "l1"}), shorter)

        def log_p(h: int) -> F.Column:
            total = F.col(f"total{h}")
            own = F.when(total > 0, F.greatest(F.col(f"n{h}") - less[h], F.lit(0.0)) / total).otherwise(0.0)
            rest = F.when(total > 0, F.greatest(F.col(f"kept{h}") / total, F.lit(1e-12))).otherwise(1.0)
            below = F.col("spelled") if lower is None else F.col(f"l{h}")
            # a long word's spelling is too improbable for a double: stay with logarithms
            return F.when(own > 0, F.log(own + rest * F.exp(below))).otherwise(F.log(rest) + below).alias(f"p{h}")

        lower = stage(rows.select(*keys, *both(log_p)), f"word_p{k}")
    return lower


def text_scores(docs: DataFrame, spelling: Model) -> DataFrame:
    """(t, word_log_perplexity) of each different text with a word: mean negative log-probability of a character."""
    table = word_model(stage(count_words(docs, spelling), "word_grams"))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        points = code_points(words.data)
        size = points[words.end] - points[words.start] + 1  # the space behind it is spelled too
        order = np.lexsort((words.gram, words.row))
        row, gram, size = words.row[order], words.gram[order], size[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
        at = np.flatnonzero(new)
        n = np.diff(np.append(at, len(row)))
        return pa.record_batch([pa.array(batch.column("t").to_numpy()[row[at]]), _longs(gram[at]),
                                pa.array(n.astype(np.int32)), pa.array((n * size[at]).astype(np.int64))],
                               names=["t", "gram", "n", "size"])

    own = per_piece(docs.select("t", "text"), "t long, gram long, n int, size long", work)
    p = F.when(F.col("t").bitwiseAND(F.lit(1)) == 0, F.col("p1")).otherwise(F.col("p0"))
    # copies of a text add to both sums alike
    return own.join(table, "gram").groupBy("t").agg((-F.sum(p * F.col("n")) / F.sum("size")).alias("word_log_perplexity"))


# ---------------------------------------------------------------- measures

_MEASURES = ("doc_id long, lang string, t long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
             "n_repeat_words long, n_scored long, log_perplexity double")
_SYMBOL_BYTES = np.zeros(256, bool)
_SYMBOL_BYTES[[ord(c) for c in "#*$%&|<>"]] = True


def repeats_by_row(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Marks each item whose (row, key) occurs at least twice."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.lexsort((key, row))
    same = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    out = np.zeros(len(key), bool)
    out[order] = twice
    return out


def base_measures(text: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row."""
    data, at = raw(text)
    n = len(at) - 1
    start, end, row = word_spans(data, at)
    points = code_points(data)
    prefix = Prefix(data)
    words = np.bincount(row, minlength=n)
    chars = np.bincount(row, weights=points[end] - points[start], minlength=n).astype(np.int64)
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL_BYTES[data], out=marks[1:])
    # lines with a word, compared with the lines before them in the same text
    breaks = np.flatnonzero(data == 10)
    firsts = np.unique(np.concatenate([at[:-1][at[1:] > at[:-1]], breaks + 1]))
    firsts = firsts[firsts < len(data)]
    line_row = np.searchsorted(at, firsts, "right") - 1
    lasts = np.minimum(at[line_row + 1], np.append(breaks, len(data))[np.searchsorted(breaks, firsts)])
    solid = np.zeros(len(data) + 1, np.int64)
    if len(start):
        inside = np.zeros(len(data), bool)
        inside[start] = True
        np.cumsum(inside, out=solid[1:])
    full = solid[lasts] > solid[firsts]
    firsts, lasts, line_row = firsts[full], lasts[full], line_row[full]
    line_key = prefix.of(firsts, lasts)
    order = np.lexsort((firsts, line_key, line_row))
    again = (line_row[order][1:] == line_row[order][:-1]) & (line_key[order][1:] == line_key[order][:-1])
    dup_lines = np.bincount(line_row[order][1:][again], minlength=n)
    # words in windows of three that occur twice or more
    covered = np.zeros(len(start), bool)
    if len(start) >= 3:
        h = prefix.of(start, end)
        k1, k2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
        window = (h[:-2] * k1 + h[1:-1]) * k2 + h[2:]
        whole = np.flatnonzero(row[:-2] == row[2:])
        twice = whole[repeats_by_row(row[whole], window[whole])]
        for k in range(3):
            covered[twice + k] = True
    repeat = np.bincount(row[covered], minlength=n)
    return [words.astype(np.int64), chars, marks[at[1:]] - marks[at[:-1]], dup_lines.astype(np.int64),
            repeat.astype(np.int64)]


def measures(docs: DataFrame, model: Model) -> DataFrame:
    """Base measures and mean negative log-probability of each (doc_id, lang, text), by characters and by words."""
    docs = docs.withColumn("t", F.xxhash64("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column("text")
        base = base_measures(text)
        coded, at = symbols(text)
        keys, n = grams(coded, at) if len(coded) >= ORDER else (np.zeros(0, np.uint32), np.diff(at) - (ORDER - 1))
        # a model's rows are few: each different gram of a piece is looked up once
        kinds, which = np.unique(keys, return_inverse=True)
        logp = shared.value.logp(kinds)[which]
        row = np.repeat(np.arange(len(n)), n)
        total = np.bincount(row, weights=logp, minlength=len(n))
        mean = pa.array(-total / np.maximum(n, 1), mask=n == 0)
        return pa.record_batch([*map(batch.column, ("doc_id", "lang", "t")), *map(pa.array, base),
                                pa.array(n.astype(np.int64)), mean],
                               names=[c.split()[0] for c in _MEASURES.split(", ")])

    by_words = stage(text_scores(docs, model), "scores")
    return per_piece(docs, _MEASURES, work).join(by_words, "t", "left").drop("t")


def bands(measured: DataFrame, spread: float = SPREAD, least: float = LEAST_SPREAD) -> DataFrame:
    """(lang, low, high): limits of the log-perplexity of each language, null languages together."""
    scored = measured.where("log_perplexity is not null and n_words >= 50")
    middle = scored.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle"))
    away = scored.alias("s").join(middle.alias("m"), F.expr("s.lang <=> m.lang")).groupBy("s.lang").agg(
        F.first("m.middle").alias("middle"),
        F.percentile_approx(F.abs(F.col("log_perplexity") - F.col("middle")), 0.5, 10000).alias("mad"))
    half = F.greatest(F.lit(spread * 1.4826) * F.col("mad"), F.lit(least))
    return away.select("lang", (F.col("middle") - half).alias("low"), (F.col("middle") + half).alias("high"))


def word_limits(measured: DataFrame, spread: float = WORD_SPREAD, least: float = LEAST_SPREAD) -> DataFrame:
    """(lang, word_high): upper limit of the word log-perplexity of each language, from the median of the
    deviations above the median; copies, which lie far below, do not widen it. There is no lower limit: texts
    whose words follow each other as elsewhere are copies, which deduplication judges."""
    x = F.col("word_log_perplexity")
    scored = measured.where("word_log_perplexity is not null and n_words >= 50")
    middle = scored.groupBy("lang").agg(F.percentile_approx(x, 0.5, 10000).alias("middle"))
    return scored.alias("s").join(middle.alias("m"), F.expr("s.lang <=> m.lang")).where(x >= F.col("middle")).groupBy(
        "s.lang").agg((F.first("middle") + F.greatest(
            F.lit(spread * 1.4826) * F.percentile_approx(x - F.col("middle"), 0.5, 10000), F.lit(least))).alias("word_high"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  model: Model | None = None, spread: float = SPREAD, least: float = LEAST_SPREAD) -> DataFrame:
    """One row for each input row: doc_id, lang, the base measures, perplexity, the band, word
    perplexity and its upper limit, base_failed, kept. A document must lie inside both models' limits.

    All of ``docs`` is counted; ``model`` replaces the character model alone. Both perplexities are a character's.
    Null and empty texts have zero measures, no perplexity and fail the base rules. A null language has its own band. Repeated rows are judged alike;
    other columns are ignored; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text"))
    measured = stage(measures(rows, model or train(rows)), "measures")
    limits = stage(bands(measured, spread, least), "bands")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words = stage(word_limits(measured), "word_limits")
    inside = (F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
              & F.coalesce(F.col("word_log_perplexity") <= F.col("word_high"), F.lit(True)))
    return measured.alias("m").join(limits.alias("b"), F.expr("m.lang <=> b.lang"), "left").join(
        words.alias("w"), F.expr("m.lang <=> w.lang"), "left").select(
        "m.doc_id", "m.lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.exp("log_perplexity").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"),
        F.exp("word_log_perplexity").alias("word_perplexity"), F.exp("word_high").alias("word_high"),
        failed.alias("base_failed"), (~failed & inside).alias("kept"))
