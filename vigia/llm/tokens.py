"""SentencePiece encoding and decoding by a max-plus parallel scan.

The pieces of a SentencePiece file are used as a unigram lattice: a text's encoding is the segmentation of
greatest total score, ties going to the earliest start of the last piece. Scores are whole numbers, so sums
are exact at any length. The file at hand has no probabilities but merge ranks, so a piece of rank r scores
-1000 ln(r ln n), the usual Zipf estimate; nothing is trained. Encoding is lossless: unknown characters, and
a literal U+2581, become byte pieces, and decoding returns the text exactly.

Texts up to ``CHUNK`` code points are encoded where they are read. A longer one is cut into chunks that are
processed anywhere: a chunk's transfer matrix gives, for each overhang i of a piece into the chunk and each
overhang j out of it, the best score between (max-plus). Matrices are combined associatively in blocks, then
per text (a Spark string holds at most 2 GB, so at most 2^15 chunks in 2^7 blocks of 2^8: every group is
bounded); prefix vectors give each chunk's best entries, the chunk's back map tells the entry behind each
exit, and composing back maps from the end fixes every boundary. Then each chunk is encoded between its
boundaries, independently of the others.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigia.llm.common import pieces, small_batches, stage

CHUNK = 1 << 16
BLOCK = 256
_SPACE = "▁"
_NONE = -(1 << 60)
_LONG_WORD = 1000  # library sums are exact in 32-bit floats up to here; longer words use the lattice below
_CACHE = 200_000


def _varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes, at: int, end: int):
    """(field number, kind, value or span, place of the value) of a protobuf message."""
    while at < end:
        key, at = _varint(data, at)
        number, kind = key >> 3, key & 7
        place = at
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, start = _varint(data, at)
            value, at = (start, start + size), start + size
        else:
            size = 4 if kind == 5 else 8
            value, at = (at, at + size), at + size
        yield number, kind, value, place


class Vocabulary:
    """Pieces with whole-number scores, and the same file with these scores as a unigram model."""

    def __init__(self, data: bytes):
        out, raw_pieces, places = bytearray(data), [], []
        for number, _, span, _ in _fields(data, 0, len(data)):
            if number == 1:
                text, kind, score_at, kind_at = "", 1, None, None
                for n, k, value, place in _fields(data, *span):
                    if n == 1:
                        text = data[value[0]:value[1]].decode()
                    elif n == 2 and k == 5:
                        score_at = value[0]
                    elif n == 3:
                        kind, kind_at = value, place
                raw_pieces.append((text, kind))
                places.append((score_at, kind_at))
            else:
                for n, _, _, place in _fields(data, *span):
                    if number == 2 and n == 3:
                        out[place] = 1  # model type: unigram
                    elif number == 3 and n == 3:
                        out[place] = 0  # the leading space is ours to add
        usual = [i for i, (_, kind) in enumerate(raw_pieces) if kind in (1, 4)]
        self.text = [t for t, _ in raw_pieces]
        self.score: dict[str, int] = {}
        self.id: dict[str, int] = {}
        factor = math.log(max(len(usual), 3))
        for rank, i in enumerate(usual, 1):
            name, score = self.text[i], -round(1000 * math.log(rank * factor))
            self.score[name], self.id[name] = score, i
            score_at, kind_at = places[i]
            if score_at is not None:
                out[score_at:score_at + 4] = np.float32(score).tobytes()
            if kind_at is not None:
                out[kind_at] = 1
        self.byte = {int(self.text[i][1:-1], 16): i for i, (_, kind) in enumerate(raw_pieces) if kind == 6}
        self.unknown = min(self.score.values()) - 10
        self.longest = max(map(len, self.score))
        self.model = bytes(out)
        # a piece never runs over a blank inside it; texts fall apart before each blank behind a non-blank
        assert not any(_SPACE in t.lstrip(_SPACE) for t in self.score), "pieces with inner blanks"
        values = [t.replace(_SPACE, " ").encode() for t in self.text]
        for value, i in self.byte.items():
            values[i] = bytes([value])
        self.values = values


# ---------------------------------------------------------------- the lattice

def _plain(text: str) -> str:
    """The text as pieces see it: blanks marked, a literal mark unknown."""
    return text.replace(_SPACE, "").replace(" ", _SPACE)


def lattice(v: Vocabulary, text: str, entry: list[int], size: int) -> tuple[list[int], list[int]]:
    """(best score, start of the last piece) at each position of ``text``, for pieces that start before
    ``size``; ``entry``: scores of starting at positions 0, 1, ..."""
    n = len(text)
    best, back = [_NONE] * (n + 1), [-1] * (n + 1)
    for i, e in enumerate(entry[:n + 1]):
        best[i] = e
    score, longest, unknown = v.score, v.longest, v.unknown
    for p in range(min(size, n)):
        f = best[p]
        if f <= _NONE:
            continue
        for q in range(p + 1, min(p + longest, n) + 1):
            s = score.get(text[p:q])
            if s is None:
                if q > p + 1:
                    continue
                s = unknown
            if f + s > best[q]:
                best[q], back[q] = f + s, p
    return best, back


def path(back: list[int], end: int) -> list[int]:
    """Ends of the pieces on the best path to ``end``, and its start in front."""
    out = [end]
    while back[out[-1]] >= 0:
        out.append(back[out[-1]])
    return out[::-1]


def _ids(v: Vocabulary, text: str, ends: list[int]) -> list[int]:
    plain, out = _plain(text), []
    for a, b in zip(ends, ends[1:]):
        i = v.id.get(plain[a:b])
        out.extend([i] if i is not None else [v.byte[x] for x in text[a:b].encode()])
    return out


_WORD = re.compile(f" *[^ \n{_SPACE}]+| +|\n+|{_SPACE}")


class Encoder:
    """Encodes whole segments word by word; words are remembered within a bounded cache."""

    def __init__(self, v: Vocabulary):
        import sentencepiece
        self.v, self.cache = v, {}
        self.library = sentencepiece.SentencePieceProcessor(model_proto=v.model)

    def segment(self, text: str) -> bytes:
        """Piece ids as 32-bit integers; no leading blank is added."""
        words = _WORD.findall(text)
        cache = self.cache
        if len(cache) > _CACHE:
            cache.clear()
        new = [w for w in set(words) if w not in cache]
        short = [w for w in new if len(w) <= _LONG_WORD and w != _SPACE]
        if short:
            for w, ids in zip(short, self.library.encode(short, num_threads=1)):
                cache[w] = np.array(ids, np.int32).tobytes()
        long_ones = {}
        for w in new:
            if w == _SPACE or len(w) > _LONG_WORD:
                back = lattice(self.v, _plain(w), [0], len(w))[1]
                ids = np.array(_ids(self.v, w, path(back, len(w))), np.int32).tobytes()
                (cache if w == _SPACE else long_ones)[w] = ids
        return b"".join([cache[w] if w in cache else long_ones[w] for w in words])


_encoders: dict[int, Encoder] = {}


def encoder(v: Vocabulary) -> Encoder:
    """One encoder for a worker's vocabulary."""
    key = zlib.crc32(v.model)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(v)
    return _encoders[key]


# ---------------------------------------------------------------- chunks

def _cuts(text: str) -> list[int]:
    """Positions that no piece runs over: before a blank behind a non-blank, and around line breaks."""
    return [m.start() for m in re.finditer("(?<=[^ ]) |(?<!^)\n|(?<=\n)[^\n]", text)]


def transfer(v: Vocabulary, text: str, size: int) -> np.ndarray:
    """Max-plus matrix of a chunk of ``size`` code points; ``text`` runs on behind it by the longest piece."""
    width = v.longest
    out = np.full((width, width), _NONE, np.int64)
    plain = _plain(text)
    inner = [c for c in _cuts(text) if 0 < c <= size]
    if not inner:
        for i in range(min(width, size + 1)):
            best, _ = lattice(v, plain, [_NONE] * i + [0], size)
            for j in range(min(width, len(text) - size + 1)):
                out[i, j] = best[size + j]
        return out
    first, last = inner[0], inner[-1]
    middle = 0
    if last > first:
        words = np.frombuffer(encoder(v).segment(text[first:last]), np.int32)
        middle = _score(v, text[first:last], words)
    tail, _ = lattice(v, plain[last:], [0], size - last)
    for i in range(min(width, first + 1)):
        head = lattice(v, plain[i:first], [0], first - i)[0][-1]
        for j in range(min(width, len(text) - size + 1)):
            if tail[size - last + j] > _NONE:
                out[i, j] = head + middle + tail[size - last + j]
    return out


def _score(v: Vocabulary, text: str, ids: np.ndarray) -> int:
    """Total score of an encoded text; the bytes of one unknown character count once."""
    table = np.zeros(len(v.text), np.int64)
    for name, i in v.id.items():
        table[i] = v.score[name]
    is_byte = np.zeros(len(v.text), bool)
    is_byte[list(v.byte.values())] = True
    value = np.zeros(len(v.text), np.int64)
    for b, i in v.byte.items():
        value[i] = b
    bytes_ = value[ids[is_byte[ids]]]
    return int(table[ids].sum()) + v.unknown * int(np.sum((bytes_ & 0xC0) != 0x80))


def back_map(v: Vocabulary, text: str, size: int, entry: list[int]) -> list[int]:
    """For each exit overhang the entry overhang of the best path to it (-1: no path)."""
    plain, width = _plain(text), v.longest
    inner = [c for c in _cuts(text) if 0 < c <= size]
    if inner:
        back = lattice(v, plain[:inner[0]], entry, inner[0])[1]
        start = path(back, inner[0])[0]
        return [start] * width
    best, back = lattice(v, plain, entry, size)
    return [path(back, size + j)[0] if size + j < len(best) and best[size + j] > _NONE else -1 for j in range(width)]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return np.maximum(np.max(a[:, :, None] + b[None, :, :], axis=1), _NONE)


def _matrix(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, np.int64).reshape(width, width)


def boundaries(chunks: DataFrame, v: Vocabulary) -> DataFrame:
    """(row_no, k, enter, leave): overhang into and out of each chunk (row_no, k, size, text)."""
    width = v.longest
    shared = chunks.sparkSession.sparkContext.broadcast(v)

    def matrices(batches):
        for b in batches:
            m = [transfer(shared.value, t, s).tobytes()
                 for t, s in zip(b.column("text").to_pylist(), b.column("size").to_pylist())]
            yield pa.record_batch([b.column("row_no"), b.column("k"), pa.array(m, pa.binary())],
                                  names=["row_no", "k", "m"])

    per_chunk = stage(chunks.mapInArrow(matrices, "row_no long, k int, m binary")
                      .withColumn("block", F.expr(f"k div {BLOCK}").cast("int")), "matrices")

    def block_product(pdf: pd.DataFrame) -> pd.DataFrame:
        ms = [_matrix(m, width) for m in pdf.sort_values("k").m]
        total = ms[0]
        for m in ms[1:]:
            total = combine(total, m)
        return pd.DataFrame({"row_no": [pdf.row_no.iloc[0]], "block": [pdf.block.iloc[0]], "m": [total.tobytes()]})

    def forward(vector: np.ndarray, ms: list[np.ndarray]) -> list[np.ndarray]:
        out = [vector]
        for m in ms:
            out.append(np.maximum(np.max(out[-1][:, None] + m, axis=0), _NONE))
        return out

    def block_entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        start = np.full(width, _NONE, np.int64)
        start[0] = 0
        vs = forward(start, [_matrix(m, width) for m in pdf.m])
        return pd.DataFrame({"row_no": pdf.row_no, "block": pdf.block, "v": [x.tobytes() for x in vs[:-1]]})

    def chunk_entries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        vs = forward(np.frombuffer(pdf.v.iloc[0], np.int64), [_matrix(m, width) for m in pdf.m])
        return pd.DataFrame({"row_no": pdf.row_no, "k": pdf.k, "v": [x.tobytes() for x in vs[:-1]]})

    blocks = per_chunk.groupBy("row_no", "block").applyInPandas(block_product, "row_no long, block int, m binary")
    entries = blocks.groupBy("row_no").applyInPandas(block_entries, "row_no long, block int, v binary")
    vectors = per_chunk.join(entries, ["row_no", "block"]).groupBy("row_no", "block").applyInPandas(
        chunk_entries, "row_no long, k int, v binary")

    def maps(batches):
        for b in batches:
            out = [back_map(shared.value, t, s, np.frombuffer(e, np.int64).tolist()) for t, s, e in zip(
                b.column("text").to_pylist(), b.column("size").to_pylist(), b.column("v").to_pylist())]
            yield pa.record_batch([b.column("row_no"), b.column("k"), pa.array(out, pa.list_(pa.int32()))],
                                  names=["row_no", "k", "back"])

    per_map = stage(chunks.join(vectors, ["row_no", "k"]).select("row_no", "k", "size", "text", "v")
                    .mapInArrow(maps, "row_no long, k int, back array<int>")
                    .withColumn("block", F.expr(f"k div {BLOCK}").cast("int")), "maps")

    def block_map(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.arange(width)
        for back in pdf.sort_values("k", ascending=False).back:  # the exit of the block leads to its entry
            total = np.where(total >= 0, np.asarray(back)[total], -1)
        return pd.DataFrame({"row_no": [pdf.row_no.iloc[0]], "block": [pdf.block.iloc[0]], "back": [total]})

    def block_exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, at, leave = pdf.sort_values("block", ascending=False), 0, []
        for back in pdf.back:
            leave.append(at)
            at = int(back[at])
        return pd.DataFrame({"row_no": pdf.row_no, "block": pdf.block, "out": leave})

    def chunk_exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", ascending=False)
        at, enter, leave = int(pdf.out.iloc[0]), [], []
        for back in pdf.back:
            leave.append(at)
            at = int(back[at])
            enter.append(at)
        return pd.DataFrame({"row_no": pdf.row_no, "k": pdf.k, "enter": enter, "leave": leave})

    block_maps = per_map.groupBy("row_no", "block").applyInPandas(block_map, "row_no long, block int, back array<int>")
    exits = block_maps.groupBy("row_no").applyInPandas(block_exits, "row_no long, block int, out int")
    return per_map.join(exits, ["row_no", "block"]).groupBy("row_no", "block").applyInPandas(
        chunk_exits, "row_no long, k int, enter int, leave int")


_ENCODED = "row_no long, doc_id long, chunk int, source_crc long, ids array<int>"


def _encoded(batch: pa.RecordBatch, texts: list[str], first: list[bool], v: Vocabulary) -> pa.RecordBatch:
    own = encoder(v)
    blobs = [own.segment((" " if f and t else "") + t) for t, f in zip(texts, first)]
    ends = np.cumsum([0, *(len(b) // 4 for b in blobs)]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(blobs), np.int32)))
    crc = pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64())
    return pa.record_batch([batch.column("row_no"), batch.column("doc_id"), batch.column("chunk"), crc, ids],
                           names=[c.split()[0] for c in _ENCODED.split(", ")])


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text",
           chunk: int = CHUNK) -> DataFrame:
    """(row_no, doc_id, chunk, source_crc, ids): piece ids, one row for each text, or for each chunk of a
    text above ``chunk`` code points, in order of ``chunk``. ``row_no`` tells rows of equal ids apart;
    ``source_crc`` is the crc32 of the text that the row encodes. Null and empty texts have one row without
    ids; an empty table gives none; other columns are ignored."""
    if chunk < 2 * vocabulary.longest:
        raise ValueError("chunks must be longer than two pieces")
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    small, large = rows.where(F.length("text") < chunk), rows.where(F.length("text") >= chunk)

    def whole(batches):
        for b in batches:
            b = b.append_column("chunk", pa.array(np.zeros(b.num_rows, np.int32)))
            for p in pieces(b, "text"):
                yield _encoded(p, p.column("text").to_pylist(), [True] * p.num_rows, shared.value)

    longest = vocabulary.longest

    def split(batches):
        for b in batches:
            for r in range(b.num_rows):
                text = " " + b.column("text")[r].as_py()
                for k, at in enumerate(range(0, len(text), chunk)):
                    body = text[at:at + chunk + longest - 1]
                    yield pa.record_batch([[b.column("row_no")[r].as_py()], [b.column("doc_id")[r].as_py()],
                                           pa.array([k], pa.int32()), pa.array([min(chunk, len(text) - at)], pa.int32()),
                                           [body]], schema=pa.schema([
                                               ("row_no", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()),
                                               ("size", pa.int32()), ("text", pa.string())]))

    done = small.mapInArrow(whole, _ENCODED)
    parts = stage(large.mapInArrow(split, "row_no long, doc_id long, k int, size int, text string"), "chunks")
    if parts.isEmpty():
        return done

    def bounded(batches):
        for b in batches:
            texts = [t[a:s + z] for t, a, s, z in zip(*[b.column(c).to_pylist() for c in ("text", "enter", "size", "leave")])]
            first = [k == 0 for k in b.column("chunk").to_pylist()]
            texts = [t[1:] if f else t for t, f in zip(texts, first)]  # the leading blank is added again
            yield _encoded(b, texts, first, shared.value)

    ready = parts.join(boundaries(parts, vocabulary), ["row_no", "k"]).select(
        "row_no", "doc_id", F.col("k").alias("chunk"), "size", "text", "enter", "leave")
    return done.unionByName(ready.mapInArrow(bounded, _ENCODED))


def decode_column(vocabulary: Vocabulary, docs: DataFrame, ids: str = "ids", chunk: str = "chunk"):
    """Column with the text of a row of ids; the first chunk's leading blank is dropped."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary.values)

    @F.arrow_udf("string")
    def decode(lists: pa.Array, chunks: pa.Array) -> pa.Array:
        values, out = shared.value, []
        flat, at = np.asarray(lists.flatten()).tolist(), np.concatenate(
            [[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))]).tolist()
        for a, b, k in zip(at, at[1:], chunks.to_pylist()):
            text = b"".join([values[i] for i in flat[a:b]])
            out.append((text[1:] if k == 0 else text).decode("utf-8", "replace"))
        return pa.array(out, pa.string())

    return decode(F.col(ids), F.col(chunk))
