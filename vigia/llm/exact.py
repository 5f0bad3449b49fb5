"""Exact duplicates by content-defined chunk recipes.

A text is normalised (white space deleted) and cut where its own bytes say so; its recipe is the ordered
list of chunk identifiers. Only recipes travel: a long document moves as eight bytes for each two kilobytes.
Before recipes are compared, identifiers are verified: the chunks of texts whose recipe occurs twice are
brought together by identifier and their bytes compared. If an identifier stands for two contents, all
recipes are made anew with wider identifiers and another seed, so equal recipes do mean equal texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigia.llm.common import (SPACE, BitFilter, Prefix, bit_filter, code_points, keep_rows, keyed, mix, per_piece, raw, stage)

AVERAGE_CHUNK = 2048
WINDOW = 32
_MASK = np.uint64(AVERAGE_CHUNK - 1)
LONGEST_CHUNK = 16 * AVERAGE_CHUNK
_RECIPES = ("row_no long, doc_id long, text_xx long, n_points long, text_sha256 string, recipe_key long, "
            "recipe array<long>")


def chunk_ends(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exclusive ends, row of each chunk): a chunk ends where the hash of the last ``WINDOW`` bytes has its
    low bits zero, at the end of its row, and after ``LONGEST_CHUNK`` bytes at the latest."""
    n, found = len(data), np.zeros(0, np.int64)
    if n >= WINDOW:
        start = np.arange(n - WINDOW + 1)
        found = np.flatnonzero((Prefix(data).of(start, start + WINDOW) & _MASK) == 0) + WINDOW
        row = np.searchsorted(at, found - 1, "right") - 1
        found = found[found - WINDOW >= at[row]]  # windows never reach into the row before
    ends = np.unique(np.concatenate([found, at[1:][at[1:] > at[:-1]]]))
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    wide = np.flatnonzero(ends - begins > LONGEST_CHUNK)
    if len(wide):
        more = [np.arange(begins[i] + LONGEST_CHUNK, ends[i], LONGEST_CHUNK) for i in wide]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends, np.searchsorted(at, ends - 1, "right") - 1


def _normalised(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, at = raw(text)
    points = code_points(data)[at]
    keep = ~SPACE[data]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return data[keep], before[at], np.diff(points), at


def _identifiers(data: np.ndarray, ends: np.ndarray, begins: np.ndarray, seed: int, id_bits: int) -> np.ndarray:
    salt = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    ids = mix(Prefix(data).of(begins, ends) ^ salt) ^ mix((ends - begins).astype(np.uint64) + salt)
    return ids if id_bits >= 64 else ids & np.uint64((1 << id_bits) - 1)


def _cut(text: pa.Array, seed: int, id_bits: int):
    data, at, points, _ = _normalised(text)
    ends, row = chunk_ends(data, at)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    ids = _identifiers(data, ends, begins, seed, id_bits)
    first = np.searchsorted(row, np.arange(len(at)), "left")  # chunks of row r: first[r]..first[r+1]
    place = (np.arange(len(ids)) - first[row]).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids + mix(place)), out=sums[1:])
    keys = mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64))
    return data, at, points, begins, ends, row, ids, first, keys


def recipes(docs: DataFrame, seed: int = 0, id_bits: int = 64) -> DataFrame:
    """One narrow row for each input row: code points, digest of the normalised text, recipe."""
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id",
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_xx"), "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at, points, _, _, _, ids, first, keys = _cut(batch.column("text"), seed, id_bits)
        body = memoryview(data)
        digests = [hashlib.sha256(body[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
        return pa.record_batch([
            batch.column("row_no"), batch.column("doc_id"), batch.column("text_xx"), pa.array(points),
            pa.array(digests, pa.string()), pa.array(keys.view(np.int64)),
            pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.view(np.int64)))],
            names=["row_no", "doc_id", "text_xx", "n_points", "text_sha256", "recipe_key", "recipe"])

    return per_piece(rows, _RECIPES, work)


def clashing_chunks(docs: DataFrame, repeated: BitFilter, seed: int, id_bits: int) -> DataFrame:
    """Identifiers that stand for two contents, among the chunks of texts with a repeated recipe. A content
    leaves a task once for each piece it reads, so a large group of copies sends few bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, _, _, begins, ends, row, ids, _, keys = _cut(batch.column("text"), seed, id_bits)
        picked = np.flatnonzero(shared.value.hits(keys)[row])
        body = memoryview(data)
        seen = {(int(ids[i]), bytes(body[begins[i]:ends[i]])) for i in picked}
        if not seen:
            return None
        names, bodies = zip(*seen)
        return pa.record_batch([pa.array(np.array(names, np.uint64).view(np.int64)),
                                pa.array(bodies, pa.binary())], names=["chunk", "content"])

    chunks = per_piece(docs.select("text"), "chunk long, content binary", work)
    return (chunks.groupBy("chunk").agg(F.min("content").alias("low"), F.max("content").alias("high"))
            .where("low <> high").select("chunk"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bits: int = 64) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256, n_points, n_chunks, row_no.

    Null and empty texts (and those of white space alone) are equal to each other. Of a group the row with
    the most code points stays, then the smallest doc_id (a null id comes last), then the first such row:
    of repeated rows exactly one is kept. Empty tables give no rows; other columns are ignored."""
    rows, seed = keyed(docs, id_col, text_col), 0
    while True:
        made = stage(recipes(rows, seed, id_bits), "recipes")
        twice = made.groupBy("recipe_key").count().where("count > 1").select("recipe_key")
        if clashing_chunks(rows, bit_filter(twice), seed, id_bits).isEmpty():
            break
        seed, id_bits = seed + 1, min(64, id_bits * 2)
    order = F.struct("n_points", (-F.col("doc_id")).alias("id"), (-F.col("row_no")).alias("row"))
    # copies are counted before they are shuffled; texts of their own never meet the join
    groups = stage(made.groupBy("recipe_key", "recipe").agg(
        F.max(order).alias("best"), F.count("*").alias("group_size")).where("group_size > 1"), "groups")
    many = F.col("group_size").isNotNull()
    return made.join(groups, ["recipe_key", "recipe"], "left").select(
        "doc_id", F.when(many, -F.col("best.id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_no") == -F.col("best.row"), F.lit(True)).alias("kept"), "text_sha256", "n_points",
        F.size("recipe").alias("n_chunks"), "row_no", "text_xx")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one row of each group of equal texts."""
    rows = stage(exact_groups(docs, id_col, text_col).select("doc_id", "text_xx", "kept"), "kept")
    repeated = rows.groupBy("doc_id", "text_xx").count().where("count > 1")
    return keep_rows(docs, rows.where("kept"), repeated, id_col, text_col)
