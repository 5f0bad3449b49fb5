"""Documents to a training corpus: quality, exact and near duplicates, source mixture, piece ids.

Each stage takes the documents that the one before kept and returns the rows it keeps, with the columns of
documents; the last returns piece ids. ``run`` writes each stage's rows to the shared checkpoint folder
before the next stage begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigia.llm import exact, similar, tokens
from vigia.llm.common import stage, table
from vigia.llm.queries import KEEP_FROM, mix_documents, quality_rated, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is one or more with probability ``KEEP_FROM`` at least."""
    rated = quality_rated(docs, table(spark, sf_dir, "labels"))
    return rated.where(F.col("__tails")[0] >= KEEP_FROM).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at 0.8."""
    return similar.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the mixture, repeated where a leaf is read more than once."""
    return mix_documents(docs).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, chunk, n_tokens, ids): the piece ids of each document, very long ones in several rows."""
    return tokens.encode(docs, vocabulary()).select("doc_id", "chunk", F.size("ids").alias("n_tokens"), "ids")


STAGES = [("quality classifier", keep_quality), ("exact dedup", drop_exact_copies),
          ("n-gram Jaccard join", drop_near_copies), ("source mixture", mix_sources),
          ("SentencePiece ids", encode_pieces)]
#: Trained weights, similarity components and piece ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
