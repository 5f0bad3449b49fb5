"""Queries over the given tables, each with the SQL that must give the same rows."""

from checks import corpus, learning, score, store, streams, text, whole

REGISTRY = {**text.QUERIES, **score.QUERIES, **store.QUERIES, **corpus.QUERIES, **streams.QUERIES,
            **whole.QUERIES, **learning.QUERIES}
