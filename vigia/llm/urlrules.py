"""URL filter: a trie over reversed host labels, continued by path segments.

A rule ``example.org/en/1`` stands at the node org > example > (path) en, with the open last segment ``1``:
it fits its host and every subdomain, for paths that begin with the rule's. One walk finds all fitting
rules; the one with most host labels, then the longest path, wins. The trie is broadcast only below
``max_bytes``; larger rule sets are joined on (host suffix, path prefix of whole segments) instead.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

MAX_TRIE_BYTES = 64 << 20
RULE_BYTES = 700  # measured upper bound for the nodes of one rule of ordinary length
_END = ""  # no host label is empty behind a node's children of this name


def split_rule(host: str, path: str) -> tuple[list[str], list[str], str]:
    """(reversed host labels, complete path segments, open last segment) of a path with a leading slash."""
    *whole, last = path[1:].split("/")
    return host.lower().split(".")[::-1], whole, last


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested dictionaries: host labels, then under ``_END`` a path node {segments, ends by open segment}."""
    root: dict = {}
    for host, path, verdict in rules:
        if path and not path.startswith("/"):
            continue  # no url's path begins like this
        labels, whole, last = split_rule(host, path)
        node = root
        for label in labels:
            node = node.setdefault(label, {})
        node = node.setdefault(_END, {"next": {}, "open": [], "host": None})
        if not path:
            node["host"] = (host, verdict)
            continue
        for segment in whole:
            node = node["next"].setdefault(segment, {"next": {}, "open": []})
        node["open"].append((last, host + path, verdict))
        node["open"].sort(key=lambda r: -len(r[0]))
    return root


def longest_match(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest fitting rule."""
    best, node = (None, None), trie
    if not host:
        return best
    segments = path[1:].split("/") if path.startswith("/") else []
    for label in reversed(host.split(".")):
        node = node.get(label) if label else None
        if node is None:
            break
        at = node.get(_END)
        found = at and at["host"]
        for k, segment in enumerate(segments):
            if at is None:
                break
            for last, rule, verdict in at["open"]:
                if segment.startswith(last):
                    found = (rule, verdict)
                    break
            # a complete segment is one that a slash follows
            at = at["next"].get(segment) if k + 1 < len(segments) else None
        best = found or best
    return best


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host with A-Z lower-cased, path); both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, {1} + 3)".format("__url", "instr(__url, '://')")))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url", max_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """One row for each input row: page_id, host, path, rule, verdict.

    ``rules``: (host, path, verdict) tuples or a DataFrame of these columns. Urls without a rule get
    ``default``; null or malformed urls have empty parts and no rule. A rule fits paths that begin with its
    own: an empty one fits its whole host, also without a path; one without leading slash fits nothing. Ids and other columns play no part; empty tables give no
    rows. Rules of one host and path that differ in verdict are an error."""
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__url"))
    host, path = url_parts(F.col("__url"))
    parts = named.select("page_id", host.alias("host"), path.alias("path"))
    spark = pages.sparkSession
    if isinstance(rules, list):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    rules = rules.select("host", "path", "verdict").distinct()
    n, width = rules.agg(F.count("*"), F.coalesce(F.max(F.length("host") + F.length("path")), F.lit(0))).first()
    if rules.groupBy("host", "path").count().where("count > 1").limit(1).count():
        raise ValueError("a rule has two verdicts")
    if n * (RULE_BYTES + 8 * width) > max_bytes:
        return _judge_by_join(parts, rules, default)
    trie = spark.sparkContext.broadcast(build_trie([tuple(r) for r in rules.collect()]))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        rows = [longest_match(trie.value, h, p) for h, p in zip(hosts, paths)]
        return pd.DataFrame(rows, columns=["rule", "verdict"], dtype=object)

    return parts.select("page_id", "host", "path", judge("host", "path").alias("m")).select(
        "page_id", "host", "path", "m.rule", F.coalesce("m.verdict", F.lit(default)).alias("verdict"))


def _judge_by_join(parts: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same rows for rule sets of any size: each distinct (host, path) is expanded to its host suffixes
    and whole-segment path prefixes, which meet the rules' own in an equality join."""
    seen = parts.select("host", "path").distinct()
    keys = rules.select(F.lower("host").alias("suffix"), F.regexp_extract("path", "(?s)^(.*/)", 1).alias("prefix"),
                        F.col("path").alias("rule_path"), F.concat("host", "path").alias("rule"), "verdict")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    steps = F.split("path", "/")
    # the empty prefix is that of rules for a whole host, which fit the empty path too
    prefixes = F.when(F.col("path").startswith("/"), F.concat(F.array(F.lit("")), F.transform(
        F.sequence(F.lit(1), F.size(steps) - 1),
        lambda k: F.concat(F.array_join(F.slice(steps, 1, k), "/"), F.lit("/"))))).otherwise(F.array(F.lit("")))
    wide = (seen.where(F.col("host") != "")
            .select("host", "path", F.explode(suffixes).alias("suffix"))
            .select("host", "path", "suffix", F.explode(prefixes).alias("prefix")))
    fits = wide.join(keys, ["suffix", "prefix"]).where(F.expr("startswith(path, rule_path)"))
    best = fits.groupBy("host", "path").agg(F.max_by(
        F.struct("rule", "verdict"),
        F.struct(F.size(F.split("suffix", r"\.")), F.length("rule_path"))).alias("m"))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "m.rule", F.coalesce("m.verdict", F.lit(default)).alias("verdict"))
