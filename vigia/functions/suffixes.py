"""Public suffix rules: which part of a host name anyone can register below.

Rules are normal (``co.uk``), wildcard (``*.ck``: any label below ck) or exceptions to a wildcard
(``!www.ck``); the longest rule wins, an exception before all. A host whose suffix no rule knows, and a bare
suffix, stand for themselves. The list is read from a file, or from the copy that Spark's own HTTP client
brings along; without either a short built-in list is used.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigia import fixed

#: Rules up to this number travel inside the plan (about 300 kB); more are joined (``with_registrable``).
MAX_INLINE = 20_000
BUCKETS = 4_096
BUNDLED = "mozilla/public-suffix-list.txt"


@dataclass(frozen=True)
class SuffixRules:
    exact: frozenset[str]
    wildcard: frozenset[str]
    exception: frozenset[str]
    #: without a full list: a host that no rule knows has a suffix of one label
    any_last_label: bool = False

    @property
    def depth(self) -> int:
        """Labels that the longest suffix may have, one more for what an exception names."""
        sizes = [r.count(".") + 1 for r in self.exact | self.exception] + [r.count(".") + 2 for r in self.wildcard]
        return max(sizes, default=1)

    @property
    def size(self) -> int:
        return len(self.exact) + len(self.wildcard) + len(self.exception)

    @cached_property
    def buckets(self) -> str:
        """The rules by crc32 as lines of one text: a single literal in the plan, not one for each rule."""
        lines = [" "] * BUCKETS
        for mark, rules in (("", self.exact), ("*", self.wildcard), ("!", self.exception)):
            for rule in sorted(rules):
                lines[zlib.crc32(rule.encode()) % BUCKETS] += f"{mark}{rule} "
        return "\n".join(lines)

    def suffix_labels(self, name: Column) -> Column:
        """Number of labels of the host's longest known suffix, 0 if there is none."""
        table = F.split(F.lit(self.buckets), "\n")  # folded once

        def found(end: Column, line: Column, k: Column) -> Column:
            has = lambda mark: line.contains(F.concat(F.lit(" " + mark), end, F.lit(" ")))
            return F.when(has("!"), k - 1 + 1_000).when((k < F.size(F.split(name, r"\."))) & has("*"), k + 1) \
                .when(has(""), k).otherwise(0)

        def size(k: Column) -> Column:
            end = F.call_function("substring_index", name, F.lit("."), -k)
            line = F.get(table, (F.crc32(end.cast("binary")) % BUCKETS).cast("int"))
            return found(end, line, k)

        sizes = F.transform(F.sequence(F.lit(1), F.least(F.size(F.split(name, r"\.")), F.lit(self.depth))), size)
        return F.array_max(sizes) % 1_000


def parse_rules(lines: list[str], extra: tuple[str, ...] = ()) -> SuffixRules:
    """Rules of a list in the public format, in Unicode and ASCII spelling, with ``extra`` normal ones."""
    kinds: dict[str, set[str]] = {"exact": set(), "wildcard": set(), "exception": set()}
    for line in [*lines, *extra]:
        rule = line.split(None, 1)[0].lower() if line.strip() else ""
        if not rule or rule.startswith("//"):
            continue
        kind = "exception" if rule.startswith("!") else "wildcard" if rule.startswith("*.") else "exact"
        name = rule.lstrip("!").removeprefix("*.").strip(".")
        kinds[kind].add(name)
        if not name.isascii():
            kinds[kind].add(name.encode("idna").decode("ascii"))
    return SuffixRules(**{k: frozenset(v) for k, v in kinds.items()})


def read_rules(spark: SparkSession, path: str) -> SuffixRules:
    """Rules of a file small enough to travel in plans; larger ones stay a table (``rules_table``)."""
    lines = spark.read.text(path).where("value <> '' and not startswith(value, '//')")
    if lines.count() > MAX_INLINE:
        raise ValueError(f"more than {MAX_INLINE} suffix rules: join rules_table with with_registrable")
    return parse_rules([r["value"] for r in lines.collect()], fixed.EXTRA_SUFFIXES)


@lru_cache(maxsize=1)
def default_rules() -> SuffixRules:
    spark = SparkSession.active()
    loader = spark._jvm.java.lang.Thread.currentThread().getContextClassLoader()
    stream = loader.getResourceAsStream(BUNDLED)
    if stream is None:
        return replace(parse_rules([*fixed.TWO_LABEL_SUFFIXES], fixed.EXTRA_SUFFIXES), any_last_label=True)
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return parse_rules(text.splitlines(), fixed.EXTRA_SUFFIXES)


def rules_table(rules: DataFrame, column: str = "value") -> DataFrame:
    """(name, kind) of rules in the public format, for lists of any size; ASCII and Unicode spelling."""
    line = F.lower(F.regexp_extract(column, r"^(\S+)", 1))
    kept = rules.select(line.alias("rule")).where("rule <> '' and not startswith(rule, '//')")
    named = kept.select(
        F.btrim(F.regexp_replace("rule", r"^(!|\*\.)", ""), F.lit(".")).alias("name"),
        F.when(F.col("rule").startswith("!"), "exception").when(F.col("rule").startswith("*."), "wildcard")
        .otherwise("exact").alias("kind"))
    return named.select(F.explode(F.array_distinct(F.array("name", F.coalesce(to_ascii(F.col("name")), F.col("name")))))
                        .alias("name"), "kind").distinct()


def with_registrable(df: DataFrame, host: str, out: str, rules: DataFrame) -> DataFrame:
    """Adds the registrable domain of ``host`` (ASCII, null stays null) by a join of the distinct hosts'
    endings with ``rules_table``: for rule lists of any size. Each host takes one row for each of its labels."""
    names = df.select(F.col(host).alias("__host")).where("__host is not null").distinct()
    labels = F.split("__host", r"\.")
    tails = names.select("__host", F.size(labels).alias("__n"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("__k")) \
        .withColumn("name", F.expr("substring_index(__host, '.', -__k)"))
    size = F.when(F.col("kind") == "exception", F.col("__k") - 1 + 1_000) \
        .when(F.col("kind") == "exact", F.col("__k")).when(F.col("__k") < F.col("__n"), F.col("__k") + 1)
    best = tails.join(rules, "name").groupBy("__host", "__n").agg((F.max(size) % 1_000).alias("__size"))
    domains = names.join(best, "__host", "left").select("__host", F.when(
        F.col("__size") < F.col("__n"), F.expr("substring_index(__host, '.', -(__size + 1))"))
        .otherwise(F.col("__host")).alias("__domain"))
    from vigia.functions.urls import is_ip
    domains = domains.withColumn("__domain", F.when(is_ip(F.col("__host")), F.col("__host")).otherwise(F.col("__domain")))
    return df.join(domains, F.col(host) == F.col("__host"), "left").drop("__host") \
        .withColumnRenamed("__domain", out)


# ---------------------------------------------------------------- international names

_ALLOW_UNASSIGNED = 1


def to_ascii(name: Column) -> Column:
    """IDNA form of a host name on the JVM; null where a label is empty, too long or not allowed."""
    plain = F.octet_length(name) == F.char_length(name)
    return F.when(plain, F.when(~name.rlike(r"(^|\.)(\.|$)|[^.]{64,}"), name)).otherwise(
        F.call_function("try_reflect", F.lit("java.net.IDN"), F.lit("toASCII"), name, F.lit(_ALLOW_UNASSIGNED)))


def to_shown(ascii_name: Column) -> Column:
    """Unicode form of an ASCII host name; labels that decode to nothing valid stay as they are."""
    return F.when(ascii_name.contains("xn--"), F.call_function(
        "try_reflect", F.lit("java.net.IDN"), F.lit("toUnicode"), ascii_name, F.lit(_ALLOW_UNASSIGNED))) \
        .otherwise(ascii_name)
