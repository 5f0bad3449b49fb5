"""Small dimensions: brands, registered sender aliases, feed policies, shared platforms.

The defaults are the records in ``fixed``. ``load_*`` reads a site's own tables from JSON;
those readers check that the table is small enough to travel with the plan.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vigia import fixed
from vigia.functions.text import token_literal, words_literal

MAX_DIMENSION_ROWS = 20_000


@dataclass(frozen=True)
class Brand:
    name: str
    category: str
    aliases: tuple[str, ...]
    domains: tuple[str, ...]
    numbers: tuple[str, ...] = field(default=())

    @property
    def tokens(self) -> tuple[str, ...]:
        """Comparable forms of the name and the aliases, each once."""
        return tuple(dict.fromkeys(token_literal(n) for n in (self.name, *self.aliases)))


def default_brands() -> tuple[Brand, ...]:
    return tuple(Brand(**b) for b in fixed.BRANDS)


@dataclass(frozen=True)
class SenderAlias:
    alias: str
    holder: str
    tax_id: str
    category: str
    activation_date: str
    authorized: tuple[str, ...]
    status: str = "active"


def default_aliases() -> tuple[SenderAlias, ...]:
    return tuple(SenderAlias(**a) for a in fixed.SENDER_ALIASES)


# --- as DataFrames --------------------------------------------------------------------------

def _collect_small(df: DataFrame, what: str) -> list:
    rows = df.limit(MAX_DIMENSION_ROWS + 1).collect()
    if len(rows) > MAX_DIMENSION_ROWS:
        raise ValueError(f"{what}: more than {MAX_DIMENSION_ROWS} rows, too many for a dimension")
    return rows


_BRAND_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("official_domains", T.ArrayType(T.StringType())),
    T.StructField("official_numbers", T.ArrayType(T.StructType([
        T.StructField("number", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("verified_at", T.StringType()), T.StructField("purpose", T.StringType()),
    ]))),
])


def load_brands(spark: SparkSession, path: str) -> tuple[Brand, ...]:
    df = spark.read.schema(_BRAND_SCHEMA).json(path, multiLine=True)
    return tuple(
        Brand(r["name"], r["category"], tuple(r["aliases"] or ()),
              tuple(r["official_domains"] or ()),
              tuple(n["number"] for n in r["official_numbers"] or ()))
        for r in _collect_small(df, path))


def load_aliases(spark: SparkSession, path: str) -> tuple[SenderAlias, ...]:
    entry = T.StructType([
        T.StructField(n, T.StringType()) for n in
        ("alias", "holder_name", "cif_nif", "category", "status", "activation_date")
    ] + [T.StructField("authorized_entities", T.ArrayType(T.StringType()))])
    schema = T.StructType([T.StructField("aliases", T.ArrayType(entry))])
    df = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("aliases"))
    return tuple(
        SenderAlias(r["alias"], r["holder_name"], r["cif_nif"], r["category"],
                    r["activation_date"], tuple(r["authorized_entities"] or ()), r["status"])
        for r in _collect_small(df, path))


def load_policies(spark: SparkSession, path: str) -> tuple[tuple, ...]:
    entry = ("name:string,format:string,indicator_type:string,trust_tier:int,"
             "hard_rule_eligible:boolean,ttl_seconds:bigint")
    df = spark.read.schema(f"providers array<struct<{entry}>>") \
        .json(path, multiLine=True).select(F.inline("providers"))
    return tuple(tuple(r) for r in _collect_small(df, path))


def load_shared_infrastructure(spark: SparkSession, path: str) -> tuple[str, ...]:
    df = spark.read.schema("shared_infrastructure array<string>").json(path, multiLine=True)
    return tuple(r[0] for r in _collect_small(df.select(F.explode("shared_infrastructure")), path))


def brands_df(spark: SparkSession, brands: tuple[Brand, ...] | None = None) -> DataFrame:
    """One row per brand with the forms that joins compare."""
    rows = [
        (i, b.name, b.category, list(b.tokens), list(b.domains),
         [token_literal(d.split(".")[0]) for d in b.domains], list(b.numbers))
        for i, b in enumerate(brands or default_brands())
    ]
    return spark.createDataFrame(
        rows, "brand_order int, entity string, category string, tokens array<string>, "
              "official_domains array<string>, official_labels array<string>, "
              "official_numbers array<string>")


def aliases_df(spark: SparkSession, aliases: tuple[SenderAlias, ...]) -> DataFrame:
    """One row per registered active alias (the first one of a name)."""
    by_token: dict[str, SenderAlias] = {}
    for alias in aliases:
        by_token.setdefault(token_literal(alias.alias), alias)
    rows = [
        (token, a.holder, a.tax_id, a.category, a.activation_date, list(a.authorized),
         [token_literal(n) for n in a.authorized], token_literal(a.holder))
        for token, a in by_token.items() if a.status == "active"]
    return spark.createDataFrame(
        rows, "alias_token string, holder string, tax_id string, alias_category string, "
              "activation_date string, authorized array<string>, "
              "authorized_tokens array<string>, holder_token string")


def policies_df(spark: SparkSession, policies: tuple[tuple, ...] | None = None) -> DataFrame:
    if policies is None:
        policies = tuple(tuple(p.values()) for p in fixed.PROVIDERS)
    return spark.createDataFrame(
        list(policies), "provider string, format string, indicator_type string, trust_tier int, "
                        "hard_rule_eligible boolean, ttl_seconds bigint")


# --- as expressions -------------------------------------------------------------------------

# A constant table is one JSON literal, which the optimiser folds: far cheaper to plan than a tree of
# hundreds of literals.

def strings(values) -> Column:
    """Constant array of strings."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<string>")


def alias_forms(brands: tuple[Brand, ...]) -> list[tuple[str, int]]:
    """(folded alias, brand position), longest alias first, then in table order."""
    forms: dict[str, int] = {}
    for i, brand in enumerate(brands):
        for alias in brand.aliases:
            forms.setdefault(words_literal(alias), i)
    return sorted(forms.items(), key=lambda f: -len(f[0]))
