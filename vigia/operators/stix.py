"""STIX 2.1 bundles: identity, one indicator per observable, a note. Only redacted data leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from vigia import schemas as S
from vigia.functions.hashing import uuid5


def _escape_html(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def observables(extractions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(message_id, kind, value, position): links first, then public domains, each once."""
    links = extractions.select("message_id", F.posexplode("urls").alias("position", "value")) \
        .select("message_id", F.lit("url").alias("kind"), "value", "position")
    public = artifacts.where(F.col("artifact_type").isin("domain", "url")
                             & F.col("value_public").isNotNull()).select(
        "message_id", F.col("artifact_type").alias("kind"), F.col("value_public").alias("value"),
        F.lit(1_000_000).alias("position"))
    return links.unionByName(public).where("value <> ''").groupBy("message_id", "kind", "value") \
        .agg(F.min("position").alias("position"))


def bundles(verdicts: DataFrame, found: DataFrame, *, namespace: uuid.UUID, system: str) -> DataFrame:
    """(message_id, bundle JSON). Ids are name-based, so an export repeats exactly."""
    def object_id(kind: str, value: Column) -> Column:
        return F.concat(F.lit(f"{kind}--"), uuid5(namespace, F.concat(F.lit(f"{kind}:"), value)))

    created = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    safe = F.replace(F.replace(F.col("value"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    indicator = F.struct(
        "position", "kind", "value",
        object_id("indicator", F.concat_ws(":", "kind", "value")).alias("id"),
        F.when(F.col("kind") == "url", F.concat(F.lit("[url:value = '"), safe, F.lit("']")))
        .otherwise(F.concat(F.lit("[domain-name:value = '"), safe, F.lit("']"))).alias("pattern"))
    # observables of one message are bounded by its own text
    per_message = found.groupBy("message_id").agg(
        F.array_sort(F.collect_list(indicator)).alias("items"))
    joined = verdicts.join(per_message, "message_id", "left")
    items = F.coalesce("items", F.array().cast(
        "array<struct<position:int,kind:string,value:string,id:string,pattern:string>>"))
    common = [F.lit("2.1").alias("spec_version"), created.alias("created"), created.alias("modified")]
    slug = system.lower().replace(" ", "-")
    identity = F.to_json(F.struct(
        F.lit("identity").alias("type"), *common, object_id("identity", F.lit(slug)).alias("id"),
        F.lit(system).alias("name"), F.lit("system").alias("identity_class")))
    rows = F.transform(items, lambda i: F.to_json(F.struct(
        F.lit("indicator").alias("type"), *common, i["id"].alias("id"),
        F.concat(F.lit("Observable "), i["kind"], F.lit(f" de {system}")).alias("name"),
        i["pattern"].alias("pattern"), F.lit("stix").alias("pattern_type"),
        created.alias("valid_from"),
        F.bround(F.coalesce("confidence", F.lit(0.0)) * 100, 0).cast("int").alias("confidence"),
        F.array(F.lit(slug), F.coalesce("level", F.lit(S.LEVEL_UNCERTAIN)),
                F.coalesce("message_type", F.lit(S.TYPE_UNKNOWN))).alias("labels"))))
    note = F.to_json(F.struct(
        F.lit("note").alias("type"), *common, object_id("note", F.col("message_id")).alias("id"),
        _escape_html(F.coalesce("explanation", F.lit(""))).alias("content"),
        F.transform(items, lambda i: i["id"]).alias("object_refs"),
        F.array("level", "message_type").alias("labels")))
    objects = F.concat(F.array(identity), rows, F.array(note))
    return joined.select("message_id", F.concat(
        F.lit('{"type":"bundle","id":"'), object_id("bundle", F.col("message_id")),
        F.lit('","objects":['), F.array_join(objects, ","), F.lit("]}")).alias("bundle"))
