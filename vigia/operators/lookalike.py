"""Names that mention or resemble a brand, by two indexes instead of every name against every brand.

Mention: a token is registered under the rarest of its 4-grams among all tokens; a name is compared with the tokens
under its own 4-grams only. Resemblance: with edit similarity ``typo`` a label of length m is at most
floor(m (1 - typo) / typo) edits away from what resembles it; cut into one part more, at least one part stays whole
and moves by no more than that, so a name is compared with the labels that share a part near its place. Both are
equi-joins of distinct texts; what they find is then verified, so nothing is lost and nothing wrong is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigia.functions import text as tx, urls as ur
from vigia.session import stage_table

GRAM = 4


def _grams(column: str):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(column) - (GRAM - 1)),
                                        lambda i: F.substring(F.col(column), i, F.lit(GRAM))))


def containing(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """(text, token) for each distinct ``texts.text`` that contains a ``tokens.token`` of four letters or more."""
    words = tokens.where(F.char_length("token") >= GRAM).select("token").distinct() \
        .select("token", F.explode(_grams("token")).alias("gram"))
    often = words.groupBy("gram").agg(F.count("*").alias("_n"))
    keyed = words.join(often, "gram").groupBy("token").agg(F.min_by("gram", F.struct("_n", "gram")).alias("gram"))
    looked = texts.where(F.char_length("text") >= GRAM).select("text").distinct() \
        .select("text", F.explode(_grams("text")).alias("gram"))
    return looked.join(keyed, "gram").where(F.col("text").contains(F.col("token"))).select("text", "token")


def _edits(size: str, typo: float) -> str:
    return f"cast(floor({size} * {1 - typo} / {typo} + 1e-9) as int)"


def _parts(m: str, typo: float, body: str) -> str:
    """SQL over the parts of a label of length ``m``: number ``i``, start ``st`` (from 0) and length ``l``."""
    d = _edits(m, typo)
    return (f"transform(filter(transform(sequence(0, {d}), i -> named_struct('i', i, 'd', {d}, "
            f"'st', i * ({m} div ({d} + 1)) + greatest(0, i - ({d} + 1 - {m} % ({d} + 1))), "
            f"'l', {m} div ({d} + 1) + if(i >= {d} + 1 - {m} % ({d} + 1), 1, 0))), p -> p.l > 0), p -> {body})")


def resembling(texts: DataFrame, labels: DataFrame, typo: float) -> DataFrame:
    """(text, label, similarity) for each pair of distinct ``texts.text`` and ``labels.label`` whose edit similarity
    is ``typo`` at least; both sides without empty strings."""
    known = labels.where("label <> ''").select("label").distinct().select("label", F.explode(F.expr(_parts(
        "char_length(label)", typo, "named_struct('m', char_length(label), 'i', p.i, 'part', substring(label, p.st + 1, p.l))"
    ))).alias("key"))
    shifts = ("transform(filter(sequence(greatest(0, p.st - p.d), greatest(0, p.st + p.d)), a -> a + p.l <= char_length(text)), "
              "a -> named_struct('m', m, 'i', p.i, 'part', substring(text, a + 1, p.l)))")
    asked = texts.where("text <> ''").select("text").distinct().select("text", F.explode(F.array_distinct(F.expr(
        f"flatten(transform(sequence(cast(ceil(char_length(text) * {typo} - 1e-9) as int), cast(floor(char_length(text) / {typo} + 1e-9) as int)), "
        f"m -> flatten({_parts('m', typo, shifts)})))"))).alias("key"))
    near = ur.token_similarity(F.col("text"), F.col("label"))
    return asked.join(known, "key").select("text", "label").distinct().withColumn("similarity", near).where(F.col("similarity") >= typo)


def named_brands(names: DataFrame, brands: DataFrame, typo: float) -> DataFrame:
    """(domain, shown_domain, brand_order) of the ``brands(brand_order, tokens, official_labels)`` that each
    ``names(domain, shown_domain)`` mentions or resembles."""
    forms = stage_table(names.select("domain", "shown_domain").distinct().withColumns({
        "bare": tx.token(F.col("domain")), "candidate": tx.token(F.substring_index("shown_domain", ".", 1))}), "forms")
    tokens = brands.select("brand_order", F.explode("tokens").alias("token")).distinct()
    labels = brands.select("brand_order", F.explode("official_labels").alias("label")).distinct()
    mention = containing(forms.select(F.col("bare").alias("text")), tokens).join(tokens, "token") \
        .select(F.col("text").alias("bare"), "brand_order").distinct()
    close = resembling(forms.select(F.col("candidate").alias("text")), labels, typo).join(labels, "label") \
        .select(F.col("text").alias("candidate"), "brand_order").distinct()
    return forms.join(mention, "bare").select("domain", "shown_domain", "brand_order").unionByName(
        forms.join(close, "candidate").select("domain", "shown_domain", "brand_order")).distinct()


def own_domain(domain: str = "domain", official: str = "official_domains"):
    return F.exists(ur.suffix_candidates(F.col(domain)), lambda d: F.array_contains(F.col(official), d))
