"""Mixing sources to target weights by hierarchical budgeting, with DataFrame operations only.

Token budgets run down the tree domain > language > source. Among siblings a budget is divided by weight,
up to what each child can supply; what a child cannot use goes to its siblings first, in proportion to
their weights, and only what all siblings together cannot use stays with the parent, where the parent's
own siblings have taken it already (a node's supply is the sum of its leaves'). All arithmetic is on whole
tokens. Each leaf then gives the prefix of its seeded epochs that fits its budget: whole epochs first, then
the prefix of one more epoch in that epoch's own order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigia.llm.common import stage

LEVELS = ("domain", "lang", "source")
BUCKET_ROWS = 1_000


def words(text: str | Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_fill(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """Adds ``budget`` to (``parent``..., ``child``, weight, supply, parent_budget): weighted shares capped
    by supply. Sorted by supply per weight the capped children are a prefix, and cumulative sums say where
    it ends, so a level needs one window over its siblings."""
    w = Window.partitionBy(*parent).orderBy("ratio", child)
    before, rest = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    ranked = (children
              .withColumn("ratio", F.when(F.col("weight") > 0, F.col("supply") / F.col("weight"))
                          .otherwise(F.lit(float("inf"))))
              .withColumn("given", F.coalesce(F.sum("supply").over(before), F.lit(0)).cast("long"))
              .withColumn("heavier", F.sum("weight").over(rest).cast("long"))
              .withColumn("left", F.greatest(F.col("parent_budget") - F.col("given"), F.lit(0)))
              .withColumn("open", exact("supply") * exact("heavier") > exact("weight") * exact("left"))
              # from the first child that is not capped on, all share what the capped ones leave
              .withColumn("open", F.max("open").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    whole = Window.partitionBy(*parent).orderBy("ratio", child).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    first_open = lambda c: F.first(F.when(F.col("open"), F.col(c)), ignorenulls=True).over(whole)
    shared = ranked.withColumn("pool", first_open("left")).withColumn("pool_weight", first_open("heavier"))
    share = F.expr("cast(cast(weight as decimal(19,0)) * cast(pool as decimal(19,0)) div "
                   "cast(pool_weight as decimal(38,0)) as long)")
    return shared.withColumn("budget", F.when(~F.col("open"), F.col("supply")).when(
        F.col("pool_weight") > 0, F.least(share, F.col("supply"))).otherwise(F.lit(0)).cast("long")).drop(
        "ratio", "given", "heavier", "left", "open", "pool", "pool_weight")


def leaf_budgets(leaves: DataFrame, budget: Column | int, max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, n_rows, w_domain, w_lang, w_source) -> the same with ``budget``."""
    full = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    roots = full.groupBy("domain").agg(
        F.sum("supply").cast("long").alias("supply"), F.sum("tokens").cast("long").alias("own"),
        F.max("w_domain").alias("weight")).withColumn("root", F.lit(0)).withColumn(
        "all_tokens", F.sum("own").over(Window.partitionBy("root")).cast("long"))
    domains = water_fill(roots.withColumn(
        "parent_budget", (budget if isinstance(budget, Column) else F.lit(budget)).cast("long")), ["root"], "domain")
    langs = water_fill(
        full.groupBy("domain", "lang").agg(F.sum("supply").cast("long").alias("supply"),
                                           F.max("w_lang").alias("weight"))
        .join(domains.select("domain", F.col("budget").alias("parent_budget")), "domain"), ["domain"], "lang")
    return water_fill(
        full.withColumn("weight", F.col("w_source"))
        .join(langs.select("domain", "lang", F.col("budget").alias("parent_budget")), ["domain", "lang"]),
        ["domain", "lang"], "source").drop("parent_budget", "weight")


def place(seed: int, epoch: str | Column) -> Column:
    """Hexadecimal place of a row in an epoch: uniform, and another order for each epoch."""
    epoch = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(
        F.col("doc_id").cast("string"), F.lit(""))))


def mix(docs: DataFrame, weights: dict[str, Column], budget: Column | int, seed: int = 7, max_epochs: int = 4,
        tokens: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """Selected rows with their original columns, n_tokens, leaf budget and ``epoch`` (0, 1, ...), one row
    for each time a document is taken.

    ``weights`` holds whole numbers for "domain", "lang" and "source" as columns over (domain, lang,
    source); "domain_of" is the domain itself. ``budget``: tokens, or a column over ``all_tokens``. A leaf
    gives the longest prefix that its budget holds; rows that share a place in it (equal ids) stand or
    fall together. Null lang or source are leaves of the empty name; null texts have no tokens and follow
    their place. No tokens or an empty table: no rows."""
    n_tokens = tokens if tokens is not None else words("text")
    own = docs.columns
    named = docs.withColumns({
        "__id": F.col(id_col).cast("long"), "__tokens": n_tokens, "__domain": weights["domain_of"],
        "__lang": F.coalesce(F.col("lang"), F.lit("")), "__source": F.coalesce(F.col("source"), F.lit(""))})
    narrow = stage(named.select(F.col("__id").alias("doc_id"), F.col("__tokens").alias("n_tokens"),
                                F.col("__domain").alias("domain"), F.col("__lang").alias("lang"),
                                F.col("__source").alias("source")), "tokens")
    leaves = stage(narrow.groupBy(*LEVELS).agg(F.sum("n_tokens").cast("long").alias("tokens"),
                                               F.count("*").alias("n_rows"))
                   .select("*", weights["domain"].cast("long").alias("w_domain"),
                           weights["lang"].cast("long").alias("w_lang"),
                           weights["source"].cast("long").alias("w_source")), "leaves")
    plan = stage(leaf_budgets(leaves, budget, max_epochs).select(
        *LEVELS, "budget", F.expr("if(tokens > 0, budget div tokens, 0L)").alias("epochs"),
        F.expr("if(tokens > 0, budget % tokens, 0L)").alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("n_rows") / BUCKET_ROWS)).alias("buckets")), "plan")
    # where the last epoch's prefix ends: sums of place ranges first, single places in one range only
    at = narrow.join(plan.where("rest > 0"), list(LEVELS)).withColumn("place", place(seed, "epochs")).withColumn(
        "bucket", F.expr("shiftright(cast(conv(substr(place, 1, 8), 16, 10) as bigint) * buckets, 32)"))
    sums = at.groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("t"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket")
    edge = sums.withColumn("upto", F.sum("t").over(run)).where("upto > rest").groupBy(*LEVELS).agg(
        F.min_by(F.struct("bucket", (F.col("rest") - (F.col("upto") - F.col("t"))).alias("room")), "bucket").alias("e"))
    edge = stage(edge.select(*LEVELS, "e.bucket", "e.room"), "edges")
    inside = (at.join(edge, [*LEVELS, "bucket"]).groupBy(*LEVELS, "room", "place")
              .agg(F.sum("n_tokens").alias("t"))
              .withColumn("upto", F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("place"))))
    cut = inside.where("upto > room").groupBy(*LEVELS).agg(F.min("place").alias("cut"))
    leaf = stage(plan.join(cut, list(LEVELS), "left").select(
        *[F.col(c).alias(f"__{c}") for c in LEVELS], F.col("budget").alias("__budget"),
        F.col("epochs").alias("__epochs"), F.when(F.col("rest") > 0, F.coalesce("cut", F.lit("g"))).alias("__cut")),
        "leaf")
    last = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__epochs").cast("string"),
                             F.coalesce(F.col("__id").cast("string"), F.lit(""))))
    times = (F.col("__epochs") + F.when(last < F.col("__cut"), 1).otherwise(0)).cast("int")
    taken = named.join(leaf, [f"__{c}" for c in LEVELS]).withColumn("__times", times).where("__times > 0")
    return taken.select(
        *[F.col(f"`{c}`") for c in own], F.col("__domain"), F.col("__tokens").alias("__n_tokens"), "__budget",
        F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("__epoch"))
