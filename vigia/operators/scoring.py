"""From evidence to verdict. Works inside the row on ``signals``; no shuffle.

Only rows with status ``hit`` can score or fire a rule, and no message is ever called safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigia import fixed, schemas as S
from vigia.functions.text import pin


def _checks_by_family() -> dict[str, list[str]]:
    families: dict[str, list[str]] = {}
    for check, family in fixed.FAMILY_OF_CHECK.items():
        families.setdefault(family, []).append(check)
    return families


def _family(check: Column) -> Column:
    ladder = None
    for family, checks in _checks_by_family().items():
        test = check.isin(*checks)
        ladder = F.when(test, family) if ladder is None else ladder.when(test, family)
    return ladder.otherwise(check)


def suppress(df: DataFrame) -> DataFrame:
    """Noisy technical hits on a shared platform's domain become ``suppressed``."""
    hit = lambda s: s["status"] == S.HIT
    shared = F.transform(
        F.filter("signals", lambda s: hit(s) & (s["check_name"] == "shared_infrastructure_context")
                 & s["domain"].isNotNull()), lambda s: s["domain"])
    staged = df.withColumn("_shared", pin(shared))

    def calm(s: Column) -> Column:
        noisy = hit(s) & s["check_name"].isin(*fixed.SUPPRESSIBLE) \
            & F.array_contains(F.col("_shared"), s["domain"])
        return s.withField("status", F.when(noisy, S.SUPPRESSED).otherwise(s["status"]))

    return staged.withColumn("signals", pin(F.when(
        F.size("_shared") > 0, F.transform("signals", calm)).otherwise(F.col("signals"))))


def family_weights(df: DataFrame) -> DataFrame:
    """Adds ``family_weights``: family -> largest weight of its hits."""
    hits = F.filter("signals", lambda s: s["status"] == S.HIT)
    pairs = F.transform(hits, lambda s: F.struct(
        _family(s["check_name"]).alias("family"),
        F.greatest(s["weight"], F.lit(0)).alias("weight")))
    staged = df.withColumn("_pairs", pin(pairs))
    names = F.array_distinct(F.transform("_pairs", lambda p: p["family"]))
    best = F.transform(names, lambda n: F.array_max(F.transform(
        F.filter("_pairs", lambda p: p["family"] == n), lambda p: p["weight"])))
    return staged.withColumn("family_weights", pin(F.map_from_arrays(names, best))).drop("_pairs")


def decide(df: DataFrame, ruleset_version: str = S.RULESET_VERSION,
           scam_score: int = S.SCAM_SCORE) -> DataFrame:
    """Adds score, hard_rule, level, confidence, reasons and rule_trace."""
    staged = family_weights(suppress(df)).withColumns({
        "_hits": pin(F.filter("signals", lambda s: s["status"] == S.HIT)),
        "score": F.least(F.lit(100), F.aggregate(
            F.map_values("family_weights"), F.lit(0), lambda a, w: a + w)),
    })
    staged = staged.withColumn("hard_rule", F.exists("_hits", lambda s: s["hard_rule"]))
    reached = F.col("score") >= scam_score
    share = F.col("score") / F.lit(100.0)
    staged = staged.withColumn(
        "level", F.when(F.col("hard_rule") | reached, S.LEVEL_SCAM).otherwise(S.LEVEL_UNCERTAIN))
    confidence = (
        F.when(F.col("hard_rule"), 0.99)
        .when(F.col("level") == S.LEVEL_SCAM, F.greatest(F.lit(0.7), share))
        .otherwise(F.least(F.lit(0.69), F.greatest(F.lit(0.2), share)))
    )
    # strongest first; the position keeps equal rows in evidence order
    telling = F.filter(F.transform("_hits", lambda s, i: F.struct(
        (~s["hard_rule"]).alias("soft"), (-s["weight"]).alias("light"), i.alias("at"),
        s["severity"].alias("severity"), s["summary"].alias("summary"))),
        lambda r: r["severity"] != S.INFO)
    reasons = F.slice(F.array_distinct(F.transform(
        F.array_sort(telling), lambda r: r["summary"])), 1, 3)
    names = lambda test: F.array_distinct(F.transform(
        F.filter("_hits", test), lambda s: s["check_name"]))
    suppressed = F.transform(F.filter("signals", lambda s: s["status"] == S.SUPPRESSED),
                             lambda s: s["check_name"])
    none = F.array().cast("array<string>")

    def rule(rule_id: str, fired: Column, observed: Column, threshold: int,
             fired_by: Column, calmed: Column) -> Column:
        return F.struct(
            F.lit(rule_id).alias("rule_id"),
            F.when(fired, S.FIRED).otherwise(S.NOT_FIRED).alias("status"),
            F.lit(ruleset_version).alias("version"), observed.cast("int").alias("observed"),
            F.lit(threshold).alias("threshold"), fired_by.alias("signal_names"),
            calmed.alias("suppressed_signal_names"))

    trace = F.array(
        rule("hard_evidence", F.col("hard_rule"), F.col("hard_rule"), 1,
             names(lambda s: s["hard_rule"]), none),
        rule("weighted_score", reached, F.col("score"), scam_score,
             names(lambda s: s["weight"] > 0), none),
        rule("shared_infrastructure_suppression", F.size(suppressed) > 0, F.size(suppressed), 1,
             F.when(F.size("_shared") > 0, F.array(F.lit("shared_infrastructure_context")))
             .otherwise(none), F.array_distinct(suppressed)),
    )
    return staged.withColumns({
        "confidence": confidence,
        "reasons": pin(F.when(F.size(reasons) > 0, reasons).otherwise(
            F.array(F.lit(fixed.DEFAULT_REASON)))),
        "rule_trace": pin(trace),
    }).drop("_hits", "_shared")


def verdict_from_rows(evidence: DataFrame, key: str = "message_id",
                      scam_score: int = S.SCAM_SCORE) -> DataFrame:
    """Verdict from a long evidence table: one shuffle on (message, family), both aggregations
    combine map-side. For evidence that already lives in storage."""
    hits = evidence.where(F.col("status") == S.HIT).select(
        key, _family(F.col("check_name")).alias("family"), "weight", "hard_rule")
    per_family = hits.groupBy(key, "family").agg(
        F.greatest(F.max("weight"), F.lit(0)).alias("weight"),
        F.bool_or("hard_rule").alias("hard_rule"))
    return per_family.groupBy(key).agg(
        F.least(F.lit(100), F.sum("weight")).cast("int").alias("score"),
        F.bool_or("hard_rule").alias("hard_rule"),
    ).withColumn("level", F.when(F.col("hard_rule") | (F.col("score") >= scam_score), S.LEVEL_SCAM)
                 .otherwise(S.LEVEL_UNCERTAIN))


# --- advice ------------------------------------------------------------------------------------
def advise(df: DataFrame) -> DataFrame:
    """Adds ``action`` (what to do now) and ``incident_steps``."""
    scam = F.col("level") == S.LEVEL_SCAM
    asked = F.col("requested_action")
    spam = F.col("message_type") == S.TYPE_SPAM
    delivery = F.col("message_type") == S.TYPE_TRANSACTIONAL
    steps = lambda name: F.array(*[F.lit(s) for s in fixed.ADVICE_STEPS[name]])
    return df.withColumns({
        "action": F.when(
            scam & asked.isin(S.ACTION_CODE, S.ACTION_CREDENTIALS, S.ACTION_TRANSFER),
            fixed.ADVICE_DO["secrets"])
        .when(scam & (asked == S.ACTION_INSTALL), fixed.ADVICE_DO["install"]).when(scam, fixed.ADVICE_DO["scam"])
        .when(spam, fixed.ADVICE_DO["spam"]).when(delivery, fixed.ADVICE_DO["delivery"]).otherwise(fixed.ADVICE_DO["other"]),
        "incident_steps": F.when(spam, steps("spam")).when(delivery, steps("delivery"))
        .when(asked == S.ACTION_INSTALL, steps("install"))
        .when(asked.isin(S.ACTION_CODE, S.ACTION_CREDENTIALS), steps("secrets"))
        .when(asked == S.ACTION_TRANSFER, steps("money")).otherwise(steps("other")),
    })
