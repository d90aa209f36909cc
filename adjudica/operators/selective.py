"""Selective acceptance: thresholds, risk and coverage, gates, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.binomial import bound_is_at_most, error_bound
from .ranks import ranked

GROUP = ["workload_id", "primitive"]
# fixed values: candidate thresholds besides the confidences themselves; targets
GRID = (0.5, 0.7, 0.8, 0.85, 0.9, 0.95)
MOST_ERROR, LEAST_COVERAGE, LEAST_ACCEPTED = 0.05, 0.5, 59


def rates(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("coverage", F.coalesce(F.try_divide("accepted", "n"), F.lit(0.0)))
    return rows.withColumn("error_rate", F.coalesce(F.try_divide("errors", "accepted"), F.lit(0.0)))


def at_threshold(s: DataFrame, threshold: float, groups: list[str] = GROUP) -> DataFrame:
    """Coverage, error and its bound among ``confidence >= threshold``."""
    take = F.col("confidence") >= threshold
    out = s.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(take).alias("accepted"), F.count_if(take & (F.col("hit") == 0)).alias("errors"))
    return rates(out).withColumn("bound", error_bound("errors", "accepted"))


def by_disposition(d: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """The same from the recorded disposition (E16), with its gates."""
    take = F.col("answer.disposition") == "accept"
    d = d.where("reference is not null")
    wrong = F.lower("reference") != F.lower("prediction")
    out = d.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.count_if(take).alias("accepted"), F.count_if(take & wrong).alias("errors"))
    out = rates(out).withColumn("bound", error_bound("errors", "accepted"))
    gate = (F.col("coverage") >= LEAST_COVERAGE) & (F.col("bound") <= MOST_ERROR)
    return out.withColumn("gate_passed", gate).withColumn("enough", F.col("accepted") >= LEAST_ACCEPTED)


def sweep(s: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """``(*groups, threshold, n, accepted, errors)`` for every candidate (E17): confidences rounded to 4 places (half up, in double
    arithmetic) and the grid. Counts per distinct value first, then one running sum from the top: n log n, not candidates times rows."""
    values = s.groupBy(*groups, "confidence").agg(F.count(F.lit(1)).alias("k"), F.sum(1 - F.col("hit")).alias("e"))
    grid = s.select(*groups).distinct().select(*groups, F.explode(F.array(*(F.lit(float(x)) for x in GRID))).alias("t"))
    marks = values.select(*groups, (F.floor(F.col("confidence") * 10000 + 0.5) / 10000).alias("t")).unionByName(grid).distinct()
    zero = F.lit(0).cast("long")
    both = values.select(*groups, F.col("confidence").alias("t"), "k", "e", F.lit(0).alias("mark")).unionByName(
        marks.select(*groups, "t", zero.alias("k"), zero.alias("e"), F.lit(1).alias("mark"))
    )
    both = both.groupBy(*groups, "t").agg(F.sum("k").alias("k"), F.sum("e").alias("e"), F.max("mark").alias("mark"))
    n = s.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    both = ranked(both, groups, ["t"], ("k", "e"), descending=True).where("mark = 1").join(n, groups)
    return both.select(*groups, F.col("t").alias("threshold"), "n", F.col("upto_k").alias("accepted"), F.col("upto_e").alias("errors"))


def fitted_threshold(s: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """The lowest threshold with error and coverage on target; else the one of most coverage with error on target; else
    0.9 (E17)."""
    rows = rates(sweep(s, groups))
    low = F.col("error_rate") <= MOST_ERROR
    some = low & (F.col("accepted") > 0)
    out = rows.groupBy(*groups).agg(
        F.min(F.when(low & (F.col("coverage") >= LEAST_COVERAGE), F.col("threshold"))).alias("good"),
        F.max(F.when(some, F.struct("coverage", (-F.col("threshold")).alias("t")))).alias("fallback"),
    )
    return out.select(*groups, F.coalesce("good", -F.col("fallback.t"), F.lit(0.9)).alias("threshold"))


def certified_threshold(s: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """The lowest threshold whose coverage, bound and number accepted pass (E18); without one, review only, with the
    figures at 1.01: nothing accepted, bound 1. In-sample: the same rows choose and certify."""
    rows = rates(sweep(s, groups)).where(f"coverage >= {LEAST_COVERAGE} and accepted >= {LEAST_ACCEPTED} and error_rate <= {MOST_ERROR}")
    rows = rows.where(bound_is_at_most("errors", "accepted", MOST_ERROR))
    best = rows.groupBy(*groups).agg(F.min_by(F.struct("threshold", "accepted", "errors", "coverage"), "threshold").alias("b"))
    best = best.withColumn("bound", error_bound("b.errors", "b.accepted"))
    out = s.select(*groups).distinct().join(best, groups, "left")
    return out.select(
        *groups, F.when(F.col("b").isNull(), "review_only").otherwise("threshold").alias("policy"), F.col("b.threshold").alias("threshold"),
        F.coalesce("b.accepted", F.lit(0)).alias("accepted"), F.coalesce("b.coverage", F.lit(0.0)).alias("coverage"), F.coalesce("bound", F.lit(1.0)).alias("bound"),
    )


def drift(d: DataFrame, targets: DataFrame, groups: list[str] = GROUP, warn_at: float = 0.8, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """Alerts on accepted decisions (E29) against ``targets(*groups, target_coverage, target_bound)``; a missing target is
    the default. Bound above target: critical; at ``warn_at`` of it or more: warning. Coverage below its minimum: critical;
    more than 0.05 below target: warning. Recalibrate on any critical alert or on two."""
    out = by_disposition(d, groups).drop("gate_passed", "enough").join(targets, groups, "left")
    bound = F.coalesce("target_bound", F.lit(MOST_ERROR))
    some = F.col("accepted") > 0
    delta = F.col("coverage") - F.coalesce("target_coverage", F.lit(least_coverage))
    out = out.withColumn("error_alert", F.when(some & (F.col("bound") > bound), "ERROR_BOUND_BREACH").when(some & (F.col("bound") >= bound * warn_at), "ERROR_BOUND_WARNING"))
    out = out.withColumn("coverage_alert", F.when(F.col("coverage") < least_coverage, "COVERAGE_BELOW_MINIMUM").when(delta < -0.05, "COVERAGE_DROP"))
    critical = F.coalesce(F.col("error_alert") == "ERROR_BOUND_BREACH", F.lit(False)) | F.coalesce(F.col("coverage_alert") == "COVERAGE_BELOW_MINIMUM", F.lit(False))
    two = F.col("error_alert").isNotNull() & F.col("coverage_alert").isNotNull()
    return out.withColumn("recalibrate", critical | two).drop("target_coverage", "target_bound")
