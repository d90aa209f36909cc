"""Evaluation metrics by group (2.E): each is one aggregation over decisions, or a label table joined to few rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as ds
from .ranks import ranked

GROUP = ["workload_id", "primitive"]


def label_counts(d: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """``(*groups, label, tp, predicted, support)`` over the union of references and predictions. One pass: a decision
    counts for its reference and its prediction, summed before the shuffle."""
    hit = F.col("reference") == F.col("prediction")
    pairs = F.array(
        F.struct(F.col("reference").alias("label"), hit.cast("int").alias("tp"), F.lit(0).alias("predicted"), F.lit(1).alias("support")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).alias("tp"), F.lit(1).alias("predicted"), F.lit(0).alias("support")),
    )
    rows = d.where("reference is not null and prediction is not null").select(*groups, F.inline(pairs))
    return rows.groupBy(*groups, "label").agg(*(F.sum(c).alias(c) for c in ("tp", "predicted", "support")))


def per_label(d: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """Precision, recall, F1 and support (E4); a zero denominator gives 0."""
    safe = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    rows = label_counts(d, groups).withColumn("precision", safe("tp", "predicted")).withColumn("recall", safe("tp", "support"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("support")), F.lit(0.0))
    return rows.withColumn("f1", f1)


def classification(d: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """Accuracy, macro-F1 and balanced accuracy (E1, E2), averaged over all labels seen on either side."""
    rows = per_label(d, groups)
    return rows.groupBy(*groups).agg(
        F.sum("support").alias("n"), (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"),
    )


def majority(d: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """Share of the most frequent reference, and how far accuracy lies above it (E5)."""
    rows = label_counts(d, groups)
    out = rows.groupBy(*groups).agg((F.max("support") / F.sum("support")).alias("majority"), (F.sum("tp") / F.sum("support")).alias("accuracy"))
    return out.withColumn("margin", F.col("accuracy") - F.col("majority"))


def scored(d: DataFrame) -> DataFrame:
    """Decisions with a reference among their options: ``ids, p, z, target`` (1-based), confidence and hit."""
    rows = ds.with_options(d.where("reference is not null"))
    rows = rows.withColumn("target", F.array_position("ids", F.col("reference")).cast("int")).where("target > 0")
    return rows.withColumn("confidence", F.array_max("p")).withColumn("hit", (ds.argmax_first(F.col("ids"), F.col("p")) == F.col("reference")).cast("int"))


def proper_scores(s: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """Mean NLL, multiclass Brier score, and the Brier score of constant prevalence (E8-E10) of ``scored`` rows."""
    p = F.element_at("p", F.col("target"))
    brier = ds.total(F.transform("p", lambda x: x * x)) - 2 * p + 1
    rows = s.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(-F.ln(F.greatest(p, F.lit(ds.LEAST)))).alias("nll"), F.avg(brier).alias("brier"))
    share = s.groupBy(*groups, "reference").agg(F.count(F.lit(1)).alias("k"))
    prevalence = share.groupBy(*groups).agg((1 - F.sum(F.pow("k", F.lit(2.0))) / F.pow(F.sum("k"), F.lit(2.0))).alias("prevalence_brier"))
    return rows.join(prevalence, groups)


def reliability_bins(s: DataFrame, bins: int = 10, equal_count: bool = True, groups: list[str] = GROUP) -> DataFrame:
    """Bins of confidence (E11-E13): chunks of ``ceil(n / bins)`` rows in order of confidence, ties by key; or equal
    widths, empty bins left out."""
    if equal_count:
        rows = ranked(s.select(*groups, "confidence", "hit", "example_id", "question_id"), groups, ["confidence", "example_id", "question_id"])
        rows = rows.select(*groups, "confidence", "hit", F.floor((F.col("rank") - 1) / F.ceil(F.col("size") / F.lit(float(bins)))).alias("bin"))
    else:
        rows = s.select(*groups, "confidence", "hit", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).alias("bin"))
    out = rows.groupBy(*groups, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg("hit").alias("accuracy"),
        F.min("confidence").alias("least"), F.max("confidence").alias("greatest"),
    )
    return out.withColumn("difference", F.abs(F.col("mean_confidence") - F.col("accuracy")))


def calibration_error(s: DataFrame, bins: int = 10, equal_count: bool = True, groups: list[str] = GROUP) -> DataFrame:
    rows = reliability_bins(s, bins, equal_count, groups)
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("bins"), (F.sum(F.col("n") * F.col("difference")) / F.sum("n")).alias("ece"))


def level(c: str) -> F.Column:
    """Number in a level id such as ``score-3``."""
    return F.regexp_extract(c, r"(\d+)$", 1).try_cast("double")


def normalised_error(d: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """Mean of |expected - reference value| over the range of the levels (E6); score decisions only."""
    rows = ds.with_options(d.where("primitive = 'score' and reference is not null"))
    v = F.transform("ids", lambda i: F.regexp_extract(i, r"(\d+)$", 1).try_cast("double"))
    rows = rows.withColumn("v", v).withColumn("range", F.array_max("v") - F.array_min("v")).where("range > 0")
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(ds.expected(F.col("p"), F.col("v")) - level("reference")) / F.col("range")).alias("nmae")
    )


def weighted_kappa(d: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """Quadratic weighted kappa (E7) from sums and sums of squares: the weights (i-j)^2 open up into moments, so no
    confusion grid is needed. Expected disagreement 0: 1 if the observed is 0 too, else 0."""
    i, j = level("reference"), level("prediction")
    rows = d.where("primitive = 'score' and reference is not null and prediction is not null").select(*groups, i.alias("i"), j.alias("j"))
    m = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("i") - F.col("j")) * (F.col("i") - F.col("j"))).alias("observed"),
        F.avg(F.col("i") * F.col("i")).alias("ii"), F.avg(F.col("j") * F.col("j")).alias("jj"), F.avg("i").alias("mi"), F.avg("j").alias("mj"),
    )
    m = m.withColumn("expected", F.expr("ii + jj - 2 * mi * mj"))
    kappa = F.expr("case when expected < 1e-12 then if(observed < 1e-12, 1D, 0D) else 1 - observed / expected end")
    return m.select(*groups, "n", kappa.alias("kappa"))


def latency(d: DataFrame, value: str, groups: list[str] = GROUP) -> DataFrame:
    """Median (mean of the middle two) and p95 by floor rank ``sorted[int(.95 (n-1))]`` (E21), by rank: nothing is
    collected into arrays, and a group too large for a task is ordered by several (``ranked``)."""
    rows = d.where(f"{value} >= 0 and {value} < double('infinity')").select(*groups, F.col(value).alias("x"))
    rows = ranked(rows, groups, ["x"]).select(*groups, "x", (F.col("rank") - 1).alias("i"), F.col("size").alias("n"))
    mid = F.expr("i = floor((n - 1) / 2) or i = floor(n / 2)")
    return rows.groupBy(*groups).agg(
        F.max("n").alias("n"), F.avg(F.when(mid, F.col("x"))).alias("median"),
        F.max(F.when(F.expr("i = cast(floor(0.95D * (n - 1)) as bigint)"), F.col("x"))).alias("p95"),
    )
