"""Two arms side by side (D1, D3, E22-E25), order ensembles (B9) and order bias."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as ds

KEY = ["example_id", "question_id"]
TIE_BAND = 2.80
MOST_DEVIATION = 0.01


def paired(a: DataFrame, b: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Full outer pairing: columns of either arm as ``<c>_a`` and ``<c>_b``, and ``side``: both, a or b."""
    x = a.select(*keys, *(F.col(c).alias(f"{c}_a") for c in a.columns if c not in keys), F.lit(1).alias("in_a"))
    y = b.select(*keys, *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys), F.lit(1).alias("in_b"))
    out = x.join(y, keys, "full_outer")
    side = F.when(F.col("in_a").isNull(), "b").when(F.col("in_b").isNull(), "a").otherwise("both")
    return out.withColumn("side", side).drop("in_a", "in_b")


def with_status(pairs: DataFrame, strict: bool = False) -> DataFrame:
    """``paired`` rows with ``status`` (H2): compared, only_a, only_b, or labels_differ where the arms' options are not the
    same. ``strict``: a row that is not compared ends the query with an error that names it."""
    differ = F.when(F.col("ids_a").eqNullSafe(F.col("ids_b")), "compared").otherwise("labels_differ")
    status = F.when(F.col("side") == "both", differ).otherwise(F.concat(F.lit("only_"), F.col("side")))
    if strict:
        what = F.concat(F.lit("arms cannot be compared, "), status, F.lit(": "), F.concat_ws("/", *KEY))
        status = F.when(status == "compared", status).otherwise(F.raise_error(what))
    return pairs.withColumn("status", status)


def equivalence_rows(pairs: DataFrame, threshold: float = 0.9, strict: bool = False) -> DataFrame:
    """Per decision of either arm (D3): ``status`` (``with_status``), and where both are compared argmax agreement, largest
    probability deviation, margin, tie band, policy flip; null elsewhere. Needs ``ids, z`` of either arm."""
    out = with_status(pairs, strict)
    both = F.col("status") == "compared"
    for s in "ab":
        out = out.withColumn(f"p_{s}", F.when(both, ds.softmax(F.col(f"z_{s}"))))
        out = out.withColumn(f"selected_{s}", ds.argmax_first(F.col(f"ids_{s}"), F.col(f"p_{s}")))
    flip = (F.array_max("p_a") >= threshold) != (F.array_max("p_b") >= threshold)
    near = F.coalesce(ds.margin(F.col("z_a")) <= TIE_BAND, F.lit(False))
    return out.select(
        *KEY, F.coalesce("workload_id_a", "workload_id_b").alias("workload_id_a"), "status", (F.col("selected_a") == F.col("selected_b")).alias("argmax_agrees"),
        ds.max_distance(F.col("p_a"), F.col("p_b")).alias("deviation"), F.when(both, ds.margin(F.col("z_a"))).alias("margin"),
        F.when(both, near).alias("in_tie_band"), flip.alias("policy_flip"),
    )


def equivalence_summary(rows: DataFrame, group: str) -> DataFrame:
    """Per group and overall (group null) in one rollup (E25); every row is gated, tie band or not, and a decision that only
    one arm has, or with other options, fails the gate, as does nothing to compare."""
    of = lambda x: F.count_if(F.col("status") == x).alias(x)
    out = rows.rollup(group).agg(
        of("compared"), F.count_if("argmax_agrees").alias("agreements"), F.max("deviation").alias("deviation"),
        F.count_if("policy_flip").alias("flips"), F.count_if("in_tie_band").alias("tie_band"), of("only_a"), of("only_b"), of("labels_differ"),
    )
    whole = (F.col("compared") > 0) & (F.col("only_a") + F.col("only_b") + F.col("labels_differ") == 0)
    passed = whole & (F.col("agreements") == F.col("compared")) & (F.col("deviation") <= MOST_DEVIATION) & (F.col("flips") == 0)
    return out.withColumn("gate_passed", F.coalesce(passed, F.lit(False)))


def speed_gate(a: DataFrame, b: DataFrame, groups: list[str], least: float = 2.0, most_p95: float = 2000.0) -> DataFrame:
    """``(*groups, speedup, gate_passed)`` of two arms' ``median, p95`` (E22): the median of ``b`` over that of ``a``, infinite where
    that of ``a`` is 0; the gate asks for ``least`` and a p95 of ``a`` of ``most_p95`` at most. Groups of one arm only fail it."""
    x = a.select(*groups, F.col("median").alias("a"), F.col("p95").alias("p95"))
    rows = x.join(b.select(*groups, F.col("median").alias("b")), groups, "full_outer")
    speedup = F.when(F.col("a") == 0, F.when(F.col("b").isNotNull(), F.lit(float("inf")))).otherwise(F.col("b") / F.col("a"))
    rows = rows.withColumn("speedup", speedup)
    passed = (F.col("speedup") >= least) & (F.col("p95") <= most_p95)
    return rows.select(*groups, "speedup", F.coalesce(passed, F.lit(False)).alias("gate_passed"))


def cyclic_ensemble(d: DataFrame, second: DataFrame, strict: bool = False) -> DataFrame:
    """Mean logits of two option orders of one choice question, aligned by option id (B9). A decision of one arm only, or with
    other options, has its ``status`` and nulls."""
    both = with_status(paired(d, second), strict)
    there = F.col("status") == "compared"
    z = F.when(there, F.zip_with("z_a", "z_b", lambda a, b: (a + b) / 2))
    both = both.withColumn("p", ds.softmax(z))
    return both.select(
        *KEY, "status", ds.argmax_first(F.col("ids_a"), F.col("p")).alias("selected"), F.array_max("p").alias("confidence"),
        F.when(there, ds.max_distance(ds.softmax(F.col("z_a")), ds.softmax(F.col("z_b")))).alias("discrepancy"),
    )


def order_bias(d: DataFrame, groups: list[str]) -> DataFrame:
    """By position of the options: mean probability and share of predictions at the position (part of E26: one order
    only, so no flip rate and no figures between orders). Needs ``ids, p, prediction``."""
    rows = d.select(*groups, "prediction", F.posexplode(F.arrays_zip("ids", "p")).alias("position", "o"))
    return rows.groupBy(*groups, "position").agg(
        F.count(F.lit(1)).alias("shown"), F.avg("o.p").alias("mean_p"), F.avg((F.col("o.ids") == F.col("prediction")).cast("int")).alias("share")
    )


def bias_finding(shares: DataFrame, groups: list[str], least: float = 0.10) -> DataFrame:
    """Position bias where the last position's share exceeds the others' by ``least``."""
    last = F.max(F.struct("position", "share"))["share"]
    top = shares.join(shares.groupBy(*groups).agg(F.max("position").alias("last")), groups)
    out = top.groupBy(*groups).agg(last.alias("last_share"), F.max(F.when(F.col("position") < F.col("last"), F.col("share"))).alias("other_share"))
    return out.withColumn("position_bias", F.coalesce(F.col("last_share") - F.col("other_share") >= least - 1e-12, F.lit(False)))
