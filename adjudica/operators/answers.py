"""From logits to answers: profile evidence and compatibility, calibrated answers, label mass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import distributions as ds
from ..functions.binomial import bound_is_at_most

#: What a profile was fitted for; a runtime that does not say (null) agrees with any.
RUNTIME = ("artifact_id", "model_id", "revision", "precision", "prompt_version", "label_version")
# fixed values: limits of the evidence
MOST_ECE, MOST_ERROR, LEAST_COVERAGE, LEAST_ACCEPTED = 0.05, 0.05, 0.5, 59


def has_evidence(metrics_type: StructType, m: str = "metrics", whole: bool = True) -> Column:
    """Whether a profile's metrics show that it may accept (B15): every gate passed, ECE, Brier, coverage and counts within
    limits, and the bound both as recorded and computed anew from the counts. Null metrics or a null in any of them: false.

    ``metrics_type``: the struct's type. ``whole``: a field that the struct lacks is missing evidence, so nothing passes;
    else the conjuncts of absent fields are left out.
    """
    rules = {
        "gate_ece_passed": "{m}.gate_ece_passed", "gate_brier_passed": "{m}.gate_brier_passed", "gate_selective_passed": "{m}.gate_selective_passed",
        "samples_sufficient_for_gate": "{m}.samples_sufficient_for_gate", "ece": f"{{m}}.ece between 0 and {MOST_ECE}D",
        "prevalence_brier_score": "{m}.brier_score between 0 and {m}.prevalence_brier_score and {m}.prevalence_brier_score < double('infinity')",
        "coverage": f"{{m}}.coverage between {LEAST_COVERAGE}D and 1", "accepted_error_95_upper_bound": f"{{m}}.accepted_error_95_upper_bound between 0 and {MOST_ERROR}D",
        "errors_in_accepted": "{m}.errors_in_accepted between 0 and {m}.accepted_count", "accepted_count": f"{{m}}.accepted_count between {LEAST_ACCEPTED} and {{m}}.sample_count",
        "sample_count": f"{{m}}.accepted_count / {{m}}.sample_count >= {LEAST_COVERAGE}D",
    }
    there = set(metrics_type.fieldNames())
    if whole and not {*rules, "brier_score"} <= there:
        return F.lit(False)
    out = bound_is_at_most(F.coalesce(f"{m}.errors_in_accepted", F.lit(-1)), F.coalesce(f"{m}.accepted_count", F.lit(0)), MOST_ERROR)
    for field, rule in rules.items():
        if field in there:
            out = out & F.expr(rule.format(m=m))
    return F.coalesce(out, F.lit(False))


def compatible(profile: str = "profile", runtime: str = "runtime", primitive: str = "primitive", options: str = "options") -> Column:
    """Whether a profile fits a question and the runtime (B14): the primitive equal, the number of options within the profile's
    range, ends included, and each of ``RUNTIME`` equal where the runtime says it. False with a null profile."""
    ok = (F.col(f"{profile}.primitive") == F.col(primitive)) & F.col(options).between(F.col(f"{profile}.card_min"), F.col(f"{profile}.card_max"))
    for k in RUNTIME:
        ok = ok & (F.col(f"{runtime}.{k}").isNull() | (F.col(f"{profile}.{k}") == F.col(f"{runtime}.{k}")))
    return F.coalesce(ok, F.lit(False))


def with_profile(d: DataFrame, profiles: DataFrame, whole: bool = True) -> DataFrame:
    """``d(profile_id, primitive, ids, runtime, ...)`` with the profile asked for, ``status``: no_profile, no_evidence,
    incompatible or validated (D2). A left join on the id: a decision of no or an unknown profile keeps its row."""
    f = profiles.withColumn("evidence", has_evidence(profiles.schema["metrics"].dataType, "metrics", whole))
    f = f.select("profile_id", F.struct("primitive", "card_min", "card_max", *RUNTIME, "temperature", "bias", "policy", "evidence").alias("profile"))
    out = d.join(f, "profile_id", "left").withColumn("options", F.size("ids"))
    status = F.when(F.col("profile").isNull(), "no_profile").when(~F.col("profile.evidence"), "no_evidence")
    return out.withColumn("status", status.when(~compatible(), "incompatible").otherwise("validated"))


def calibrated_answers(d: DataFrame, profiles: DataFrame, whole: bool = True) -> DataFrame:
    """One answer per decision (B16). ``d``: ``profile_id, primitive, ids, z, runtime`` and, null where there is none,
    ``discrepancy`` and ``values`` (of a score's options).

    A validated profile rescales the logits (only where its temperature is not 1 or it has a bias) and its policy decides
    between accept and review; any other status leaves the raw distribution, ``uncalibrated`` and ``review``. A Boolean's
    value is whether p(true) reaches 0.5; a choice's is its selected option; a score has its level and expected value. Ties:
    the first option of a raw distribution, the greatest id of a rescaled one. Columns of ``d`` stay, with ``status``,
    ``calibration_status, disposition, p, value, p_true, level_id, expected_value``.
    """
    out = with_profile(d, profiles, whole)
    valid = F.col("status") == "validated"
    rescale = valid & ((F.col("profile.temperature") != 1.0) | F.col("profile.bias").isNotNull())
    p = F.when(rescale, ds.softmax(F.col("z"), F.col("profile.temperature"), F.col("profile.bias"))).otherwise(ds.softmax(F.col("z")))
    out = out.withColumn("p", p)
    chosen = F.when(rescale, ds.argmax_greatest_id(F.col("ids"), F.col("p"))).otherwise(ds.argmax_first(F.col("ids"), F.col("p")))
    p_true = F.when(F.col("primitive") == "boolean", F.element_at("p", F.array_position("ids", F.lit("true")).cast("int")))
    out = out.withColumns({
        "calibration_status": F.when(valid, "validated").otherwise("uncalibrated"),
        "disposition": F.when(valid, ds.acceptance(F.col("p"), F.col("profile.policy"), F.col("discrepancy"))).otherwise("review"),
        "p_true": p_true,
        "value": F.when(F.col("primitive") == "boolean", (p_true >= 0.5).cast("string")).when(F.col("primitive") == "choice", chosen),
        "level_id": F.when(F.col("primitive") == "score", chosen),
        "expected_value": F.when(F.col("primitive") == "score", ds.expected(F.col("p"), F.col("values"))),
    })
    return out.drop("profile", "options")


def label_mass(vocabulary: Column, z: Column, allowed: Column) -> Column:
    """The share of a softmax over a whole vocabulary that falls on the allowed labels (B11). Null without logits; labels that
    the vocabulary lacks have none; 0 if it has none of them."""
    p = ds.softmax(z)
    mine = F.filter(F.arrays_zip(vocabulary.alias("v"), p.alias("p")), lambda x: F.array_contains(allowed, x["v"]))
    return F.when(F.size(z) > 0, F.aggregate(mine, F.lit(0.0), lambda s, x: s + x["p"]))


def label_mass_gate(rows: DataFrame, mass: str, groups: list[str], least: float = 0.9, strict: bool = False) -> DataFrame:
    """``(*groups, n, missing, below, least_mass, mean_mass, gate_passed)`` (B12): a mass not measured fails the gate as one below
    ``least`` does. ``strict``: either ends the query with an error."""
    m = F.col(mass)
    if strict:
        bad = m.isNull() | (m < least)
        m = F.when(bad, F.raise_error(F.concat(F.lit("label mass missing or too small: "), F.coalesce(m.cast("string"), F.lit("null"))))).otherwise(m)
    out = rows.withColumn("_m", m).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_m").isNull()).alias("missing"), F.count_if(F.col("_m") < least).alias("below"),
        F.min("_m").alias("least_mass"), F.avg("_m").alias("mean_mass"),
    )
    return out.withColumn("gate_passed", (F.col("missing") == 0) & (F.col("below") == 0))
