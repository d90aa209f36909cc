"""Fits over all groups at once (F1-F4, E33): every iteration is one aggregation, never a loop over groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import distributions as ds
from ..storage import Scratch
from . import metrics

GROUP = ["workload_id", "primitive"]


def mean_nll(points: DataFrame, at: DataFrame, groups: list[str]) -> DataFrame:
    """``at`` with ``nll``: the mean NLL of each group's ``points(z, target)`` at its ``temperature`` and, where ``at`` has it, ``bias``."""
    bias = F.col("bias") if "bias" in at.columns else None
    rows = points.join(at, groups).withColumn("p", ds.softmax(F.col("z"), F.col("temperature"), bias))
    nll = F.avg(-F.ln(F.greatest(F.element_at("p", F.col("target")), F.lit(ds.LEAST))))
    return at.join(rows.groupBy(*groups).agg(nll.alias("nll")), groups)


def fit_temperature(points: DataFrame, groups: list[str] = GROUP, low: float = 0.05, high: float = 10.0, tolerance: float = 1e-6, max_passes: int = 60) -> DataFrame:
    """``(*groups, temperature, nll)``: the least mean NLL (F1), clamped to [0.1, 10] and rounded to 4 places.

    NLL is convex in 1 / T. A pass gives slope and curvature of every group at its 1 / T in one aggregation, in the JVM; the
    slope's sign narrows the group's bracket, and a Newton step inside it, or else its middle, comes next. The driver holds
    four numbers a group.
    """
    spark = points.sparkSession
    points = Scratch(spark, "temperature").save(points.select(*groups, "z", "target"), "points")
    state = points.select(*groups).distinct().toPandas()
    if not len(state):
        return spark.createDataFrame([], points.select(*groups).schema.add("temperature", "double").add("nll", "double"))
    state = state.assign(a=1 / high, b=1 / low, at=1.0, open=True)
    mean = lambda x: ds.total(F.zip_with("p", x, lambda p, v: p * v))
    for k in range(max_passes):
        live = state[state.open]
        if not len(live):
            break
        rows = points.join(spark.createDataFrame(live[[*groups, "at"]]), groups).withColumn("p", ds.softmax(F.col("z"), 1 / F.col("at")))
        rows = rows.select(*groups, "target", "z", mean("z").alias("m"), mean(F.transform("z", lambda v: v * v)).alias("m2"))
        found = rows.groupBy(*groups).agg(F.avg(F.col("m") - F.element_at("z", F.col("target"))).alias("slope"), F.avg(F.col("m2") - F.col("m") * F.col("m")).alias("curve"))
        live = live.assign(_row=live.index).merge(found.toPandas(), on=groups).set_index("_row")
        a, b = np.where(live.slope < 0, live["at"], live.a), np.where(live.slope > 0, live["at"], live.b)
        step = live["at"] - live.slope / live.curve.where(live.curve > 0, np.nan)
        inside = (step > a) & (step < b)
        # at an end of the range to which the slope still points, the end is the answer
        new = np.where(inside, step, np.where((step >= b) & (b == 1 / low), b, np.where((step <= a) & (a == 1 / high), a, (a + b) / 2)))
        far = np.abs(new - live["at"]) > 0.05 * live["at"]
        if k == 4:  # those still far off may have no minimum inside: look at the end
            new = np.where(far & (live.slope < 0) & (b == 1 / low), b, np.where(far & (live.slope > 0) & (a == 1 / high), a, new))
        new = np.where(live.slope == 0, live["at"], new)
        done = (np.abs(new - live["at"]) <= tolerance * live["at"]) | (b - a <= tolerance * b)
        state.loc[live.index, ["a", "b", "at"]] = np.stack([a, b, new], axis=1)
        state.loc[live.index, "open"] = ~done
    state["temperature"] = (1 / state["at"]).clip(0.1, 10).round(4)
    return mean_nll(points, spark.createDataFrame(state[[*groups, "temperature"]]), groups).select(*groups, "temperature", "nll")


def _partial_sums(batches):
    """Count, loss, gradient and Hessian of softmax(x0 z + b) at each group's parameters, summed: one row a group and batch."""
    for pdf in batches:
        if len(pdf):
            for at, rows in pdf.groupby("_at", sort=False):
                z, x = np.stack(rows["z"].to_numpy()), np.asarray(rows["x"].iloc[0], float)
                target = rows["target"].to_numpy() - 1
                s = z * x[0] + x[1:]
                top = s.max(1, keepdims=True)
                logs = s - top - np.log(np.exp(s - top).sum(1, keepdims=True))
                p = np.exp(logs)
                g = p.copy()
                g[np.arange(len(z)), target] -= 1
                m = (p * z).sum(1, keepdims=True)
                k = z.shape[1]
                hess = np.empty((k + 1, k + 1))
                hess[0, 0] = ((p * z * z).sum(1) - m[:, 0] ** 2).sum()
                hess[0, 1:] = hess[1:, 0] = (p * (z - m)).sum(0)
                hess[1:, 1:] = np.diag(p.sum(0)) - p.T @ p
                grad = np.concatenate([[(g * z).sum()], g.sum(0)])
                values = np.concatenate([[len(z), -logs[np.arange(len(z)), target].sum()], grad, hess.ravel()])
                yield pd.DataFrame({"at": [at], "sums": [values.tolist()]})


def fit_vector(points: DataFrame, groups: list[str] = GROUP, max_passes: int = 60) -> DataFrame:
    """``(*groups, options, temperature, bias, nll)``: vector scaling (F2) per group and number of options, biases centred.

    The mean NLL of softmax(z / T + b) is convex in (1 / T, b). Gradient and Hessian are sums over rows: each damped Newton step
    of all groups is one aggregation of partial sums, and no group's rows come together. The driver holds the parameters of the
    groups and their sums, of size options squared.
    """
    spark, keys = points.sparkSession, [*groups, "options"]
    scratch = Scratch(spark, "vector")
    rows = scratch.save(points.withColumn("options", F.size("z")).select(*keys, "z", "target"), "points")
    kinds = rows.select(*keys).schema
    with_ = lambda ddl: StructType([*kinds.fields, *StructType.fromDDL(ddl).fields])
    names = rows.select(*keys).distinct().collect()
    if not names:
        return spark.createDataFrame([], with_("temperature double, bias array<double>, nll double"))
    state = {i: {"x": np.concatenate([[1.0], np.zeros(r.options)]), "value": np.inf, "damp": 1.0, "step": None} for i, r in enumerate(names)}
    live = set(state)
    schema = "at int, sums array<double>"
    for _ in range(max_passes):
        if not live:
            break
        at = spark.createDataFrame([(*names[i], i, _tried(state[i]).tolist()) for i in sorted(live)], with_("_at int, x array<double>"))
        part = rows.join(at, keys).select("_at", "x", "z", "target").mapInPandas(_partial_sums, schema)
        add = part.select("at", F.posexplode("sums").alias("i", "v")).groupBy("at", "i").agg(F.sum("v").alias("v"))
        for r in add.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).collect():
            if _newton(state[r["at"]], np.array([c["v"] for c in r.s])):
                live.discard(r["at"])
    fitted = []
    for i, s in state.items():
        x = s["x"]
        fitted.append((*names[i], float(np.clip(1 / x[0], 0.05, 10)), np.round(x[1:] - x[1:].mean(), 6).tolist(), float(s["value"])))
    return spark.createDataFrame(fitted, with_("temperature double, bias array<double>, nll double"))


def _tried(s: dict) -> np.ndarray:
    return s["x"] if s["step"] is None else s["x"] - s["damp"] * s["step"]


def _newton(s: dict, sums: np.ndarray) -> bool:
    """Takes the sums at the parameters tried into a group's state; whether it is done."""
    n, loss, k = sums[0], sums[1] / sums[0], len(s["x"])
    if s["step"] is not None and not loss <= s["value"]:  # too far: half the step
        s["damp"] /= 2
        return s["damp"] < 1e-8
    done = s["value"] - loss < 1e-12
    s["x"], s["value"], s["damp"] = _tried(s), loss, 1.0
    grad, hess = sums[2 : 2 + k] / n, sums[2 + k :].reshape(k, k) / n
    step = np.linalg.solve(hess + 1e-9 * np.eye(k), grad)
    while s["x"][0] - s["damp"] * step[0] <= 1e-3 and s["damp"] > 1e-8:
        s["damp"] /= 2
    s["step"] = step
    return done


def calibrated(s: DataFrame, groups: list[str] = GROUP) -> tuple[DataFrame, DataFrame]:
    """``(rows, fits)``: ``scored`` rows with calibrated ``p`` and ``confidence``, and per group ``temperature, method,
    vectors`` (F3). Where the scalar temperature leaves a Brier score above that of prevalence, vector scaling is fitted for
    each set of options, as a bias belongs to an option, and kept if the group's Brier score falls. ``hit`` is of the
    calibrated ``p``, since a bias can change the answer."""
    scratch = Scratch(s.sparkSession, "calibrated")
    s = scratch.save(s.select("example_id", "question_id", *groups, "reference", "ids", "z", "target"), "scored")
    fit = fit_temperature(s, groups).select(*groups, "temperature")
    scalar = s.join(fit, groups).withColumn("p", ds.softmax(F.col("z"), F.col("temperature"))).drop("temperature")
    first = scratch.save(metrics.proper_scores(scalar, groups).select(*groups, "brier", "prevalence_brier"), "first")
    weak = s.join(first.where("brier > prevalence_brier"), groups, "left_semi")
    sets = [*groups, "ids"]
    fits = scratch.save(fit_vector(weak, sets).select(*sets, F.col("temperature").alias("t"), "bias"), "fits")
    vector = weak.join(fits, sets).withColumn("p", ds.softmax(F.col("z"), F.col("t"), F.col("bias"))).drop("t", "bias")
    second = metrics.proper_scores(vector, groups).select(*groups, F.col("brier").alias("vector_brier"))
    better = scratch.save(first.join(second, groups).where("vector_brier < brier").select(*groups), "better")
    rows = scalar.join(better, groups, "left_anti").unionByName(vector.join(better, groups, "left_semi"))
    rows = rows.withColumn("confidence", F.array_max("p"))
    rows = rows.withColumn("hit", (ds.argmax_first(F.col("ids"), F.col("p")) == F.col("reference")).cast("int"))
    vectors = F.array_sort(F.collect_list(F.struct("ids", F.col("t").alias("temperature"), "bias"))).alias("vectors")
    vectors = fits.join(better, groups, "left_semi").groupBy(*groups).agg(vectors)
    out = fit.join(vectors, groups, "left")
    method = F.when(F.col("vectors").isNotNull(), "vector_scaling").otherwise("temperature_scaling")
    temperature = F.when(F.col("vectors").isNull(), F.col("temperature"))
    return rows, out.select(*groups, method.alias("method"), temperature.alias("temperature"), "vectors")


def prior_correction(s: DataFrame, groups: list[str] = GROUP) -> DataFrame:
    """``(*groups, option, shift)``: ln of the label share less ln of the mean probability, centred (E33); floors of one
    count and 1e-6. Options a group never shows have no row."""
    rows = s.select(*groups, "reference", F.explode(F.arrays_zip("ids", "p")).alias("o"))
    g = rows.groupBy(*groups, F.col("o.ids").alias("option")).agg(F.count_if(F.col("reference") == F.col("o.ids")).alias("k"), F.avg("o.p").alias("mean_p"))
    n = s.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    g = g.join(n, groups).withColumn("raw", F.ln(F.greatest("k", F.lit(1)) / F.col("n")) - F.ln(F.greatest("mean_p", F.lit(1e-6))))
    return g.select(*groups, "option", F.round(F.col("raw") - F.avg("raw").over(Window.partitionBy(*groups)), 6).alias("shift"))


def ordinal_loss(s: DataFrame, weight: float = 0.5, groups: list[str] = GROUP) -> DataFrame:
    """Mean of cross entropy plus ``weight`` times the expected squared distance in levels, scaled to [0, 1]."""
    k = F.size("p")
    far = F.aggregate(F.sequence(F.lit(1), k), F.lit(0.0), lambda a, i: a + F.element_at("p", i) * F.pow((i - F.col("target")) / (k - 1), F.lit(2.0)))
    loss = -F.ln(F.greatest(F.element_at("p", F.col("target")), F.lit(ds.LEAST))) + weight * far
    return s.where("primitive = 'score' and size(p) > 1").groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"))
