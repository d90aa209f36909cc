"""Logit sources: a source adds ``ids`` and ``z`` (aligned option ids and logits) to rows. Recorded distributions are one
(``distributions.with_options``), class centroids of embeddings another; a model would be a third, via ``mapInPandas``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as ds
from ..storage import Scratch

LogitSource = Callable[[DataFrame], DataFrame]


def centroid_source(train: DataFrame, vector: str = "embedding", label: str = "label", most_classes: int = 1000) -> LogitSource:
    """Logit of a class: dot product with the mean training vector of the class. One aggregation; the centroids travel as one
    row, of ``most_classes`` at most: more raise ValueError. Rows with a null vector get null logits."""
    each = train.where(F.col(vector).isNotNull()).select(label, F.posexplode(vector).alias("k", "x"))
    means = each.groupBy(label, "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    means = means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("centroid"))
    means = Scratch(train.sparkSession, "centroids").save(means, "means")
    if (n := means.count()) > most_classes:
        raise ValueError(f"{n} classes; their centroids are broadcast up to {most_classes}")
    one = means.agg(F.array_sort(F.collect_list(F.struct(F.col(label).cast("string").alias("id"), "centroid"))).alias("classes")).withColumn("_one", F.lit(1))

    def source(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")
        z = F.transform("classes", lambda c: ds.total(F.zip_with(F.col(vector), c["centroid"], lambda a, b: a.cast("double") * b)))
        return rows.withColumn("ids", F.transform("classes", lambda c: c["id"])).withColumn("z", z).drop("classes")

    return source
