"""Row numbers and running sums within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch

#: Rows of one group that a single task may order.
MOST_IN_TASK = 5_000_000


def ranked(
    df: DataFrame, groups: list[str], order: list[str], sums: tuple[str, ...] = (), descending: bool = False, most: int = MOST_IN_TASK
) -> DataFrame:
    """``df`` with ``rank`` (from 1), ``size`` (rows of the group) and ``upto_<c>``, the running sum of every ``c`` of
    ``sums``, in the order of ``order`` (which should be unique within a group; null group values are a group).

    A window per group, if the largest group has at most ``most`` rows. Beyond that the table is range-partitioned by
    (group, order), numbered within partitions, and each partition's part of a group starts where the parts before it
    end: a group with a third of all rows is ordered by as many tasks as its size asks for. The result is the same.
    """
    by: list[Column] = [F.desc(c) if descending else F.asc(c) for c in order]
    largest = df.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0
    if largest <= most:
        w = Window.partitionBy(*groups)
        up = w.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = df.withColumn("rank", F.row_number().over(w.orderBy(*by))).withColumn("size", F.count(F.lit(1)).over(w))
        return out.withColumns({f"upto_{c}": F.sum(c).over(up) for c in sums})
    scratch = Scratch(df.sparkSession, "ranked")
    rows = scratch.save(df.repartitionByRange(*groups, *by).withColumn("_part", F.spark_partition_id()), "parts")
    parts = rows.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_s_{c}") for c in sums))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*groups)
    start = {"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "size": F.sum("_n").over(every)}
    start |= {f"_start_{c}": F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)) for c in sums}
    parts = parts.withColumns(start).select("_part", *(F.col(g).alias(f"_g_{g}") for g in groups), *start)
    on = F.col("_part") == F.col("_p")
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    here = Window.partitionBy("_part", *groups).orderBy(*by)
    up = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("rank", F.row_number().over(here)).withColumns({f"upto_{c}": F.sum(c).over(up) for c in sums})
    rows = rows.join(parts.withColumnRenamed("_part", "_p"), on)
    rows = rows.withColumn("rank", F.col("rank") + F.col("_start")).withColumns({f"upto_{c}": F.col(f"upto_{c}") + F.col(f"_start_{c}") for c in sums})
    return rows.select(*df.columns, "rank", "size", *(f"upto_{c}" for c in sums))
