"""Problem 3: exact percentiles of large numeric columns, and day summaries that combine.

Bisection. Every (group, column, percentile) keeps an interval of values that holds its target rank, and the number of
rows below it. A pass cuts each open interval at ``cells - 1`` midpoints (``log2(cells)`` halvings at once), counts the
rows below each, and keeps the one cell with the rank, shrunk to the least and greatest value in it; a percentile is
done when these are equal. Intervals of one group never overlap, so a row is counted once a pass, in partial sums
before any shuffle: a group with a third of all rows is no different from others. What a pass keeps is one row per
percentile.

Day summaries are the first passes of the same bisection on a grid common to all days (``2 ** bits`` cells an octave):
counts of a day add up with those of any other, and the percentiles of the sum lie within ``2 ** (1 / 2 ** bits)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch

PERCENTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def measured(df: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """``(*groups, metric, value)``: one row per measured number. Null, NaN, infinite and negative are not measured."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in values)
    rows = df.select(*groups, F.expr(f"stack({len(values)}, {pairs}) as (metric, value)"))
    return rows.where("value >= 0 and value < double('infinity')")


def _same(a: str, b: str, keys: list[str]):
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return on


def _within(rows: DataFrame, left: DataFrame, keys: list[str], few: bool, share: int = 1000) -> DataFrame:
    """Rows ``r`` with the open interval ``i`` of their group that holds them. Few intervals are broadcast. Of many, those of groups
    with more than 1/``share`` of all rows are (fewer than ``share`` groups, by pigeonhole), and the rest meet by a shuffle in
    which no group is large."""
    on = _same("r", "i", keys) & F.expr("r.value between i.lo and i.hi")
    if few:
        return rows.alias("r").join(F.broadcast(left).alias("i"), on)
    total = rows.count()
    large = left.where(F.col("n") * share > total)
    names = F.broadcast(large.select(*keys).distinct())
    rest = rows.alias("r").join(names.alias("i"), _same("r", "i", keys), "left_anti")
    parts = (rows, F.broadcast(large)), (rest, left.where(F.col("n") * share <= total))
    out = [a.alias("r").join(b.alias("i"), on).select(F.struct("r.*").alias("r"), F.struct("i.*").alias("i")) for a, b in parts]
    return out[0].unionByName(out[1])


def bisect_percentiles(
    df: DataFrame, groups: list[str], values: list[str], percentiles: tuple[float, ...] = PERCENTILES, cells: int = 256,
    tolerance: float = 0.0, most_broadcast: int = 200_000, max_passes: int = 80,
) -> DataFrame:
    """``(*groups, metric, p, n, value)``: the value of rank ``max(1, ceil(p n))`` among the ``n`` measured ones.

    Exact with ``tolerance=0``; else a pass stops at intervals whose ends differ by at most that share of the upper end,
    and ``value`` is the upper end. A null group is a group. Groups without a measured value, and empty tables, have no
    rows. Ties and repeated rows count as often as they occur. ``most_broadcast`` chooses between ways with equal results
    (``_within``).
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "percentiles")
    keys = [*groups, "metric"]
    rows = scratch.save(measured(df, groups, values), "rows")
    ps = F.explode(F.array(*(F.lit(float(p)) for p in percentiles))).alias("p")
    state = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    state = state.select(*keys, "n", "lo", "hi", F.lit(0).cast("long").alias("below"), ps)
    state = state.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n"))))
    state = scratch.save(state, "state0")
    open_ = F.col("hi") - F.col("lo") > tolerance * F.abs("hi")
    for k in range(1, max_passes + 1):
        left = state.where(open_).select(*keys, "n", "lo", "hi", "below").distinct()
        left = scratch.save(left, f"open{k}")
        count = left.count()
        if not count:
            break
        hit = _within(rows, left, keys, count <= most_broadcast)
        cell = f"least({cells - 1}L, cast(floor((r.value / 2 - i.lo / 2) / (i.hi / 2 - i.lo / 2) * {cells}) as bigint)) as cell"
        hit = hit.select(*(F.col(f"i.{c}").alias(c) for c in [*keys, "lo", "below"]), F.col("r.value").alias("value"), F.expr(cell))
        hit = hit.groupBy(*keys, "lo", "below", "cell").agg(
            F.count(F.lit(1)).alias("rows"), F.min("value").alias("cell_lo"), F.max("value").alias("cell_hi")
        )
        upto = Window.partitionBy(*keys, "lo").orderBy("cell")
        hit = hit.withColumn("upto", F.col("below") + F.sum("rows").over(upto)).withColumn("under", F.col("upto") - F.col("rows"))
        s, h = state.where(open_).alias("s"), hit.alias("h")
        moved = s.join(h, _same("s", "h", [*keys, "lo"]) & F.expr("s.rank > h.under and s.rank <= h.upto"))
        moved = moved.select(
            *(F.col(f"s.{c}").alias(c) for c in [*keys, "n"]), F.col("cell_lo").alias("lo"), F.col("cell_hi").alias("hi"),
            F.col("under").alias("below"), F.col("s.p").alias("p"), F.col("s.rank").alias("rank"),
        )
        state = scratch.save(state.where(~open_).unionByName(moved), f"state{k}")
        scratch.drop(f"state{k - 1}")
        scratch.drop(f"open{k}")
    else:
        raise RuntimeError(f"intervals still open after {max_passes} passes")
    return state.select(*keys, "p", "n", F.col("hi").alias("value"))


def day_summaries(df: DataFrame, day_col: str, groups: list[str], values: list[str], bits: int = 6) -> DataFrame:
    """``(day, *groups, metric, cell, rows)``: counts on the common grid; cell null holds the zeros. A row without a time
    belongs to day null. Any two sets of summaries of one ``bits`` combine by ``unionByName``."""
    rows = measured(df.withColumn("day", F.to_date(day_col)), ["day", *groups], values)
    cell = F.when(F.col("value") > 0, F.floor(F.log2("value") * (1 << bits))).alias("cell")
    return rows.groupBy("day", *groups, "metric", cell).agg(F.count(F.lit(1)).alias("rows"))


def combined_percentiles(
    summaries: DataFrame, groups: list[str], percentiles: tuple[float, ...] = PERCENTILES, bits: int = 6
) -> DataFrame:
    """``(*groups, metric, p, n, at_least, below)`` of all days in ``summaries``: bounds of the percentile, whose ratio is
    ``2 ** (1 / 2 ** bits)`` (both are 0 if the percentile is 0)."""
    keys = [*groups, "metric"]
    cells = summaries.groupBy(*keys, "cell").agg(F.sum("rows").alias("rows"))
    up = Window.partitionBy(*keys).orderBy(F.col("cell").asc_nulls_first())
    cells = cells.withColumn("upto", F.sum("rows").over(up)).withColumn("n", F.sum("rows").over(Window.partitionBy(*keys)))
    ps = F.explode(F.array(*(F.lit(float(p)) for p in percentiles))).alias("p")
    cells = cells.select("*", ps).withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n"))))
    cells = cells.where("rank <= upto and rank > upto - rows")
    edge = [F.coalesce(F.pow(F.lit(2.0), (F.col("cell") + i) / (1 << bits)), F.lit(0.0)) for i in (0, 1)]
    return cells.select(*keys, "p", "n", edge[0].alias("at_least"), edge[1].alias("below"))
