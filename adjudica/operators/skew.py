"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hub_join(rows: DataFrame, facts: DataFrame, key: str, total: int, hub_share: int = 1000, least: int = 1_000_000) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row per key and in ``n`` how many ``rows`` have that key.

    Keys of more than ``total / hub_share`` rows number less than ``hub_share``: their facts are broadcast, a size
    that pigeonhole proves, and their rows stay where they are. All other rows meet in a shuffled join, in which no
    key is large. Up to ``least`` rows of one key are left to one task. ``n`` does not come out.
    """
    if total <= least:
        return rows.join(facts.drop("n"), key)
    limit = max(total / hub_share, least)
    hot = facts.filter(F.col("n") > limit).drop("n")
    if not hot.take(1):
        return rows.join(facts.drop("n"), key)
    hot = F.broadcast(hot)
    cold = rows.join(hot.select(key), key, "left_anti").join(facts.filter(F.col("n") <= limit).drop("n"), key)
    return rows.join(hot, key).unionByName(cold)
