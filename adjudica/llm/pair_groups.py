"""Problem 2: pairwise matches and shared cluster ids consolidated into groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import hub_join
from ..storage import Scratch

#: Cluster ids that say "in no cluster".
PLACEHOLDERS = ("", "unclustered")


def cluster_links(records: DataFrame, id_col: str, cluster_col: str, placeholders: tuple[str, ...] = PLACEHOLDERS) -> DataFrame:
    """``(a, b)``: every id of a cluster linked with the cluster's least id. Links grow with rows, not with pairs."""
    rows = records.select(F.col(cluster_col).alias("u"), F.col(id_col).alias("id"))
    rows = rows.where(F.col("id").isNotNull() & F.col("u").isNotNull() & ~F.col("u").isin(*placeholders)).distinct()
    facts = rows.groupBy("u").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    facts = Scratch(records.sparkSession, "clusters").save(facts, "facts")
    total = facts.agg(F.sum("n")).first()[0] or 0
    return hub_join(rows, facts, "u", total).filter("id > m").select(F.col("id").alias("a"), F.col("m").alias("b"))


def consolidate(
    records: DataFrame, matches: DataFrame, id_col: str = "example_id", cluster_col: str = "near_duplicate_cluster_id",
    a: str = "example_id_a", b: str = "example_id_b",
) -> DataFrame:
    """``(group_id, member)`` for every id that is linked with another, the least included (``group_id = member``).

    A match with a null side links nothing, nor does one of an id with itself; similarity and matcher are not read.
    """
    links = matches.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    found = connected_components(links.unionByName(cluster_links(records, id_col, cluster_col)))
    return found.select(F.col("component").alias("group_id"), F.col("node").alias("member"))
