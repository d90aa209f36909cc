"""Connected components by alternating large-star and small-star rewrites (operators C4, C5).

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): edges are rewritten until every node
points at the least node of its component. Each round is two joins on node keys and one write to the shared
folder; O(log^2 n) rounds at worst, few in practice.

A node may touch a third of all edges. Such hubs are fewer than ``hub_share`` by pigeonhole, so their minima go to
the executors by a broadcast of that proven size while all other edges meet their minima in an ordinary shuffled
join (``skew.hub_join``): no task receives a hub's whole neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import Scratch
from .skew import hub_join


def connected_components(
    links: DataFrame, a: str = "a", b: str = "b", hub_share: int = 1000, max_rounds: int = 60
) -> DataFrame:
    """``(node, component)`` for every node of ``links``; ``component`` is its component's least node.

    Rows with a null end are ignored; a link of a node with itself makes the node known; repeated and reversed
    links count once; other columns are ignored. An empty input gives an empty result.
    Raises RuntimeError if ``max_rounds`` rounds do not converge, rather than return a wrong result.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "components")
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    pairs = scratch.save(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "pairs")
    edges = pairs.filter("u > v")
    for k in range(max_rounds):
        # large star: every node hands its greater neighbours to the least node it knows
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        known = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        seen = Observation(f"known{k}")  # counted while the table is written
        known = scratch.save(known.observe(seen, F.sum("n").alias("total"), F.count_if(F.expr("m <> u and n > 1")).alias("chained")), f"known{k}")
        total = seen.get["total"]
        # done when every node is the least it knows or knows one other only: all are stars about their least
        if not total or not seen.get["chained"]:
            scratch.drop(f"known{k}")
            break
        large = (
            hub_join(both, known, "u", total, hub_share)
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = scratch.save(large, f"large{k}")
        # small star: every node hands its lesser neighbours to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        many = low.filter("n > 1")
        small = (
            hub_join(large, many, "u", total, hub_share)
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .filter("u > v")
            .unionByName(large.join(low.filter("n = 1").select("u"), "u", "left_semi"))
            .distinct()
        )
        edges = scratch.save(small, f"edges{k}")
        scratch.drop(f"known{k}")
        scratch.drop(f"large{k}")
        if k:
            scratch.drop(f"edges{k - 1}")
    else:
        raise RuntimeError(f"no convergence in {max_rounds} rounds")
    roots = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return roots.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
