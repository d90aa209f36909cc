"""Problem 7: records grouped whose similarity reaches a threshold.

The product of the document x run incidence matrix with its transpose, sparse and in blocks of columns: Spark
partitions the columns (runs) and joins each block with itself; the overlap counts of document pairs are accumulated
over the blocks, and bounds derived from the sizes discard pairs. Only prefix columns are multiplied at first
(``shingle_classes`` says why no pair is lost), and bounds from sizes and places already discard entries of the product
where they arise, before anything is shuffled; the pairs left then get their overlap over all columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..operators.skew import hub_join
from ..storage import Scratch
from . import shingle_classes as sc


def hot_links(index: DataFrame, hot: DataFrame, classes: DataFrame, scratch: Scratch, k: int, least: float, share: int) -> tuple[DataFrame, DataFrame]:
    """``(links, candidates)`` of grams that more than ``share`` classes have. All rows of a gram are first compared with its
    leader, the class of the middle size; those similar to it are linked by it already and need no look at each other. So
    candidates are pairs of which one side is not similar to the leader: records that are all near copies of one another
    make as many links as records, not pairs. A gram's rows are spread over parts of ``share`` rows."""
    total = hot.agg(F.sum("n")).first()[0]
    rows = hub_join(sc.unpacked(index, ["class"]), hot.withColumn("hot_n", F.col("n")), "gram", total)
    rows = scratch.save(rows, "hot-rows")
    leaders = rows.groupBy("gram").agg(F.percentile_approx("n", 0.5, 1000).alias("middle"))
    leaders = hub_join(rows, leaders.join(hot, "gram"), "gram", total).groupBy("gram").agg(F.min_by("class", F.struct(F.abs(F.col("n") - F.col("middle")), F.col("class"))).alias("leader"))
    rows = scratch.save(hub_join(rows, leaders.join(hot, "gram"), "gram", total), "hot-led")
    to_leader = rows.where("class <> leader").selectExpr("class as a", "leader as b").distinct()
    links = scratch.save(sc.verify(to_leader, classes, k, least, ["name"]), "hot-links")
    known = links.selectExpr("a as class", "b as leader").unionByName(rows.selectExpr("leader as class", "leader")).distinct()
    free = rows.join(known, ["class", "leader"], "left_anti")
    met = sc.hot_pairs(free, rows, least, share)
    return links, met.selectExpr("least(a, b) as a", "greatest(a, b) as b")


def near_pairs(classes: DataFrame, scratch: Scratch, k: int, least: float, hot: int = 1000, slots: tuple[int, int] = sc.SLOTS) -> DataFrame:
    """Verified pairs of classes with the names of both, which link whatever is similar: every pair of that similarity, but
    for those that are both similar to the leader of a hot gram (``hot_links``)."""
    index, many = sc.prefix_index(classes, scratch, k, least, ["class"], hot=hot, slots=slots)
    cold = sc.unpacked(index, ["class"])
    if many is not None:
        cold = cold.join(many.select("gram"), "gram", "left_anti")
    a, b = cold.alias("a"), cold.alias("b")
    met = a.join(b, F.expr(f"a.gram = b.gram and (a.n < b.n or a.n = b.n and a.class < b.class) and {sc.enough(least)}")).selectExpr("a.class as a", "b.class as b")
    links = None
    if many is not None:
        links, more = hot_links(index, many, classes, scratch, k, least, hot)
        met = met.unionByName(more)
    pairs = scratch.save(met.distinct(), "candidates")
    near = sc.verify(pairs, classes, k, least, ["name"])
    return near if links is None else near.unionByName(links)


def near_groups(
    records: DataFrame, id_col: str = "example_id", text_col: str = "state", k: int = 3, least: float = 0.7, least_words: int = 8,
    hot: int = 1000, slots: tuple[int, int] = sc.SLOTS,
) -> DataFrame:
    """``(group_id, member)`` for every record in a group of two or more, the least id included.

    Records of the same run set are one class and count as similar; a record of fewer than ``least_words`` words, a
    null text or a null id is in no group. Rows of one id count once. Tables may have any further columns. ``hot`` and
    ``slots`` choose among ways with equal results: more than ``hot`` classes in one column of the product are compared with
    a leader first, and more runs than ``slots`` allows for are counted by a shuffle.
    """
    scratch = Scratch(records.sparkSession, "near-groups")
    members, classes = sc.shingle_classes(records, scratch, id_col, text_col, None, k, least_words)
    pairs = near_pairs(classes, scratch, k, least, hot, slots)
    linked = connected_components(pairs.select("name_a", "name_b"), "name_a", "name_b")
    facts = classes.select("u", "name", F.col("members").alias("n")).join(linked, F.col("name") == F.col("node"), "left")
    facts = facts.filter("n > 1 or node is not null").select("u", F.coalesce("component", "name").alias("group_id"), "n")
    facts = scratch.save(facts, "groups")
    scratch.keep_only("members", "groups")
    total = facts.agg(F.sum("n")).first()[0] or 0
    return hub_join(members.select("u", "id"), facts, "u", total).select("group_id", F.col("id").alias("member")).distinct()
