"""Problem 4: train, validation and test splits in which related records stay together.

Records and entities (source, author, ...) form a bipartite graph; least labels are propagated along it until nothing
changes, so records linked through any chain of shared entities have one group. Only records with several entities
pass labels on, so only they are iterated over.

Groups are then assigned so that the label distribution of every split follows the whole's: the largest groups first
(fewer than ``big_share`` by pigeonhole, on the driver, with at most ``label_share + 64`` strata each), which leaves
every stratum with what each split still lacks; then all others in hash shards of bounded size, each by descending
size to the split where it lessens the deviation most, against the shard's share of what is lacking.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hub_join
from ..storage import Scratch

PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def propagate(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(entity, label)``: the least entity reachable over ``edges(record, entity)``. Every round also takes the label's
    own label (pointer jumping), so chains need a logarithmic number of rounds. An entity, or a label, with a large share of all
    rows is joined by broadcast (``hub_join``)."""
    scratch = Scratch(edges.sparkSession, "propagate")
    edges = scratch.save(edges.distinct(), "edges")
    degree = scratch.save(edges.groupBy("entity").agg(F.count(F.lit(1)).alias("n")), "degree")
    total = degree.agg(F.sum("n")).first()[0] or 0
    labels = scratch.save(degree.select("entity", F.col("entity").alias("label")), "labels0")
    for k in range(1, max_rounds + 1):
        record = hub_join(edges, labels.join(degree, "entity"), "entity", total).groupBy("record").agg(F.min("label").alias("label"))
        seen = edges.join(record, "record").groupBy("entity").agg(F.min("label").alias("label"))
        seen = scratch.save(seen, f"seen{k}")
        jump = seen.select(F.col("entity").alias("label"), F.col("label").alias("further"))
        jump = jump.join(seen.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")  # every label is an entity
        new = hub_join(seen, jump, "label", total).select("entity", F.least("label", "further").alias("label"))
        new = scratch.save(new, f"labels{k}")
        scratch.drop(f"seen{k}")
        changed = new.join(labels.withColumnRenamed("label", "old"), "entity").where("label <> old").take(1)
        scratch.drop(f"labels{k - 1}")
        labels = new
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


class Balance:
    """Counts by split and stratum against targets; ``place`` adds a group where the deviation grows least."""

    def __init__(self, target: np.ndarray):
        self.target, self.have = target, np.zeros_like(target)
        self.scale = 1 / (target.sum(0) + 1)
        self.whole = target.sum(1)
        self.filled = np.zeros(len(target))

    def place(self, strata: np.ndarray, n: np.ndarray) -> int:
        gap = self.have[:, strata] - self.target[:, strata]
        size = n.sum()
        cost = ((2 * gap + n) * n * self.scale[strata]).sum(1)
        cost += (2 * (self.filled - self.whole) + size) * size / (self.whole.sum() + 1)
        s = int(cost.argmin())
        self.have[s, strata] += n
        self.filled[s] += size
        return s


def _shard(lacking: np.ndarray, names: list[str]) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        group, stratum, n = table["u"].to_pylist(), table["stratum"].to_numpy(), table["n"].to_numpy()
        here = np.bincount(stratum, weights=n, minlength=lacking.shape[1])
        balance = Balance(lacking * here)
        rows: dict[str, list[int]] = {}
        for i, g in enumerate(group):
            rows.setdefault(g, []).append(i)
        size = {g: n[x].sum() for g, x in rows.items()}
        order = sorted(rows, key=lambda g: (-size[g], g))
        split = [names[balance.place(stratum[rows[g]], n[rows[g]].astype(float))] for g in order]
        return pa.table({"u": order, "split": split, "n": [int(size[g]) for g in order]})

    return run


def group_splits(
    records: DataFrame, id_col: str = "example_id", entity_cols: tuple[str, ...] = ("source_group_id",), label_col: str = "workload_id",
    proportions: dict[str, float] | None = None, big_share: int = 500, label_share: int = 1000, shard_rows: int = 200_000,
) -> DataFrame:
    """``(id, group_id, split)``, one row per distinct non-null id. Rows of one id are one record; its label is the least.

    Null entities link nothing; a record without any is its own group. A null label is a stratum of its own; labels
    rarer than one record in ``label_share`` share 64 strata by hash. An empty table gives an empty result. Proportions
    are met up to what whole groups allow.
    """
    want = proportions or PROPORTIONS
    names, share = list(want), np.array(list(want.values()))
    share = share / share.sum()
    spark = records.sparkSession
    scratch = Scratch(spark, "group-splits")
    entities = F.array(*(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}\x1f"), F.col(c).cast("string"))) for c in entity_cols))
    rows = records.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("record"), F.col(label_col).cast("string").alias("label"), F.filter(entities, lambda x: x.isNotNull()).alias("e")
    )
    rows = rows.groupBy("record").agg(F.min("label").alias("label"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("e")))).alias("e"))
    rows = scratch.save(rows, "records")
    linked = rows.where(F.size("e") > 1).select("record", F.explode("e").alias("entity"))
    rows = rows.select("record", "label", F.when(F.size("e") > 0, F.element_at("e", 1)).alias("entity"))
    if linked.take(1):
        known = propagate(linked)
        n = rows.where("entity is not null").groupBy(F.col("entity").alias("u")).agg(F.count(F.lit(1)).alias("n"))
        found = known.withColumnRenamed("entity", "u").join(n, "u")
        with_label = hub_join(rows.withColumnRenamed("entity", "u"), found.withColumnRenamed("label", "root"), "u", rows.count())
        alone = rows.join(known.select("entity"), "entity", "left_anti")
        rows = with_label.select("record", "label", F.col("root").alias("u")).unionByName(alone.select("record", "label", F.col("entity").alias("u")))
    else:
        rows = rows.withColumnRenamed("entity", "u")
    rows = rows.withColumn("u", F.coalesce("u", F.concat(F.lit("\x1erecord\x1f"), F.col("record").cast("string"))))
    rows = scratch.save(rows, "grouped")
    total = rows.count()
    if not total:
        return rows.select(F.col("record").alias("id"), F.col("u").alias("group_id"), F.lit("").alias("split"))
    common = rows.groupBy("label").count().where(F.col("count") * label_share >= total).orderBy("label").collect()
    strata = spark.createDataFrame([(r.label, i) for i, r in enumerate(common)], "label string, stratum int")
    at = F.coalesce("stratum", F.lit(len(common)) + F.pmod(F.hash("l.label"), F.lit(64)))
    cells = rows.alias("l").join(F.broadcast(strata.alias("s")), F.col("l.label").eqNullSafe(F.col("s.label")), "left")
    cells = scratch.save(cells.groupBy("u", at.alias("stratum")).agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = cells.groupBy("u").agg(F.sum("n").alias("size"))
    big = sizes.where(F.col("size") * big_share > total)
    counts = np.zeros(len(common) + 64)
    for r in cells.groupBy("stratum").agg(F.sum("n").alias("n")).collect():
        counts[r.stratum] = r.n
    balance, largest = Balance(share[:, None] * counts), {}
    for r in cells.join(F.broadcast(big), "u").collect():  # at most big_share groups of at most len(counts) strata
        largest.setdefault((-r["size"], r.u), []).append((r.stratum, r.n))
    placed = []
    for (size, u), x in sorted(largest.items()):
        s = balance.place(np.array([i for i, _ in x]), np.array([float(n) for _, n in x]))
        placed.append((u, names[s], -size))
    lacking = np.maximum(0, balance.target - balance.have)
    none = lacking.sum(0) == 0
    lacking[:, none] = share[:, None]
    lacking = lacking / lacking.sum(0)
    shards = max(1, -(-total // shard_rows))
    small = cells.join(F.broadcast(big.select("u")), "u", "left_anti").withColumn("shard", F.pmod(F.xxhash64("u"), F.lit(shards)))
    small = small.groupBy("shard").applyInArrow(_shard(lacking, names), "u string, split string, n long")
    chosen = small.unionByName(spark.createDataFrame(placed, "u string, split string, n long"))
    chosen = scratch.save(chosen, "chosen")
    out = hub_join(rows.select("record", "u"), chosen, "u", total)
    return out.select(F.col("record").alias("id"), F.col("u").alias("group_id"), "split")
