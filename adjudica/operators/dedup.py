"""Exact and near duplicates, components of shared ids, and what may not cross a split (2.C)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distributions as ds
from ..functions import text as tx
from ..storage import Scratch
from .components import connected_components
from .skew import hub_join


def exact_duplicates(rows: DataFrame, id_col: str, key: Column) -> DataFrame:
    """``(key, first_id, copies)`` of keys with two rows or more (C1). Null keys are no duplicates."""
    keyed = rows.select(key.alias("key"), F.col(id_col).alias("id")).where("key is not null")
    return keyed.groupBy("key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")


def shingles(words: Column, k: int = 5) -> Column:
    """Sorted distinct 64-bit hashes of the ``k``-word windows; fewer than ``k`` words have none."""
    n = F.size(words)
    at = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
    # each word is hashed once, a window by the hashes of its words
    windows = ds.let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.transform(at, lambda i: F.xxhash64(F.slice(h, i, k))))
    return F.array_sort(F.array_distinct(windows))


def similar_pairs(rows: DataFrame, id_col: str, words: Column, least: float = 0.9, k: int = 5) -> DataFrame:
    """``(a, b, similarity)`` with exact Jaccard of ``least`` or more (C3): rows are met by the first digests (``met_pairs``) and
    the sets decide. Rows with equal word lists are taken
    together first, so exact copies cost nothing; ``a`` and ``b`` are the least ids of their texts."""
    one = rows.select(F.col(id_col).alias("id"), words.alias("w")).where("w is not null").groupBy(F.xxhash64("w").alias("h"), F.sha2(F.array_join("w", " "), 256).alias("s"))
    one = one.agg(F.min("id").alias("id"), F.first("w").alias("w")).select("id", shingles(F.col("w"), k).alias("g"))
    scratch = Scratch(rows.sparkSession, "similar")
    one = scratch.save(one.where("size(g) > 0"), "sets")
    return verified(met_pairs(scratch.save(heads(one, least), "heads"), least), one, least)


def common_digests(one: DataFrame, most: int = 10_000, tracked: int = 200_000) -> list[int]:
    """The digests of most rows ``(id, g)``, at most ``most`` of them, from a sketch of ``tracked`` counters."""
    found = one.select(F.explode("g").alias("t")).agg(F.expr(f"approx_top_k(t, {most}, {tracked})").alias("top")).first()
    return [x["item"] for x in found.top or [] if x["count"] > 2]


def parities(g: Column, longs: int = 4) -> Column:
    """A bit map of ``64 * longs`` bits of a set of digests, each bit the parity of those that fall on it: two sets differ in at
    least as many members as their maps in bits."""
    part = lambda k: F.filter(g, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(longs - 1)) == k)
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    return F.array(*(F.aggregate(part(k), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(bit(x))) for k in range(longs)))


def heads(one: DataFrame, least: float) -> DataFrame:
    """``(id, n, m, h)`` of rows ``(id, g)``: the number of digests, their bit map, and the first of them by which a similar row
    must be met, the most common ones last."""
    common = common_digests(one)
    last = (lambda x: x.isin(common)) if common else (lambda x: F.lit(False))
    ordered = F.concat(F.filter("g", lambda x: ~last(x)), F.filter("g", last))
    h = F.slice(ordered, F.lit(1), F.expr(f"cast(size(g) - ceil({least}D * size(g) - 1e-9D) + 1 as int)"))
    return one.select("id", F.size("g").alias("n"), parities(F.col("g")).alias("m"), h.alias("h"))


def met_pairs(rows: DataFrame, least: float) -> DataFrame:
    """``(a, b)`` of rows of ``heads`` whose sizes allow the similarity, that share a digest where the first shared one must stand,
    and whose bit maps do not show already that they differ too much. Of ``need = ceil(t / (1 + t) (n_a + n_b))`` shared digests
    the first is at place ``n - need`` or before in both rows, whatever the order."""
    need = f"ceil({least}D / (1 + {least}D) * (%s + %s) - 1e-9D)"
    head = rows.select("id", "n", F.posexplode("h").alias("p", "t")).selectExpr("id", "n", "n - p as rest", "t")
    x, y = head.alias("x"), head.alias("y")
    on = f"x.t = y.t and x.id < y.id and least(x.rest, y.rest) >= {need % ('x.n', 'y.n')} and least(x.n, y.n) >= {least}D * greatest(x.n, y.n) - 1e-9D"
    met = x.join(y, F.expr(on)).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    for s in "ab":  # a few bytes a row, so that far fewer of the much larger sets are fetched
        met = met.join(rows.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("m").alias(f"m_{s}")), s)
    apart = F.aggregate(F.zip_with("m_a", "m_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return met.where(apart <= F.col("n_a") + F.col("n_b") - 2 * F.expr(need % ("n_a", "n_b"))).select("a", "b")


def verified(met: DataFrame, one: DataFrame, least: float) -> DataFrame:
    met = met.join(one.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(one.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    out = met.withColumn("similarity", both / (F.size("ga") + F.size("gb") - both))
    return out.where(F.col("similarity") >= least).select("a", "b", "similarity")


def near_duplicates(rows: DataFrame, id_col: str, key: Column, least: float = 0.9, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """``(members, pairs)``. Members: ``(id_col, class_id, links)``, one per row: the least id with the same ``key`` (words
    joined by a space), and how many other rows are copies or near duplicates. Pairs: ``(a, b, similarity)`` of classes
    (C1, C3). Rows without words are in no class and have no links."""
    scratch = Scratch(rows.sparkSession, "near")
    keyed = rows.select(F.col(id_col).alias("id"), F.nullif(key, F.lit("")).alias("key"))
    keyed = scratch.save(keyed.withColumn("digest", F.sha2("key", 256)), "keyed")
    classes = keyed.where("key is not null").groupBy("digest").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n"), F.split(F.first("key"), " ").alias("w"))
    classes = scratch.save(classes, "classes")  # words are split once: an expression inside ``shingles`` would run at every window
    texts = classes.select(F.col("class_id").alias("id"), "w").where(f"size(w) >= {k}")
    rows = scratch.save(heads(texts.select("id", shingles(F.col("w"), k).alias("g")), least), "heads")
    met = scratch.save(met_pairs(rows, least), "met")
    ids = met.select(F.explode(F.array("a", "b")).alias("id")).distinct()  # digests are far larger than words: only of texts met
    sets = scratch.save(texts.join(ids, "id", "left_semi").select("id", shingles(F.col("w"), k).alias("g")), "sets")
    pairs = scratch.save(verified(met, sets, least), "pairs")
    both = pairs.select(F.col("a").alias("class_id"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("class_id"), F.col("a").alias("other")))
    near = both.join(classes.select(F.col("class_id").alias("other"), "n"), "other").groupBy("class_id").agg(F.sum("n").alias("near"))
    facts = classes.select("digest", "class_id", "n").join(near, "class_id", "left")
    facts = facts.select("digest", "class_id", "n", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    total = classes.agg(F.sum("n").alias("s")).first().s or 0
    members = hub_join(keyed.where("key is not null").select("id", "digest"), facts, "digest", total).select("id", "class_id", "links")
    none = keyed.where("key is null").select("id", F.lit(None).cast(keyed.schema["id"].dataType).alias("class_id"), F.lit(0).cast("long").alias("links"))
    return members.unionByName(none).withColumnRenamed("id", id_col), pairs


def text_clusters(examples: DataFrame) -> DataFrame:
    """``(example_id, cluster_id)``: examples joined by any chain of exact and near duplicates of their decision texts, named
    by the least id (C4). An example without words is a cluster of its own; one delivered with several states joins them."""
    scratch = Scratch(examples.sparkSession, "clusters")
    texts = examples.select("example_id", "state").distinct()
    texts = scratch.save(texts.select("example_id", tx.duplicate_key(tx.decision_text("state")).alias("key")), "texts")
    members, pairs = near_duplicates(texts, "example_id", F.col("key"))
    links = members.where("links > 0 and class_id is not null").select(F.col("class_id").alias("a"), F.col("example_id").alias("b"))
    found = connected_components(links.unionByName(pairs.select("a", "b"))).withColumnRenamed("node", "example_id")
    out = examples.select("example_id").distinct().join(found, "example_id", "left")
    return out.select("example_id", F.concat(F.lit("dup-"), tx.stable_id(F.coalesce("component", "example_id"))).alias("cluster_id"))


def source_components(examples: DataFrame) -> DataFrame:
    """``(example_id, component)`` over the graph of source groups and clusters (C5): an example joins its two ids, and
    ids joined by any chain are one component, named by its least id. Null ids join nothing; an example without either
    id is a component of its own."""
    source = F.concat(F.lit("source:"), F.col("source_group_id"))
    cluster = F.concat(F.lit("cluster:"), F.nullif(F.nullif(F.col("near_duplicate_cluster_id"), F.lit("")), F.lit("unclustered")))
    rows = examples.select("example_id", source.alias("s"), cluster.alias("c")).distinct()
    rows = Scratch(examples.sparkSession, "nodes").save(rows.withColumn("node", F.coalesce("s", "c")), "rows")
    found = connected_components(rows.select(F.col("node").alias("a"), F.coalesce("c", "s").alias("b")))
    sizes = rows.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    named = hub_join(rows.where("node is not null"), found.join(sizes, "node"), "node", total).select("example_id", "component")
    alone = rows.where("node is null").select("example_id", F.concat(F.lit("example:"), "example_id").alias("component"))
    return named.unionByName(alone).groupBy("example_id").agg(F.min("component").alias("component"))


def boundary_conflicts(examples: DataFrame, components: DataFrame) -> DataFrame:
    """``(example_id, component, quarantined)``: a component with more than one (upstream split, evaluation split) is
    quarantined whole (C6). Nulls count as a value."""
    pair = F.struct(F.col("public_source.upstream_split").alias("u"), F.col("evaluation_split").alias("e"))
    rows = examples.select("example_id", pair.alias("pair")).distinct().join(components, "example_id")
    bad = rows.groupBy("component").agg((F.count_distinct("pair") > 1).alias("quarantined"))
    return components.join(bad, "component").select("example_id", "component", "quarantined")


def assign_splits(examples: DataFrame, components: DataFrame, seed: str) -> DataFrame:
    """``(example_id, component, split, conflict)`` (C7): the explicit split of a component, else task_holdout if it holds
    out its template, else the hash bucket of its name, its least id (a list of all its ids could be a third of the table in
    one value). A component with several explicit or upstream splits, or with held-out and ordinary rows, is a conflict and
    gets no split, where strict use would refuse the table."""
    upstream = F.when(F.col("public_source").isNotNull(), F.coalesce("public_source.upstream_split", F.lit(""))).alias("upstream")
    rows = examples.select("example_id", "evaluation_split", "task_template_holdout", upstream).distinct().join(components, "example_id")
    g = rows.groupBy("component").agg(
        F.count_distinct(F.coalesce("evaluation_split", F.lit(""))).alias("k"), F.max("evaluation_split").alias("explicit"), F.count_distinct("upstream").alias("ups"),
        F.min("task_template_holdout").alias("h0"), F.max("task_template_holdout").alias("h1"),
    )
    conflict = (F.col("k") > 1) | (F.col("ups") > 1) | (F.col("h0") != F.col("h1")) | (F.col("explicit").isNotNull() & F.col("h1") & (F.col("explicit") != "task_holdout"))
    split = F.when(conflict, None).when(F.col("explicit").isNotNull(), F.col("explicit")).when(F.col("h1"), "task_holdout")
    split = F.when(conflict, None).otherwise(F.coalesce(split, tx.split_of(tx.bucket(seed, F.col("component")))))
    g = g.select("component", split.alias("split"), F.coalesce(conflict, F.lit(False)).alias("conflict"))
    return components.join(g, "component").select("example_id", "component", "split", "conflict")


def leaking_pairs(examples: DataFrame) -> DataFrame:
    """(source, cluster) pairs that occur in more than one split."""
    rows = examples.where("source_group_id is not null and near_duplicate_cluster_id is not null and evaluation_split is not null")
    return rows.groupBy("source_group_id", "near_duplicate_cluster_id").agg(F.count_distinct("evaluation_split").alias("splits")).where("splits > 1")
