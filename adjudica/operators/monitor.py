"""Shadow traffic, review and slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked

KEY = ["example_id", "question_id"]


def shadow_decisions(log: DataFrame) -> DataFrame:
    """One row per decision of a shadow log; a request delivered twice counts once. ``logged_at`` is parsed with its
    offset."""
    rows = log.dropDuplicates(["request_id"]).withColumn("at", F.to_timestamp("logged_at"))
    return rows.select("request_id", "artifact_id", "profile_id", "at", F.explode("decisions").alias("question_id", "decision"))


def shadow_truth(decisions: DataFrame, labels: DataFrame) -> DataFrame:
    """Left join with labels given later, compared without case (D8); one label per decision, nulls are none."""
    one = labels.where("label is not null").groupBy("request_id", "question_id").agg(F.max("label").alias("label"))
    rows = decisions.join(one, ["request_id", "question_id"], "left")
    return rows.withColumn("agrees", F.lower("decision.value") == F.lower("label"))


def shadow_summary(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Requests, decisions, coverage, review rate and agreement (E30), 4 places; agreement is null without labels."""
    ratio = lambda c: F.round(F.count_if(c) / F.greatest(F.lit(1), F.count(F.lit(1))), 4)
    return rows.groupBy(*groups).agg(
        F.count_distinct("request_id").alias("requests"), F.count(F.lit(1)).alias("decisions"),
        ratio(F.col("decision.disposition") == "accept").alias("coverage"), ratio(F.col("decision.disposition") == "review").alias("review_rate"),
        F.count_if(F.col("decision.calibration_status") == "validated").alias("validated"), F.count("agrees").alias("labelled"),
        F.round(F.avg(F.col("agrees").cast("int")), 4).alias("agreement"),
    )


def hash_sample(rows: DataFrame, size: str, groups: list[str], key: list[str], seed: str) -> DataFrame:
    """The ``size`` (SQL, over the columns and the group's ``size``) rows of each group whose seeded hash is least (G3): the same on any
    partitioning, in place of a seeded shuffle."""
    rows = rows.withColumn("_h", F.sha2(F.concat_ws("\x00", F.lit(seed), *key), 256))
    names = rows.columns
    rows = ranked(rows, groups, ["_h", *key]).where(f"rank <= {size}")
    return rows.select(*(c for c in names if c != "_h"))


def control_arm(d: DataFrame, seed: str = "control") -> DataFrame:
    """Decisions to review (E31): all that disagree with their reference, and a control sample of
    ``min(agree, max(10, disagree / 2))`` of those that agree."""
    d = d.where("reference is not null").withColumn("agree", F.col("reference") == F.col("prediction"))
    n = d.agg(F.count_if("agree").alias("a"), F.count_if(~F.col("agree")).alias("b")).first()
    size = min(n.a, max(10, n.b // 2))
    h = F.sha2(F.concat_ws("\x00", F.lit(seed), "example_id", "question_id"), 256)
    agree = d.where("agree").select(*KEY, F.lit(0).alias("all"), h.alias("_h"))
    control = ranked(agree, ["all"], ["_h", *KEY]).where(F.col("rank") <= size)  # by range partitions where one task is too few
    return d.where("not agree").select(*KEY, F.lit("disagree").alias("arm")).unionByName(control.select(*KEY, F.lit("control").alias("arm")))


def review_audit(arms: DataFrame, verdicts: DataFrame, most: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """``(quarantined, summary)`` of a review (E31). ``verdicts(*KEY, disputed)`` are the reviewer's on rows of ``control_arm``; one
    not given is no dispute, and one row's several verdicts dispute if any does. If the reviewer disputes more than ``most`` of
    the control arm it is unreliable and every quarantine is discarded. Summary: ``control, control_disputes, dispute_rate,
    control_passed, disagreements, quarantined``; a rate without a control arm is 0."""
    said = verdicts.groupBy(*KEY).agg(F.max(F.coalesce("disputed", F.lit(False))).alias("disputed"))
    rows = arms.join(said, KEY, "left").withColumn("disputed", F.coalesce("disputed", F.lit(False)))
    control = F.col("arm") == "control"
    s = rows.agg(
        F.count_if(control).alias("control"), F.count_if(control & F.col("disputed")).alias("control_disputes"),
        F.count_if(~control).alias("disagreements"), F.count_if(~control & F.col("disputed")).alias("asked"),
    )
    rate = F.coalesce(F.try_divide("control_disputes", "control"), F.lit(0.0))
    s = s.withColumn("dispute_rate", rate).withColumn("control_passed", rate <= most)
    s = s.withColumn("quarantined", F.when(F.col("control_passed"), F.col("asked")).otherwise(0)).drop("asked")
    bad = rows.where(~control & F.col("disputed")).select(*KEY).join(F.broadcast(s.where("control_passed").select("control_passed")))
    return bad.select(*KEY), s


def failure_slices(d: DataFrame, first: int = 10) -> DataFrame:
    """Errors per workload with the first few ids (E32): a top-k report."""
    bad = d.where("reference is not null and reference <> prediction")
    order = Window.partitionBy("workload_id").orderBy("example_id", "question_id")
    head = bad.select("workload_id", *KEY).withColumn("r", F.row_number().over(order)).where(F.col("r") <= first)  # k rows a task
    head = head.groupBy("workload_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", *KEY))), ",").alias("first_ids"))
    return bad.groupBy("workload_id").agg(F.count(F.lit(1)).alias("errors")).join(head, "workload_id")


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is still to do: left anti on the full key."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def top_k_similar(queries: DataFrame, pool: DataFrame, task: str, k: int = 3) -> DataFrame:
    """The ``k`` pool rows of the query's task with the greatest token-set Jaccard (G4), ties by pool id; if fewer share a token,
    rows that share none fill up, and a pool of ``k`` rows or fewer comes out whole in the order of its ids. Inputs
    ``(query_id, task, text)`` and ``(pool_id, task, text)``. Overlaps are counted through shared tokens; only the first ``2 k``
    rows of a task can be needed to fill up."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))
    q = queries.select("query_id", task, tokens("text").alias("w")).withColumn("qn", F.size("w"))
    p = pool.select("pool_id", task, tokens("text").alias("w")).withColumn("pn", F.size("w"))
    q, p = q.select("query_id", task, "qn", F.explode("w").alias("t")), p.select("pool_id", task, "pn", F.explode("w").alias("t"))
    both = q.join(p, [task, "t"]).groupBy("query_id", "pool_id", "qn", "pn").agg(F.count(F.lit(1)).alias("o"))
    both = both.withColumn("similarity", F.col("o") / (F.col("qn") + F.col("pn") - F.col("o")))
    first = F.row_number().over(Window.partitionBy(task).orderBy("pool_id"))
    heads = pool.select("pool_id", task).withColumn("_i", first).where(F.col("_i") <= 2 * k)
    fill = queries.select("query_id", task).join(heads, task).select("query_id", "pool_id").join(both.select("query_id", "pool_id"), ["query_id", "pool_id"], "left_anti")
    both = both.select("query_id", "pool_id", "similarity").unionByName(fill.withColumn("similarity", F.lit(0.0)))
    small = pool.groupBy(task).agg((F.count(F.lit(1)) <= k).alias("_small"))
    both = both.join(queries.select("query_id", task).join(small, task).select("query_id", "_small"), "query_id")
    order = F.when(F.col("_small"), F.lit(0.0)).otherwise(-F.col("similarity"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "pool_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "pool_id", "rank", "similarity")
