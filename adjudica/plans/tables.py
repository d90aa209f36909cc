"""The driver's tables as the engine's inputs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def decisions(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per (example_id, question_id); rows delivered again differ in ``received_at`` only."""
    rows = table(spark, sf_dir, "direct_development")
    keep = columns or ("workload_id", "primitive", "reference", "prediction", "answer", "request_total_ms", "inference_ms", "scored_at")
    return rows.select("example_id", "question_id", *keep).dropDuplicates(["example_id", "question_id"])


def examples(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row per example and cluster id: an example may be delivered again under another cluster."""
    rows = table(spark, sf_dir, "suite")
    return rows.select("example_id", *columns) if columns else rows


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "calibration_profile")


def second_arm(d: DataFrame) -> DataFrame:
    """A second scoring of the same decisions: logits rounded to eighths, as a coarser precision would give."""
    return d.withColumn("z", F.transform("z", lambda x: F.round(x * 8) / 8))


#: CTEs: decisions d; with aligned arrays o; with a target s.
D = """d as (select * from direct_development qualify row_number() over (partition by example_id, question_id order by received_at) = 1)"""
O = (
    D
    + """,
o as (select *, list_transform(ids, lambda i: answer.probabilities[i]) as p from (
      select *, list_sort(map_keys(answer.probabilities)) as ids from d)),
z as (select *, list_transform(p, lambda x: ln(greatest(x, 1e-15::double))) as z from o)"""
)
S = (
    O
    + """,
s as (select *, list_max(p) as confidence, cast(ids[list_position(p, list_max(p))] = reference as int) as hit from (
      select *, list_position(ids, reference) as target from z where reference is not null) where target > 0)"""
)
