"""Shadow traffic as a stream (J1-J3): the batch operators on micro-batches, with watermarks. An extension: the batch
analyses define the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 8) -> DataFrame:
    """Parquet files of a shadow log as they arrive, with event time ``at``."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return rows.withColumn("at", F.to_timestamp("logged_at"))


def windowed_coverage(events: DataFrame, width: str = "1 day", late: str = "10 days") -> DataFrame:
    """Decisions, accepted and coverage per profile and time window. A request delivered twice within the watermark counts
    once; events later than ``late`` are dropped by the watermark."""
    rows = events.withWatermark("at", late).dropDuplicatesWithinWatermark(["request_id"])
    rows = rows.select("at", "profile_id", F.explode("decisions").alias("question_id", "decision"))
    return rows.groupBy(F.window("at", width), "profile_id").agg(
        F.count(F.lit(1)).alias("decisions"), F.count_if(F.col("decision.disposition") == "accept").alias("accepted")
    )


def incremental(stream: DataFrame, table: str, keys: list[str], checkpoint: str, analyse: Callable[[DataFrame], None] | None = None):
    """Append rows whose key is not in ``table`` yet (J2), then run ``analyse`` on the whole table (J3). Idempotent: a
    micro-batch that is run again adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        df = df.dropDuplicates(keys)
        try:
            df = df.join(spark.read.parquet(table).select(*keys), keys, "left_anti")
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        df.write.mode("append").parquet(table)
        if analyse:
            analyse(spark.read.parquet(table))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
