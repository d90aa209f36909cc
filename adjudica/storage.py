"""Tables written to the folder all executors share: how iterative operators cut their lineage.

The folder is ``spark.checkpoint.dir`` of the session, or the one given to ``SparkContext.setCheckpointDir``. Only where both
are unset and the master is local (tests, a laptop), so that one machine is all there is, a temporary folder takes its
place; on a cluster an unset folder is an error. A lost executor loses nothing that is kept here.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Raises RuntimeError where a cluster names none."""
    context = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if there:
        return there.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="adjudica-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Scratch:
    """Tables of one operator call. ``drop`` removes one that no later plan reads, ``keep_only`` all but those that the
    result reads; these go with ``clear``, once the result has been read, or with the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.saved: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as a Parquet table and return the table."""
        path = f"{self.root}/{name}"
        self.saved.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        fs, p = _fs(self.spark, f"{self.root}/{name}")
        fs.delete(p, True)
        self.saved.discard(name)

    def keep_only(self, *names: str) -> None:
        for name in sorted(self.saved.difference(names)):
            self.drop(name)

    def clear(self) -> None:
        fs, p = _fs(self.spark, self.root)
        fs.delete(p, True)
