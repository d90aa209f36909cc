"""Evidence from JSON artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructType

from ..functions.text import number_text


@udtf(returnType=StructType().add("leaf", StringType()).add("kind", StringType()).add("value", StringType()))
class JsonLeaves:
    """Leaves of a JSON text in key order: ``a.b[0]``, the JSON kind, the value as text. Invalid JSON has no leaves."""

    def eval(self, text: str):
        try:
            todo = [("", json.loads(text))]
        except (TypeError, ValueError, RecursionError):
            return
        while todo:
            path, x = todo.pop()
            if isinstance(x, dict):
                todo += [(f"{path}.{k}" if path else k, x[k]) for k in sorted(x, reverse=True)]
            elif isinstance(x, list):
                todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(x)))]
            else:
                kind = "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "null" if x is None else "string"
                yield path, kind, None if x is None else json.dumps(x) if kind != "string" else x


def leaves(spark, documents: DataFrame) -> DataFrame:
    """``(path, leaf, kind, value)`` for ``documents(path, value)``."""
    spark.udtf.register("json_leaves", JsonLeaves)
    documents.createOrReplaceTempView("_documents")
    return spark.sql("select d.path, l.leaf, l.kind, l.value from _documents d, lateral json_leaves(d.value) l")


def is_gate(leaf) -> F.Column:
    last = F.lower(F.regexp_extract(leaf, r"([^.\[]+)(\[\d+\])?$", 1))
    return last.contains("gate") & last.contains("passed")


def gates(rows: DataFrame) -> DataFrame:
    """Gates per artifact (E36): total and passed."""
    g = rows.where(is_gate("leaf") & (F.col("kind") == "boolean"))
    return g.groupBy("path").agg(F.count(F.lit(1)).alias("gates"), F.count_if(F.col("value") == "true").alias("passed"))


def markdown(rows: DataFrame, title: str = "Evidence") -> str:
    """The evidence summary as text (A20): the same rows give the same bytes. One line per artifact and metric."""
    g = gates(rows).orderBy("path").collect()
    out = [f"# {title}", "", f"Gates passed: {sum(r.passed for r in g)} of {sum(r.gates for r in g)}", ""]
    out += [f"- {r.path}: {r.passed} of {r.gates}" for r in g]
    metrics = rows.where("kind = 'number'").select("path", "leaf", number_text(F.col("value").cast("double")).alias("v"))
    out += [""] + [f"| {r.path} | {r.leaf} | {r.v} |" for r in metrics.orderBy("path", "leaf").toLocalIterator()]
    return "\n".join(out) + "\n"
