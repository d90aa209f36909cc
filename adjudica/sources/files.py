"""File scans and sinks (2.A). Reads are distributed except where a source is one small archive or configuration."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import schema


def read_jsonl(spark: SparkSession, path: str, kind: str, key: list[str] | None = None) -> DataFrame:
    """JSON lines of a known kind (A1-A3); a malformed line fails the read, blank lines are skipped. With ``key``, a
    repeated key raises ValueError."""
    rows = spark.read.schema(schema(kind)).option("mode", "FAILFAST").json(path)
    return unique(rows, key) if key else rows


def unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows``, or ValueError with an example if a key occurs twice (A1, A3)."""
    twice = rows.groupBy(*key).count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"repeated key {twice[0].asDict()}")
    return rows


def unknown_fields(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(field, n)`` of top-level JSON fields that the kind does not have: a strict reader refuses these."""
    known = [f.name for f in schema(kind).fields]
    keys = spark.read.text(path).where("trim(value) <> ''").select(F.explode(F.json_object_keys("value")).alias("field"))
    return keys.where(~F.col("field").isin(known)).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions as JSON lines, a JSON list, or an object with ``rows`` or ``decisions`` (A4)."""
    one = schema("prediction").add("selected", "string").add("disposition", "string")
    if path.endswith(".jsonl"):
        rows = spark.read.schema(one).json(path)
    else:
        whole = spark.read.text(path, wholetext=True)
        item = F.from_json("value", f"array<{one.simpleString()}>", {"mode": "PERMISSIVE"})
        inner = F.from_json("value", f"struct<rows:array<{one.simpleString()}>,decisions:array<{one.simpleString()}>>")
        is_list = F.ltrim("value").startswith("[")
        rows = whole.select(F.inline(F.when(is_list, item).otherwise(F.coalesce(inner["rows"], inner["decisions"]))))
    return rows.withColumn("disposition", F.coalesce("disposition", "answer.disposition")).withColumn("prediction", F.coalesce("selected", "prediction"))


def read_table(spark: SparkSession, path: str, columns: list[str], sep: str = ",") -> DataFrame:
    """CSV or TSV with header (A5); columns come as strings, a byte order mark is dropped, quotes are doubled."""
    rows = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).csv(path)
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    return rows.select(*columns)


def read_zipped_table(spark: SparkSession, path: str, member: str, columns: list[str], sep: str = "\t") -> DataFrame:
    """One delimited member of a zip archive (A6, A7). An archive is one unit of work, so it is unpacked in one task; a shuffle
    spreads its rows from there."""
    ddl = ", ".join(f"`{c}` string" for c in columns)

    def rows(batches):
        import pandas as pd

        for b in batches:
            for content in b.content:
                with zipfile.ZipFile(io.BytesIO(content)) as z, io.TextIOWrapper(z.open(member), "utf-8-sig", newline="") as f:
                    part = []
                    for r in csv.DictReader(f, delimiter=sep, quoting=csv.QUOTE_MINIMAL if sep == "," else csv.QUOTE_NONE):
                        part.append([r.get(c) for c in columns])
                        if len(part) == 10_000:
                            yield pd.DataFrame(part, columns=columns)
                            part = []
                    yield pd.DataFrame(part, columns=columns)

    unpacked = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ddl)
    return unpacked.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_exclusions(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``(kept, counts(reason, n))`` (A5, A7, E35): a row is left out for the first rule that holds; a rule that is null does not."""
    reason = F.coalesce(*(F.when(rule, name) for name, rule in rules.items()))
    marked = rows.withColumn("_reason", reason)
    counts = marked.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return marked.where("_reason is null").drop("_reason"), counts


def with_context(rows: DataFrame, contexts: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the ``column`` that ``contexts(key, column)`` has for their key, and the counts of those left out for want of
    one (A7, D11). A key that contexts holds twice raises ValueError."""
    joined = rows.join(unique(contexts.select(key, column), [key]), key, "left")
    return with_exclusions(joined, {"missing_context": F.col(column).isNull()})


def import_heldout(rows: DataFrame, text: str, label: str, known: Column, keep: list[str], other: list[str], least: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Held-out rows whose labels are mapped (A17, B27): those of ``keep`` stay, those of ``other`` become ``other``, the rest are
    excluded, as are rows that ``known`` finds in the training texts and rows without a text. Fewer than ``least`` left raise
    ValueError."""
    mapped = rows.withColumn(label, F.when(F.col(label).isin(keep), F.col(label)).when(F.col(label).isin(other), "other"))
    kept, counts = with_exclusions(mapped, {"no_text": F.coalesce(F.col(text), F.lit("")) == "", "label": F.col(label).isNull(), "overlap": known})
    if (n := kept.count()) < least:
        raise ValueError(f"{n} held-out rows, {least} needed")
    return kept, counts


def read_rubric_docx(path: str, levels: int = 6) -> list[str]:
    """Descriptions of a scoring rubric in a Word document (A8): a paragraph that starts with ``SCORE OF n`` or ``n:``
    opens level n, further paragraphs belong to it. One small file, read on the driver."""
    with zipfile.ZipFile(path) as z:
        tree = ET.fromstring(z.read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    found: dict[int, list[str]] = {}
    at = None
    for p in tree.iter(f"{w}p"):
        text = "".join(t.text or "" for t in p.iter(f"{w}t")).strip()
        if m := re.match(r"(?i)^(?:score of\s+)?(\d)\s*[:.]\s*(.*)$", text):
            at, text = int(m[1]), m[2]
            found[at] = []
        if at and text:
            found[at].append(text)
    if sorted(found) != list(range(1, levels + 1)):
        raise ValueError(f"expected levels 1 to {levels}, found {sorted(found)}")
    return [" ".join(found[i]) for i in sorted(found)]


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(name, size, sha256)`` of files (A10, D13): hashed where they are read."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_problems(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``(name, problem)`` for manifest rows ``(name, sha256)`` whose file is missing or differs."""
    rows = manifest.join(files.select("name", F.col("sha256").alias("found")), "name", "left")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "mismatch")
    return rows.select("name", problem.alias("problem")).where("problem is not null")


def read_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Calibration profiles from ``*.json`` (A12), read in parallel. A file that is no JSON, or without an id, workload or
    primitive or with a temperature that is not positive and finite, is skipped; of one id the last file by name wins."""
    kind = schema("profile")
    rows = spark.read.schema(kind.add("_bad", "string")).option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").option("pathGlobFilter", "*.json").json(folder)
    rows = rows.withColumn("_name", F.col("_metadata.file_path")).where("_bad is null and profile_id is not null and workload_id is not null and primitive is not null")
    rows = rows.withColumn("temperature", F.coalesce("temperature", F.lit(1.0))).where("temperature > 0 and temperature < double('infinity')").drop("_bad")
    fields = [c for c in rows.columns if c != "_name"]
    return rows.groupBy("profile_id").agg(F.max_by(F.struct(*(c for c in fields if c != "profile_id")), "_name").alias("x")).select("profile_id", "x.*")


def read_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Regression requests (A13): every JSON file but the manifest, with its name. A request of fewer than two questions raises
    ValueError, as it would never reach the path that is compared."""
    rows = spark.read.schema(schema("request")).option("multiLine", True).json(folder)
    rows = rows.withColumn("name", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).where("name <> 'manifest.json'")
    few = rows.where("coalesce(size(questions), 0) < 2").select("name").take(1)
    if few:
        raise ValueError(f"{few[0].name}: a regression request has two questions or more")
    return rows


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Artifact tree (A14): ``(path, value)`` of every JSON file below the folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), "value")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """Probe tasks from a JSON list."""
    return spark.read.schema(schema("probe")).option("multiLine", True).json(path)


def read_exemplars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema("exemplar")).json(path)


def append_predictions(rows: DataFrame, path: str, done: DataFrame | None = None) -> None:
    """Append what is not there yet (A18, A22); ``done`` is what an earlier run wrote."""
    keys = ["example_id", "question_id"]
    (rows if done is None else rows.join(done.select(*keys), keys, "left_anti")).write.mode("append").json(path)


def read_cache(spark: SparkSession, path: str, kind: str = "prediction") -> DataFrame:
    """What an earlier run appended (A22): lines cut off or otherwise malformed are skipped, to be done again."""
    return spark.read.schema(schema(kind)).option("mode", "DROPMALFORMED").json(path).where("example_id is not null and question_id is not null")


def write_report(report: dict, path: str, skip: tuple[str, ...] = ("created_at",)) -> str:
    """Sorted JSON with its own hash, which leaves out times (A19). Returns the hash."""
    body = json.dumps({k: v for k, v in report.items() if k not in skip}, sort_keys=True, separators=(",", ":"))
    digest = hashlib.sha256(body.encode()).hexdigest()
    Path(path).write_text(json.dumps(report | {"sha256": digest}, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return digest


def record_shadow(events: DataFrame, path: str) -> None:
    """Append shadow events as JSON lines."""
    events.write.mode("append").json(path)
