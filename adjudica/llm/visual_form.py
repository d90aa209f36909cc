"""Problem 6: one form for text that looks the same but is stored with different characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from . import arrow
from . import codepoints as cp


def _form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in arrow.slices(batches, "text"):
        text = b.column(b.num_columns - 1)
        form = cp.encode(*cp.visual_form(*cp.decode(text)), np.asarray(text.is_valid()))
        yield pa.RecordBatch.from_arrays([*b.columns, form], [*b.schema.names, "form"])


def visual_form(records: DataFrame, id_col: str = "example_id", text_col: str = "state") -> DataFrame:
    """``(id, text, form)`` per row. Null stays null, an empty text stays empty; very long texts are done in slices."""
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_form, f"id {kind}, text string, form string")


def _hash(c: str) -> list[Column]:
    """128 bits of a string."""
    return [F.xxhash64(F.col(c)).alias(f"{c}_x"), F.xxhash64(F.lit(7), F.col(c)).alias(f"{c}_y")]


def lookalike_pairs(records: DataFrame, id_col: str = "example_id", text_col: str = "state") -> DataFrame:
    """``(a, b)``, a < b: ids whose texts differ as stored and are equal in their visual form.

    Pairs are made between distinct stored texts of one form first, then between their ids, so copies of one text
    are never paired with each other. Null ids and null texts have no pairs; rows of one id and text count once.
    """
    rows = visual_form(records.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()), id_col, text_col)
    f, r = ["form_x", "form_y"], ["text_x", "text_y"]
    hashed = rows.select("id", *_hash("form"), *_hash("text")).distinct()
    rows = Scratch(records.sparkSession, "lookalikes").save(hashed, "hashed")  # read four times below
    many = rows.groupBy(*f).agg(F.min("text_x").alias("u"), F.max("text_x").alias("v")).filter("u <> v").select(*f)
    rows = rows.join(many, f, "left_semi")
    kinds = rows.select(*f, *r).distinct()
    left = kinds.select(*f, *(F.col(x).alias(f"a_{x}") for x in r))
    right = kinds.select(*f, *(F.col(x).alias(f"b_{x}") for x in r))
    pairs = left.join(right, f).filter("struct(a_text_x, a_text_y) < struct(b_text_x, b_text_y)")
    one = rows.select(*f, *(F.col(x).alias(f"a_{x}") for x in r), F.col("id").alias("i"))
    two = rows.select(*f, *(F.col(x).alias(f"b_{x}") for x in r), F.col("id").alias("j"))
    out = pairs.join(one, [*f, "a_text_x", "a_text_y"]).join(two, [*f, "b_text_x", "b_text_y"])
    return out.filter("i <> j").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
