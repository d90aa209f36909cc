"""Problem 1: records that are the same but for white space, case, punctuation or field order.

Canonical records are range-partitioned and externally sorted (Spark's sort spills) by a digest of the canonical
key, the key and the id; one scan over adjacent records compares the full keys and names the first record of a run
its representative. The range covers (digest, id), so a key that a third of all records share spreads over as many
tasks as its size asks for; runs that cross a partition's edge are joined by one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch
from . import arrow, states

_RUNS = "part int, edge boolean, opening boolean, representative string, member string, first binary, last binary"


def _canonical(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in arrow.slices(batches, "state"):
        key = states.canonical(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), key], ["id", "key"]).filter(pc.is_valid(key))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (digest, key, id) to (representative, member); at the end one row on the partition's edges."""
    part = TaskContext.get().partitionId()
    key = ident = head = first = digest = None
    opening = True
    names = ["part", "edge", "opening", "representative", "member", "first", "last"]
    for b in batches:
        n = len(b)
        if not n:
            continue
        digests, keys, ids = b.column(0), b.column(1), b.column(2)
        first = digests[0].as_py() if first is None else first
        begins = np.ones(n, bool)
        begins[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        begins[0] = keys[0].as_py() != key
        again = np.zeros(n, bool)
        again[1:] = pc.equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)
        again[0] = ids[0].as_py() == ident
        again &= ~begins
        run = np.cumsum(begins)
        heads = pa.array([head], pa.string()).cast(ids.type)
        heads = pa.concat_arrays([heads, ids.take(pa.array(np.flatnonzero(begins)))])
        reps = heads.take(pa.array(run))
        # the partition's opening run: everything before its second run begins
        inside = (run <= (1 if key is None else 0)) if opening else np.zeros(n, bool)
        opening = bool(inside[-1])
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, bool)), pa.array(inside), reps, ids, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())],
            names,
        )
        yield out.filter(pa.array(~again))
        key, ident, head, digest = keys[n - 1].as_py(), ids[n - 1].as_py(), reps[n - 1].as_py(), digests[n - 1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([True]), pa.array([opening]), pa.array([head], pa.string()), pa.nulls(1, pa.string()), pa.array([first], pa.binary()), pa.array([digest], pa.binary())],
            names,
        )


def format_copies(records: DataFrame, id_col: str = "example_id", text_col: str = "state") -> DataFrame:
    """``(representative, member)`` for every record that has content; the representative is the least id of its run.

    Records without an id, with a null text, or with nothing left after removal of white space and punctuation do
    not come out. Rows of one id count once (per key). Other columns may have any name; they are not read.
    An empty table gives an empty result.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "format-copies")
    there = records.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("state"))
    there = there.where("id is not null and state is not null")
    rows = there.mapInArrow(_canonical, "id string, key string")
    rows = scratch.save(rows.select(F.unhex(F.sha2("key", 256)).alias("digest"), "key", "id"), "canonical")
    ordered = rows.repartitionByRange("digest", "id").sortWithinPartitions("digest", "key", "id")
    runs = scratch.save(ordered.mapInArrow(_scan, _RUNS), "runs")
    # one row per partition: which opening runs go on from the partition before, and whose they are
    carried, last, owner = [], None, None
    for e in runs.filter("edge").orderBy("part").collect():
        goes_on = last is not None and bytes(e.first) == last
        if goes_on:
            carried.append((e.part, owner))
        owner = owner if goes_on and e.opening else e.representative
        last = bytes(e.last)
    members = runs.filter("not edge").select("part", "opening", "representative", "member")
    if not carried:
        return members.select("representative", "member")
    carry = F.broadcast(spark.createDataFrame(carried, "part int, owner string").withColumn("opening", F.lit(True)))
    return members.join(carry, ["part", "opening"], "left").select(
        F.coalesce("owner", "representative").alias("representative"), "member"
    )


def copy_counts(records: DataFrame, id_col: str = "example_id", text_col: str = "state") -> DataFrame:
    """``(representative, copies)``: every distinct record once, with the exact number of ids that carry it."""
    found = format_copies(records, id_col, text_col)
    return found.groupBy("representative").agg(F.count(F.lit(1)).alias("copies"))
