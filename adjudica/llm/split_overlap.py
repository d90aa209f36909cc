"""Problem 5: records of evaluation splits that recur, exactly or almost, in the training split.

A sparse suffix array. The texts of all classes of records, as words, are one collection; of their suffixes those are kept
that begin with a run of a record's prefix (``shingle_classes``: any two records similar enough have one such run in common,
so the suffixes left out lose nothing). The suffixes are range-partitioned and sorted by their first words. A scan over
neighbours cuts the array where the common prefix falls below ``k`` words; where suffixes of both sides stand in between, their
records share that span, and bounds of size and place say which pairs can be similar. The exact similarity of these decides,
and the runs that a record shares with its partners are merged into its coverage.

Beyond ``k`` words the suffixes are not ordered, as the similarity counts runs of ``k`` words and no longer span is needed to
find a pair. An interval of more than ``hot`` suffixes is not left to one task: its training side is spread over parts, and
its evaluation side goes to each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hub_join
from ..storage import Scratch
from . import shingle_classes as sc

_MOST_PAIRS = 1 << 20


def _met(rows: pa.Table, least: float) -> Iterator[pa.RecordBatch]:
    """``(a, b)`` of training and evaluation suffixes between two cuts of the sorted array ``rows``."""
    key, n, rest, number = (rows.column(c).to_numpy() for c in ("gram", "n", "rest", "class"))
    train, other = (np.asarray(rows.column(c).to_numpy(zero_copy_only=False), bool) for c in ("train", "other"))
    cut = np.concatenate([[True], key[1:] != key[:-1]])  # neighbours with fewer than k words in common
    interval = np.cumsum(cut) - 1
    t, e = np.flatnonzero(train), np.flatnonzero(other)
    count = np.bincount(interval[t], minlength=interval[-1] + 1)
    begin = np.concatenate([[0], np.cumsum(count)])
    e = e[count[interval[e]] > 0]
    size = count[interval[e]]
    upto = np.cumsum(size)
    lo = 0
    while lo < len(e):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + _MOST_PAIRS, "right")))
        many = size[lo:hi]
        b = np.repeat(e[lo:hi], many)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        a = t[np.repeat(begin[interval[e[lo:hi]]], many) + step]
        need = np.ceil(least / (1 + least) * (n[a] + n[b]) - 1e-9)
        ok = (np.minimum(rest[a], rest[b]) >= need) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9) & (number[a] != number[b])
        pairs = np.unique(np.stack([number[a[ok]], number[b[ok]]]), axis=1) if ok.any() else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
        lo = hi


def _scan(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            held.append(b)
            rows = pa.Table.from_batches(held)
            key = rows.column("gram").to_numpy()
            at = int(np.searchsorted(key, key[-1], "left"))  # the last interval may go on
            if at:
                yield from _met(rows.slice(0, at), least)
            held = rows.slice(at).combine_chunks().to_batches()
        if held:
            yield from _met(pa.Table.from_batches(held), least)

    return run


def overlapping_classes(classes: DataFrame, scratch: Scratch, k: int, least: float, hot: int = 1000, slots: tuple[int, int] = sc.SLOTS) -> DataFrame:
    """Verified pairs of classes ``a`` with training and ``b`` with evaluation records."""
    sides = ["class", "train", "other"]
    index, many = sc.prefix_index(classes.where("train or other"), scratch, k, least, sides, by_words=True, hot=hot, slots=slots)
    suffixes = sc.unpacked(index, sides)
    cold = suffixes if many is None else suffixes.join(many.select("gram"), "gram", "left_anti")
    array = cold.repartitionByRange("gram").sortWithinPartitions("gram")
    met = array.mapInArrow(_scan(least), "a long, b long")
    if many is not None:
        total = many.agg(F.sum("n")).first()[0]
        rows = scratch.save(hub_join(suffixes, many.withColumn("hot_n", F.col("n")), "gram", total), "hot-rows")
        found = sc.hot_pairs(rows.where("other"), rows.where("train"), least, hot)
        met = met.unionByName(found.selectExpr("b as a", "a as b"))
    pairs = scratch.save(met.distinct(), "candidates")
    return sc.verify(pairs, classes, k, least, ["runs"]).select("a", "b", "similarity", F.col("runs_a"), F.col("runs_b"))


def _classes_of(records: DataFrame, scratch: Scratch, id_col: str, text_col: str, split_col: str, k: int, least: float, least_words: int, hot: int, slots) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``members(id, side, class)``, ``classes`` and all similar pairs of a class with training and one with evaluation records,
    a class of both sides with itself included."""
    rows = records.where(F.col(split_col).isNotNull())
    members, classes = sc.shingle_classes(rows, scratch, id_col, text_col, split_col, k, least_words)
    near = overlapping_classes(classes, scratch, k, least, hot, slots).select("a", "b", "similarity")
    same = classes.where("train and other").select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(1.0).alias("similarity"))
    near = scratch.save(near.unionByName(same), "near")
    facts = scratch.save(classes.select("u", "class", F.col("members").alias("n")), "facts")
    return hub_join(members, facts, "u", facts.agg(F.sum("n")).first()[0] or 0).drop("u"), classes, near


def split_overlap(
    records: DataFrame, id_col: str = "example_id", text_col: str = "state", split_col: str = "evaluation_split",
    k: int = 3, least: float = 0.7, least_words: int = 8, hot: int = 1000, slots: tuple[int, int] = sc.SLOTS,
) -> DataFrame:
    """``(train_id, eval_id, similarity)``: every pair of a record in split ``train`` and one in another split.

    Null splits are on neither side; null ids, null texts and texts of fewer than ``least_words`` words have no pairs.
    Copies are paired through their class, so work before the result does not grow with the pairs of copies. ``hot`` and
    ``slots`` choose among ways with equal results.
    """
    scratch = Scratch(records.sparkSession, "split-overlap")
    members, _, near = _classes_of(records, scratch, id_col, text_col, split_col, k, least, least_words, hot, slots)
    train = members.where("side = 'train'").select(F.col("class").alias("a"), F.col("id").alias("train_id")).distinct()
    other = members.where("side <> 'train'").select(F.col("class").alias("b"), F.col("id").alias("eval_id")).distinct()
    scratch.keep_only("members", "facts", "near")
    return near.join(train, "a").join(other, "b").where("train_id <> eval_id").select("train_id", "eval_id", "similarity")


def eval_coverage(
    records: DataFrame, id_col: str = "example_id", text_col: str = "state", split_col: str = "evaluation_split",
    k: int = 3, least: float = 0.7, least_words: int = 8, hot: int = 1000, slots: tuple[int, int] = sc.SLOTS,
) -> DataFrame:
    """``(eval_id, side, partners, most_similar, runs, covered)``, one row per evaluation record and split with a partner in the
    training split: how many training records it resembles, the greatest similarity, and how many of its distinct runs of ``k``
    words occur in one of them or another. Partners are counted by class, never listed, so a record with very many costs no
    more. Edge cases as in ``split_overlap``."""
    scratch = Scratch(records.sparkSession, "eval-coverage")
    members, classes, near = _classes_of(records, scratch, id_col, text_col, split_col, k, least, least_words, hot, slots)
    size = members.where("side = 'train'").groupBy("class").agg(F.count_distinct("id").alias("t"))
    counts = near.join(size.withColumnRenamed("class", "a"), "a").groupBy("b").agg(F.sum("t").alias("partners"), F.max("similarity").alias("most_similar"))
    words = classes.select("class", "words")
    met = near.where("a <> b").join(words.select(F.col("class").alias("a"), F.col("words").alias("words_a")), "a")
    met = met.join(words.select(F.col("class").alias("b"), F.col("words").alias("words_b")), "b").select("b", "words_a", "words_b")
    runs = met.mapInArrow(sc.shared_runs(k), "b long, run long").distinct().groupBy("b").agg(F.count(F.lit(1)).alias("found"))
    whole = classes.where("train and other").select(F.col("class").alias("b"), F.lit(True).alias("whole"))
    facts = counts.join(classes.select(F.col("class").alias("b"), "runs", F.col("members").alias("n")), "b").join(runs, "b", "left").join(whole, "b", "left")
    facts = facts.select(F.col("b").alias("class"), "partners", "most_similar", "runs", F.when(F.col("whole"), F.col("runs")).otherwise(F.col("found")).cast("long").alias("covered"), "n")
    facts = scratch.save(facts, "covered")
    other = members.where("side <> 'train'").select("class", F.col("id").alias("eval_id"), "side").distinct()
    scratch.keep_only("members", "facts", "covered")
    return hub_join(other, facts, "class", facts.agg(F.sum("n")).first()[0] or 0).drop("class")
