"""Problem 10: how much of each text occurs verbatim, in spans of a given length or more, in another text.

A character lies in such a span exactly if it lies in a window of ``length`` characters that another text has too. So
the result is the union of shared windows, found without comparing texts pairwise and in work proportional to the text:

1. Anchors. Of the runs of ``length / 2`` characters in a window the one of least hash is its anchor (winnowing; Schleimer,
   Wilkerson, Aiken 2003). Where a window has it more than once, the first is taken, or the last if the repeats reach back
   to the window's start: a choice by the window's own characters, so equal windows have equal anchors, and windows at the
   edge of a repeating stretch share theirs.
2. Windows that are periodic throughout (a line of dashes, a thousand equal lines) have no anchor but stand for themselves:
   of a stretch with period p at most p different ones, by their 128-bit digest.
3. Anchors that two texts have survive one aggregation, and go back to the texts, by a Bloom filter or, of more than it
   can hold, by a join.
4. The texts around one surviving anchor are one reference shard: a suffix automaton of them, with the owners of every
   substring, gives the matching statistics of each text against those of the others, and from them the maximal spans.
   An anchor that occurs more than ``hot`` times is split by window offset instead: aggregations with partial sums over window
   digests, no group in one task. The spans are the same either way.

An automaton of all texts, broadcast in shards, would give the same spans, but every shard would be streamed past by
every text: work that grows with the square of the corpus. The anchors leave each shard only the texts that can match.

Equal texts are one class (128-bit digest), so a text that a third of the corpus repeats costs no more than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hub_join
from ..storage import Scratch
from . import arrow, suffix_automaton
from . import codepoints as cp


def sliding(x: np.ndarray, w: int, reduce: np.ufunc, fill: int) -> np.ndarray:
    """``reduce`` over every window of ``w`` neighbours, in time independent of ``w`` (van Herk)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-(-len(x) // w) * w, fill, x.dtype)
    pad[: len(x)] = x
    rows = pad.reshape(-1, w)
    ahead = reduce.accumulate(rows, axis=1).ravel()
    behind = reduce.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return reduce(behind[:n], ahead[w - 1 : w - 1 + n])


_AT = 31  #: bits of a position within a slice; the other 33 of 64 hold a hash, of which equal values only widen the choice


def _leftmost(gram: np.ndarray, w: int, back: bool = False) -> np.ndarray:
    """Where the first (``back``: the last) of the least hashes of every window of ``w`` stands."""
    at = np.arange(len(gram), dtype=np.uint64)
    mask = np.uint64((1 << _AT) - 1)
    least = sliding(gram & ~mask | (mask - at if back else at), w, np.minimum, np.iinfo(np.uint64).max) & mask
    return (mask - least if back else least).astype(np.int64)


def _next_equal(hash_: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of the sorted positions ``at`` the next of them with the same hash, or -1."""
    order = np.lexsort((at, hash_[at]))
    there = at[order]
    out = np.full(len(at), -1)
    same = hash_[there[1:]] == hash_[there[:-1]]
    out[order[:-1][same]] = there[1:][same]
    return out


def anchors(
    points: np.ndarray, offsets: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, row, position) of the anchors of every row of at least ``length`` characters; and (row, start, stop) of the
    periodic windows, one for every phase of a stretch: ``start`` of the first such window, ``stop`` of the last."""
    half = length // 2
    none = np.zeros(0, np.int64)
    if len(points) < length:
        return np.zeros(0, np.uint64), none, none, (none, none, none)
    h = cp.prefix_hash(points)
    begin = np.arange(len(points) - half + 1)
    gram = cp.span_hash(h, begin, begin + half)
    w = length - half + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first, last = _leftmost(gram, w), _leftmost(gram, w, back=True)
    window = np.flatnonzero(row[: len(first)] == row[length - 1 :])  # not across rows
    first, last = first[window], last[window]
    choice, periodic = first, np.zeros(len(window), bool)
    several = np.flatnonzero(first != last)
    if len(several):
        choice = first.copy()
        mask = ~np.uint64((1 << _AT) - 1)
        cover = np.zeros(len(gram) + 1, np.int64)
        np.add.at(cover, window[several], 1)
        np.add.at(cover, window[several] + w, -1)
        at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        step = _next_equal(gram & mask, at)[np.searchsorted(at, first[several])] - first[several]
        start = window[several]
        reaches = first[several] - start < step
        choice[several[reaches]] = last[several[reaches]]
        some = np.flatnonzero(reaches & (start + w - 1 - last[several] < step))
        x, p = start[some], step[some]
        true = cp.span_hash(h, x, x + length - p) == cp.span_hash(h, x + p, x + length)
        periodic[several[some[true]]] = True
        stretch = _stretches(x[true], p[true], row, length)
    else:
        stretch = (none, none, none)
    at = np.unique(choice[~periodic])
    at_row, at_start, at_stop = stretch
    base = offsets[at_row]
    return gram[at], row[at], at - offsets[row[at]], (at_row, at_start - base, at_stop - base)


def _stretches(x: np.ndarray, p: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periodic windows at ``x`` of period ``p`` gathered into stretches of neighbours, and one row for each phase of those."""
    if not len(x):
        return x, x, x
    new = np.concatenate([[True], (x[1:] != x[:-1] + 1) | (p[1:] != p[:-1]) | (row[x[1:]] != row[x[:-1]])])
    lo = np.flatnonzero(new)
    hi = np.concatenate([lo[1:], [len(x)]]) - 1
    phases = np.minimum(p[lo], x[hi] - x[lo] + 1)
    step = np.arange(phases.sum()) - np.repeat(np.cumsum(phases) - phases, phases)
    start, period, end = np.repeat(x[lo], phases) + step, np.repeat(p[lo], phases), np.repeat(x[hi], phases)
    return row[start], start, start + (end - start) // period * period + length


def _digests(text: pa.Array) -> list[bytes]:
    return [hashlib.blake2b(memoryview(t.as_buffer()), digest_size=16).digest() for t in text]


def _first_of_each(x: list) -> np.ndarray:
    seen: set = set()
    return np.array([not (k in seen or seen.add(k)) for k in x], bool)


def _classes(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches, "text", 3_000_000):
            points, offsets = cp.decode(b.column(1))
            whole = _digests(b.column(1))
            h, row, _, (p_row, p_start, p_stop) = anchors(points, offsets, length)
            told = _first_of_each(whole)
            mine = told[row]
            ends = np.searchsorted(row[mine], np.arange(len(b) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[mine].view(np.int64)))
            p_mine = np.flatnonzero(told[p_row])
            p_row, p_start, p_stop = p_row[p_mine], p_start[p_mine], p_stop[p_mine]
            here = offsets[p_row] + p_start
            keys = [hashlib.blake2b(points[a : a + length].tobytes(), digest_size=16).digest() for a in here.tolist()]
            cells = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(p_start), pa.array(p_stop)], ["key", "start", "stop"])
            order = np.argsort(p_row, kind="stable")
            p_ends = np.searchsorted(p_row[order], np.arange(len(b) + 1)).astype(np.int32)
            stretches = pa.ListArray.from_arrays(pa.array(p_ends), cells.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(whole, pa.binary()), pa.array(np.diff(offsets)), lists, stretches], ["doc", "class", "chars", "anchors", "periodic"]
            )

    return run


def _bits(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, bool)
        for b in batches:
            for slot in bloom_slots(b.column(0).to_numpy().view(np.uint64), size):
                seen[slot] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], ["bits"])

    return run


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for x in b.column(0):
            bits = np.frombuffer(x.as_buffer(), np.uint8)
            total = bits.copy() if total is None else total | bits
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["bits"])


def bloom_slots(h: np.ndarray, size: int) -> list[np.ndarray]:
    return [(cp.mix(h + np.uint64(i)) & np.uint64(size - 1)).astype(np.int64) for i in (11, 23, 37)]


def bloom(keys: DataFrame, count: int, most_bits: int = 1 << 28, fan_in: int = 8) -> np.ndarray:
    """Bloom filter of a column of longs: 16 bits a key, never more than ``most_bits`` (32 MB); made in the partitions and
    united in a tree."""
    size = 1 << max(16, min(most_bits.bit_length() - 1, (16 * max(1, count)).bit_length()))
    tables = keys.coalesce(64).mapInArrow(_bits(size), "bits binary")
    parts = tables.rdd.getNumPartitions()
    while parts > fan_in:
        parts = -(-parts // fan_in)
        tables = tables.repartition(parts).mapInArrow(_either, "bits binary")
    total = np.zeros(size // 8, np.uint8)
    for row in tables.toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(total).astype(bool)


def _contexts(length: int, filter_=None) -> Callable:
    """``(anchor, class, at, before, text)`` of the anchors that ``filter_`` holds, or those in the third column."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if filter_ is None else np.unpackbits(filter_.value).astype(bool)
        for b in arrow.slices(batches, "text", 3_000_000):
            points, offsets = cp.decode(b.column(1))
            whole = _digests(b.column(1))
            h, row, at, _ = anchors(points, offsets, length)
            use = _first_of_each(whole)[row]
            if known is not None:
                for slot in bloom_slots(h, len(known)):
                    use &= known[slot]
            else:
                lists = b.column(2)
                mine = cp.mix(lists.flatten().to_numpy().view(np.uint64) ^ cp.mix(np.repeat(np.arange(len(b)), np.diff(lists.offsets.to_numpy())).astype(np.uint64)))
                use &= np.isin(cp.mix(h ^ cp.mix(row.astype(np.uint64))), mine)
            h, row, at = h[use], row[use], at[use]
            here = at + offsets[row]
            lo, hi = np.maximum(offsets[row], here - (length - half)), np.minimum(offsets[row + 1], here + length)
            size = hi - lo
            ends = np.concatenate([[0], np.cumsum(size)])
            index = np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(lo, size)
            text = cp.encode(points[index], ends)
            owner = pa.array(whole, pa.binary()).take(pa.array(row))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), owner, pa.array(at), pa.array((here - lo).astype(np.int32)), text], ["anchor", "class", "at", "before", "text"]
            )

    return run


def _spans_of(table: pa.Table, length: int) -> pa.RecordBatch:
    """Spans (class, start, stop) of the texts around whole anchors (sorted by anchor) that another class has there too.

    Texts that agree throughout share all they have; the others of an anchor, one of each, go into one automaton.
    """
    anchor, at, before = (table.column(i).to_numpy() for i in (0, 2, 3))
    owner, texts = table.column(1).to_pylist(), table.column(4).to_pylist()
    begin = at - before
    edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
    out: list[tuple[bytes, int, int]] = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if hi - lo < 2:
            continue
        same: dict[str, list[int]] = {}
        for i in range(lo, hi):
            same.setdefault(texts[i], []).append(i)
        common = {t: len({owner[i] for i in x}) > 1 for t, x in same.items()}
        for t, x in same.items():
            if common[t] and len(t) >= length:
                out += [(owner[i], begin[i], begin[i] + len(t)) for i in x]
        if len(same) > 1:
            kinds = list(same)
            # a text of several classes is covered above; to the others it is another's whichever class they are of
            owners = [("several", t) if common[t] else owner[same[t][0]] for t in kinds]
            found = suffix_automaton.shared_spans(kinds, owners, length)
            out += [(owner[i], begin[i] + a, begin[i] + z) for t, x in zip(kinds, found) if not common[t] for a, z in x for i in same[t]]
    kinds = (pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["class", "start", "stop"])


def _compare(length: int, most: int = 4096) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for whole in batches:
            for lo in range(0, len(whole), most):
                held.append(whole.slice(lo, most))
                table = pa.Table.from_batches(held)
                a = table.column(0).to_numpy()
                cut = int(np.searchsorted(a, a[-1], "left"))  # the last anchor's rows may go on
                if cut:
                    yield _spans_of(table.slice(0, cut), length)
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield _spans_of(pa.Table.from_batches(held), length)

    return run


def _split_by_offset(contexts: DataFrame, length: int) -> DataFrame:
    """The spans of hot anchors: every (anchor, offset, window) is a key of its own."""
    rows = contexts.selectExpr("anchor", "class", "at", "before", "text", "explode(sequence(0, before)) as step")
    rows = rows.filter(F.expr(f"char_length(text) >= step + {length}")).selectExpr(
        "class", "at - before + step as start",
        f"struct(anchor, before - step as back, xxhash64(substring(text, step + 1, {length})) as x, xxhash64(5, substring(text, step + 1, {length})) as y) as u",
    )
    facts = rows.groupBy("u").agg(F.min("class").alias("a"), F.max("class").alias("z"), F.count(F.lit(1)).alias("n"))
    facts = facts.filter("a <> z").select("u", "n")
    total = facts.agg(F.sum("n")).first()[0] or 0
    return hub_join(rows, facts, "u", total).selectExpr("class", "start", f"start + {length} as stop")


def _periodic_spans(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The periodic windows that two classes have."""
    cells = rows.where(F.size("periodic") > 0).select("class", F.explode("periodic").alias("c")).select("class", "c.*").withColumnRenamed("key", "u")
    facts = cells.groupBy("u").agg(F.min("class").alias("a"), F.max("class").alias("z"), F.count(F.lit(1)).alias("n"))
    facts = scratch.save(facts.filter("a <> z").select("u", "n"), "periodic")
    total = facts.agg(F.sum("n")).first()[0] or 0
    return hub_join(cells, facts, "u", total).select("class", "start", "stop")


def shared_spans(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, hot: int = 1000, most_bits: int = 1 << 28
) -> DataFrame:
    """``(doc, chars, shared_chars)`` for every text of which at least one span of ``length`` characters occurs in another.

    Repeats within one text do not count. Null ids and texts shorter than ``length``, empty and null ones have no rows;
    rows of equal id and text count once. ``length`` is at least 2. ``hot`` and ``most_bits`` choose among ways with equal
    results: splitting an anchor by window offset, and a join where a Bloom filter of that size would be too full.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "shared-spans")
    docs = documents.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    docs = docs.where(F.col("doc").isNotNull() & (F.char_length("text") >= length))
    kind = docs.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, class binary, chars long, anchors array<long>, periodic array<struct<key: binary, start: long, stop: long>>"
    rows = scratch.save(docs.mapInArrow(_classes(length), schema), "classes")
    members = rows.select("doc", "class", "chars").distinct()
    spans = _periodic_spans(rows, scratch)
    facts = rows.select("class", F.explode("anchors").alias("anchor")).groupBy("anchor")
    facts = facts.agg(F.min("class").alias("a"), F.max("class").alias("z"), F.count(F.lit(1)).alias("n")).filter("a <> z")
    facts = scratch.save(facts.select("anchor", "n"), "anchors")
    seen = facts.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    if seen.keys:
        schema = "anchor long, class binary, at long, before int, text string"
        if 16 * seen.keys <= most_bits:
            known = spark.sparkContext.broadcast(np.packbits(bloom(facts.select("anchor"), seen.keys, most_bits)))
            contexts = docs.mapInArrow(_contexts(length, known), schema)
        else:  # the anchors that survive go to their documents, a list no longer than the text
            here = hub_join(rows.select("doc", F.explode("anchors").alias("anchor")), facts, "anchor", seen.rows)
            here = here.groupBy("doc").agg(F.collect_set("anchor").alias("known"))
            contexts = docs.join(here, "doc").select("doc", "text", "known").mapInArrow(_contexts(length), schema)
        if seen.most > hot:
            contexts = scratch.save(contexts, "contexts")
            hots = hub_join(contexts, facts.filter(f"n > {hot}"), "anchor", seen.rows)
            spans = spans.unionByName(_split_by_offset(hots, length))
            contexts = contexts.join(facts.filter(f"n > {hot}"), "anchor", "left_anti")
        contexts = contexts.repartition("anchor").sortWithinPartitions("anchor")
        spans = spans.unionByName(contexts.mapInArrow(_compare(length), "class binary, start long, stop long"))
    before = Window.partitionBy("class").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.groupBy("class", "start").agg(F.max("stop").alias("stop"))
    spans = spans.withColumn("reached", F.coalesce(F.max("stop").over(before), F.lit(0)))
    covered = spans.groupBy("class").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reached"))).alias("covered"))
    kinds = members.groupBy("class").agg(F.count(F.lit(1)).alias("n")).join(covered, "class", "left")
    kinds = scratch.save(kinds.filter("n > 1 or covered is not null"), "result")
    scratch.keep_only("classes", "result")
    total = kinds.agg(F.sum("n")).first()[0] or 0
    kinds = kinds.select("class", "n", "covered", (F.col("n") > 1).alias("copied"))
    out = hub_join(members, kinds, "class", total)
    return out.selectExpr("doc", "chars", "case when copied then chars else covered end as shared_chars")
