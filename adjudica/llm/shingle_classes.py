"""Records as sets of word runs, one class per distinct set; and the prefix index that near-duplicate searches use.

Exactness. Order the runs of every record by one global order. Records x and y of similarity t or more share at least
``need = ceil(t / (1 + t) (|x| + |y|))`` runs, so at most ``|x| - need`` runs of x are not in y, and the first run that both
have stands at place ``|x| - need`` or before in x and at ``|y| - need`` or before in y. Pairs without such a run need not be
looked at, whatever the order; since ``need >= t max(|x|, |y|)``, the first ``n - ceil(t n) + 1`` runs of each record (its
prefix) hold it. The order used here is by how many classes have the run, rarest first, counted over all classes: common
phrases then lie outside the prefixes. A run of one class only takes its place in the order but is not indexed.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hub_join
from ..storage import Scratch
from . import arrow, states
from . import codepoints as cp

#: Counters of the run-count table (4 bytes each): one for every two runs, between these bounds. Of more runs than 16
#: times the upper bound, exact counts are made by a shuffle instead, with the same pairs in the end.
SLOTS = (1 << 18, 1 << 25)
#: Ids of classes to verify are broadcast up to this number (8 bytes each); more are joined by a shuffle.
MOST_MET = 500_000
_GRAM_BITS, _RANK_BITS = 41, 6
_ROWS = 1 << 16


def word_lists(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return cp.words(*cp.visual_form(*cp.decode(text)))


def unique_runs(word: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of each row as 44-bit hashes, sorted by (row, hash), and row offsets; at most 2^20 rows. Row and hash
    share one integer, so one sort of integers does."""
    h, row, _ = cp.runs_of(word, offsets, k)
    x = np.unique(row.astype(np.uint64) << np.uint64(44) | h >> np.uint64(20))
    return x & np.uint64((1 << 44) - 1), np.searchsorted(x >> np.uint64(44), np.arange(len(offsets)).astype(np.uint64))


def _classes(k: int, least_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches, "state", 4_000_000):
            word, at = word_lists(states.texts(b.column(2)))
            h, to = unique_runs(word, at, k)
            total = np.zeros((2, len(h) + 1), np.uint64)
            np.cumsum(cp.mix(h + np.uint64(1)), out=total[0, 1:], dtype=np.uint64)
            np.cumsum(cp.mix(h + np.uint64(5)), out=total[1, 1:], dtype=np.uint64)
            sums = [cp.mix(total[i, to[1:]] - total[i, to[:-1]] + np.diff(to).astype(np.uint64)) for i in (0, 1)]
            long = np.flatnonzero(np.diff(at) >= least_words)
            _, first = np.unique(sums[0][long], return_index=True)
            told = np.zeros(len(b), bool)
            told[long[first]] = True
            size = np.where(told, np.diff(at), 0)
            start = np.repeat(told, np.diff(at))
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(word[start].view(np.int64)), mask=pa.array(~told))
            out = pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(np.diff(to).astype(np.int32)), lists],
                ["id", "side", "x", "y", "runs", "words"],
            )
            yield out.take(pa.array(long))

    return run


def shingle_classes(
    records: DataFrame, scratch: Scratch, id_col: str, text_col: str, side_col: str | None = None, k: int = 3, least_words: int = 8
) -> tuple[DataFrame, DataFrame]:
    """``members(id, side, u)`` and ``classes(u, class, runs, words, name, members, train, other)``.

    A class is a distinct set of ``k``-word runs, known by ``u``: two 64-bit sums over the set, compared together. ``class``
    is its number in the table written; ``name`` is its least id. Records with null id or text or fewer than
    ``least_words`` words are in no class; rows of one id and class count once.
    """
    side = F.col(side_col).cast("string") if side_col else F.lit(None).cast("string")
    rows = records.select(F.col(id_col).cast("string").alias("id"), side.alias("side"), F.col(text_col).alias("state"))
    rows = rows.where("id is not null and state is not null")
    schema = "id string, side string, x long, y long, runs int, words array<long>"
    rows = scratch.save(rows.mapInArrow(_classes(k, least_words), schema), "records")
    members = rows.select("id", "side", F.struct("x", "y").alias("u")).distinct()
    facts = members.groupBy("u").agg(
        F.min("id").alias("name"), F.count_distinct("id").alias("members") if side_col else F.count(F.lit(1)).alias("members"),
        F.max(F.col("side") == "train").alias("train"), F.max(F.col("side") != "train").alias("other"),
    )
    words = rows.where("words is not null").groupBy(F.struct("x", "y").alias("u")).agg(F.first("runs").alias("runs"), F.first("words").alias("words"))
    classes = words.join(facts, "u").withColumn("class", F.monotonically_increasing_id())  # final once written
    classes = scratch.save(classes, "classes")
    members = scratch.save(members, "members")
    scratch.drop("records")
    return members, classes


def _table(count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([zlib.compress(count.astype("<u4").tobytes(), 1)], pa.binary())], ["counts"])


def _count(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u4")


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = a + b
    total[total < a] = 2**32 - 1  # counts beyond 32 bits stay at the top
    return total


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    return (h >> np.uint64(38)).astype(np.int64) & (slots - 1)


def _sketch(k: int, slots: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(slots, np.uint32)
        for b in batches:
            lists = b.column(0)
            h, _, _ = cp.runs_of(lists.flatten().to_numpy().view(np.uint64), _list_offsets(lists), k)
            slot, n = np.unique(_slot(h, slots), return_counts=True)
            count[slot] += n.astype(np.uint32)  # 2^32 rows of one run do not fit one task
        yield _table(count)

    return run


def _add(slots: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for b in batches:
            for x in b.column(0).to_pylist():
                total = _sum(total, _count(x))
        yield _table(total)

    return run


def _list_offsets(lists: pa.ListArray) -> np.ndarray:
    at = lists.offsets.to_numpy().astype(np.int64)
    return at - at[0]


def run_counts(classes: DataFrame, k: int, slots: int, fan_in: int = 8) -> np.ndarray:
    """How often the runs of each slot occur, over all classes: partitions' tables are added up in a tree, and the
    driver gets at most ``fan_in`` tables, one after the other."""
    tables = classes.select("words").mapInArrow(_sketch(k, slots), "counts binary")
    parts = tables.rdd.getNumPartitions()
    while parts > fan_in:
        parts = -(-parts // fan_in)
        tables = tables.repartition(parts).mapInArrow(_add(slots), "counts binary")
    total = np.zeros(slots, np.uint32)
    for row in tables.toLocalIterator():
        total = _sum(total, _count(row.counts))
    return total


def _word_key(word: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` words from each position on as one integer that sorts as they do, word by word (in the order of the words'
    leading hash bits)."""
    bits = 63 // k
    key = np.zeros(len(at), np.uint64)
    for i in range(k):
        key = key << np.uint64(bits) | word[at + i] >> np.uint64(64 - bits)
    return key


def _prefixes(k: int, least: float, rank: np.ndarray, single: np.ndarray, by_words: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), _ROWS // 2):
                part = b.slice(lo, _ROWS // 2)
                lists = part.column(part.schema.get_field_index("words"))
                word = lists.flatten().to_numpy().view(np.uint64)
                h, row, pos = cp.runs_of(word, _list_offsets(lists), k)
                slot = _slot(h, len(rank))
                # row | rank | run in one integer: one sort gives every row's runs, rarest first
                x = row.astype(np.uint64) << np.uint64(_GRAM_BITS + _RANK_BITS) | rank[slot].astype(np.uint64) << np.uint64(_GRAM_BITS)
                x |= h & np.uint64((1 << _GRAM_BITS) - 1)
                x, first = np.unique(x, return_index=True) if by_words else (np.unique(x), None)
                row = (x >> np.uint64(_GRAM_BITS + _RANK_BITS)).astype(np.int64)
                at = np.searchsorted(row, np.arange(len(part) + 1))
                n = np.diff(at)
                place = np.arange(len(x)) - at[row]
                grade = (x >> np.uint64(_GRAM_BITS)).astype(np.int64) & ((1 << _RANK_BITS) - 1)
                use = np.flatnonzero((place < (n - np.ceil(least * n - 1e-9) + 1)[row]) & ~single[grade])
                row, grade = row[use], grade[use]
                key = _word_key(word, pos[first[use]], k) if by_words else x[use] & np.uint64((1 << (_GRAM_BITS + _RANK_BITS)) - 1)
                rest = [part.column(i).take(pa.array(row)) for i, c in enumerate(part.schema.names) if c != "words"]
                shape = n[row] << 36 | place[use] << 8 | grade
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int64)), pa.array(shape), *rest], ["gram", "shape", *(c for c in part.schema.names if c != "words")]
                )

    return run


def _runs(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), _ROWS // 2):
                part = b.slice(lo, _ROWS // 2)
                lists = part.column(1)
                word = lists.flatten().to_numpy().view(np.uint64)
                h, row, pos = cp.runs_of(word, _list_offsets(lists), k)
                x, first = np.unique(row.astype(np.uint64) << np.uint64(_GRAM_BITS) | h & np.uint64((1 << _GRAM_BITS) - 1), return_index=True)
                row = (x >> np.uint64(_GRAM_BITS)).astype(np.int64)
                run_, key = (x & np.uint64((1 << _GRAM_BITS) - 1)).astype(np.int64), _word_key(word, pos[first], k).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(np.bincount(row)[row]), pa.array(run_), pa.array(key)], ["class", "n", "run", "key"]
                )

    return run


def _shuffled_index(classes: DataFrame, scratch: Scratch, k: int, least: float, keep: list[str], by_words: bool) -> DataFrame:
    """The prefix index with exact counts by a shuffle: where the table of counters would be too large to send."""
    runs = classes.select("class", "words").mapInArrow(_runs(k), "class long, n long, run long, key long")
    counts = scratch.save(runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("c", F.col("n")), "run-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = hub_join(runs.withColumnRenamed("n", "size"), counts, "run", total)
    # of each class its runs of two classes or more, rarest first; those of one class stand before them
    lists = common.groupBy("class", "size").agg(F.sort_array(F.collect_list(F.struct("c", "run", "key"))).alias("r"))
    at = lists.select("class", "size", (F.col("size") - F.size("r")).alias("before"), F.posexplode("r").alias("i", "r"))
    at = at.withColumn("place", F.col("before") + F.col("i")).where(f"place <= size - ceil({least}D * size - 1e-9D)")
    grade = F.least(F.floor(F.log2(F.col("r.c") + 1.0) * 2), F.lit(63))
    gram = F.col("r.key") if by_words else grade * (1 << _GRAM_BITS) + F.col("r.run")
    shape = F.shiftleft(F.col("size").cast("long"), 36) + F.shiftleft(F.col("place").cast("long"), 8) + grade
    at = at.select("class", gram.cast("long").alias("gram"), shape.cast("long").alias("shape"))
    rest = [c for c in keep if c != "class"]
    return (at.join(classes.select("class", *rest), "class") if rest else at).select("gram", "shape", *keep)


def prefix_index(
    classes: DataFrame, scratch: Scratch, k: int, least: float, keep: list[str], by_words: bool = False, hot: int = 1000, slots: tuple[int, int] = SLOTS
) -> tuple[DataFrame, DataFrame | None]:
    """``(index, hot)``. Index: a table ``(gram, shape, *keep)`` of the prefix runs that two classes may have; ``shape`` packs
    the class's number of runs, the run's place in the order and its grade (a logarithm of its count). ``by_words``: ``gram``
    is the run's words in sorting order, else a hash. Hot: ``(gram, n)`` of those that more than ``hot`` classes have in
    their prefixes, None if none has."""
    runs = classes.agg(F.sum("runs")).first()[0] or 0
    if runs > 16 * slots[1]:
        index, limit = _shuffled_index(classes, scratch, k, least, keep, by_words), int(2 * np.log2(1 + hot))
    else:
        count = run_counts(classes, k, min(max(slots[0], 1 << (runs // 2).bit_length()), slots[1]))
        mean = max(1.0, float(count.mean()))
        grades = lambda c: np.minimum(np.log2(1 + c / mean) * 6, 62).astype(np.uint8) + np.uint8(1)
        rank = np.concatenate([np.where(c > 1, grades(c), 0).astype(np.uint8) for c in np.split(count, max(1, len(count) >> 18))])  # 0: of one class at most
        single = np.arange(1 << _RANK_BITS) == 0
        kinds = {f.name: f.dataType.simpleString() for f in classes.schema.fields}
        schema = "gram long, shape long, " + ", ".join(f"`{c}` {kinds[c]}" for c in keep)
        index, limit = classes.select("words", *keep).mapInArrow(_prefixes(k, least, rank, single, by_words), schema), int(grades(np.array(hot)))
    index = scratch.save(index, "index")
    many = index.where(F.col("shape").bitwiseAND(F.lit((1 << 8) - 1)) >= limit).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(f"n > {hot}")
    many = scratch.save(many, "hot")
    return index, many if many.take(1) else None


def unpacked(index: DataFrame, columns: list[str]) -> DataFrame:
    """With ``n`` (runs of the class) and ``rest`` (runs of the class from this one on)."""
    n, place = "shiftright(shape, 36)", "(shiftright(shape, 8) & 268435455)"
    return index.selectExpr("gram", f"{n} as n", f"{n} - {place} as rest", *columns)


def enough(least: float, a: str = "a", b: str = "b") -> str:
    """Whether a run that both have can be the first of a pair of similarity ``least``: sizes and places allow it."""
    return f"least({a}.rest, {b}.rest) >= ceil({least}D / (1 + {least}D) * ({a}.n + {b}.n) - 1e-9D) and least({a}.n, {b}.n) >= {least}D * greatest({a}.n, {b}.n) - 1e-9D"


def hot_pairs(few: DataFrame, all_: DataFrame, least: float, share: int) -> DataFrame:
    """``(a, b)`` of ``few(gram, n, rest, class, hot_n)`` with ``all_`` of the same columns, in the same gram: the rows of a gram in
    ``all_`` are spread over one part for every ``share`` of them, and those of ``few`` go to each."""
    parts = f"cast(ceil(hot_n / {share}D) as int)"
    few = few.selectExpr("gram", "n", "rest", "class", f"explode(sequence(0, {parts} - 1)) as part").alias("a")
    all_ = all_.selectExpr("gram", "n", "rest", "class", f"pmod(xxhash64(class), {parts}) as part").alias("b")
    met = few.join(all_, F.expr(f"a.gram = b.gram and a.part = b.part and a.class <> b.class and {enough(least)}"))
    return met.selectExpr("a.class as a", "b.class as b")


def _overlap(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), _ROWS // 8):
                part = b.slice(lo, _ROWS // 8)
                names, n = part.schema.names, len(part)
                found, sizes = [], []
                for c in ("words_a", "words_b"):
                    lists = part.column(names.index(c))
                    h, row, at = cp.runs_of(lists.flatten().to_numpy().view(np.uint64), _list_offsets(lists), k)
                    found.append((h, row, at))
                both = [cp.mix(h ^ cp.mix(row.astype(np.uint64) + np.uint64(99))) for h, row, _ in found]
                uniq = [np.unique(x, return_index=True) for x in both]
                shared = np.intersect1d(uniq[0][0], uniq[1][0], assume_unique=True)
                hit = np.searchsorted(uniq[0][0], shared)
                inter = np.bincount(found[0][1][uniq[0][1][hit]], minlength=n)
                for (h, row, at), x, (u, i) in zip(found, both, uniq):
                    sizes.append(np.bincount(row[i], minlength=n))
                union = sizes[0] + sizes[1] - inter
                rest = [c for c in names if not c.startswith("words_")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(inter / np.maximum(union, 1)), *(part.column(names.index(c)) for c in rest)], ["similarity", *rest]
                )

    return run


def shared_runs(k: int) -> Callable:
    """``(b, run)`` of rows ``(b, words_a, words_b)``: the distinct runs of the second list that the first has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), _ROWS // 8):
                part = b.slice(lo, _ROWS // 8)
                keyed, runs, rows = [], [], []
                for i in (1, 2):
                    lists = part.column(i)
                    h, row, _ = cp.runs_of(lists.flatten().to_numpy().view(np.uint64), _list_offsets(lists), k)
                    keyed.append(cp.mix(h ^ cp.mix(row.astype(np.uint64) + np.uint64(99))))
                    runs.append(h)
                    rows.append(row)
                _, at = np.unique(keyed[1], return_index=True)
                at = at[np.isin(keyed[1][at], keyed[0])]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[1][at])), pa.array(runs[1][at].view(np.int64))], ["b", "run"])

    return run


def verify(pairs: DataFrame, classes: DataFrame, k: int, least: float, keep: list[str]) -> DataFrame:
    """Pairs ``(a, b)`` of numbers of classes, of similarity ``least`` or more, exactly: with similarity and ``keep`` of both sides as ``<c>_a, <c>_b``."""
    met = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    few = met.limit(MOST_MET + 1).count() <= MOST_MET
    classes = classes.join(F.broadcast(met) if few else met, "class", "left_semi")  # else by shuffle
    for s in ("a", "b"):
        side = classes.select(F.col("class").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ["words", *keep]))
        pairs = pairs.join(side, s)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}
    rest = ", ".join(f"`{c}` {t}" for c, t in kinds.items() if not c.startswith("words_"))
    return pairs.mapInArrow(_overlap(k), f"similarity double, {rest}").filter(F.col("similarity") >= least)
