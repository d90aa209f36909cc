"""Problem 9: passages of held-out items inside a corpus.

Every window of ``length`` words of an item and of a document is walked by the CGK embedding (Chakraborty, Goldenberg,
Koucky 2016): step j copies the current word and moves on if a random bit of (j, word) says so, with the same random
bits on both sides. Equal windows give equal walks; windows a few word edits apart meet again and then agree, so edit
distance becomes Hamming distance. Bit sampling of the walk (``tables`` keys of ``bits`` sampled steps) finds windows
at small Hamming distance; exact edit verification decides. An exact run of ``length`` words is found with certainty.

The items are the bounded side (a fixed test set): their window keys are broadcast, checked against ``most_windows``;
a larger set is searched in blocks of that size. The corpus is read once per block, in parallel, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow
from . import codepoints as cp


def walk(word: np.ndarray, start: np.ndarray, length: int, steps: int, seed: int) -> np.ndarray:
    """The first ``steps`` of the 3 * length steps of the CGK walks of the windows at ``start``: (steps, windows) of
    symbols; past its end a window gives zeros."""
    at = np.zeros(len(start), np.int64)
    out = np.zeros((steps, len(start)), np.uint64)
    noise = np.random.default_rng(seed).integers(1, 2**63, 3 * length, dtype=np.uint64) | np.uint64(1)
    for j in range(steps):
        inside = at < length
        symbol = np.where(inside, word[np.minimum(start + at, len(word) - 1)], np.uint64(0))
        out[j] = symbol
        at += ((symbol * noise[j]) >> np.uint64(63)).astype(np.int64) & inside
    return out


def keys(word: np.ndarray, start: np.ndarray, length: int, tables: list[int], bits: int, seed: int) -> np.ndarray:
    """(tables, windows) of bit-sampling keys; each table has a walk of its own."""
    out = np.empty((len(tables), len(start)), np.uint64)
    for i, t in enumerate(tables):
        steps = np.sort(np.random.default_rng([seed, t]).choice(2 * length, bits, replace=False))
        walked = walk(word, start, length, int(steps[-1]) + 1, seed + 1 + t)
        h = np.full(len(start), np.uint64(t + 1))
        for s in steps:
            h = cp.mix(h * np.uint64(3) + walked[s])
        out[i] = h
    return out


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Word edit distances of the rows of two (windows, words) arrays, one dynamic program for all rows at once."""
    row = [np.full(len(a), j) for j in range(b.shape[1] + 1)]
    for i in range(a.shape[1]):
        last, row[0] = row[0], np.full(len(a), i + 1)
        for j in range(b.shape[1]):
            best = np.minimum(np.minimum(row[j + 1], row[j]) + 1, last + (a[:, i] != b[:, j]))
            last, row[j + 1] = row[j + 1], best
    return row[-1]


def edited(windows: np.ndarray, edits: int, seed: int) -> np.ndarray:
    """Copies of the windows with ``edits`` random word edits each (replaced, inserted or left out), of equal length."""
    rng = np.random.default_rng(seed)
    out = []
    for w in windows.tolist():
        for _ in range(edits):
            at, kind = int(rng.integers(len(w))), int(rng.integers(3))
            new = int(rng.integers(1, 2**63))
            w = w[:at] + ([new] if kind < 2 else []) + w[at + (kind != 1) :]
        out.append((w + [int(rng.integers(1, 2**63)) for _ in range(edits)])[: windows.shape[1]])
    return np.array(out, np.uint64)


def tables_for(windows: np.ndarray, recall: float, edits: int, bits: int, seed: int, sample: int = 500, most: int = 64) -> int:
    """Keys needed until the share ``recall`` of edited windows meets its original, measured on ``sample`` windows of the
    items (the walks do not depend on anything else). Raises ValueError if ``most`` keys do not reach it."""
    if not edits or not len(windows):
        return 1
    some = windows[np.random.default_rng(seed).permutation(len(windows))[:sample]]
    away = edited(some, edits, seed)
    good = edit_distances(some, away) <= edits
    n, met = windows.shape[1], np.zeros(len(some), bool)
    start = np.arange(len(some)) * n
    for t in range(most):
        a, b = (keys(x.ravel(), start, n, [t], bits, seed)[0] for x in (some, away))
        met |= a == b
        if met[good].mean() >= recall:
            return t + 1
    raise ValueError(f"{most} keys of {bits} sampled steps do not reach a recall of {recall}; take fewer bits")


class ItemIndex:
    """Window keys of the items, sorted; and a bitmap of their word runs that most corpus windows fail."""

    def __init__(self, ids: list, texts: list, length: int, edits: int, recall: float, bits: int, seed: int, gram: int = 3):
        self.length, self.edits, self.bits, self.seed, self.gram = length, edits, bits, seed, gram
        self.word, at = cp.words(*cp.decode(pa.array(texts, pa.string())))
        row = np.repeat(np.arange(len(ids)), np.diff(at))
        start = np.arange(max(0, len(self.word) - length + 1))
        self.start = start[row[start] == row[start + length - 1]] if len(start) else start
        self.owner = np.asarray(ids, np.int64)[row[self.start]] if len(self.start) else np.zeros(0, np.int64)
        windows = self.word[self.start[:, None] + np.arange(length)] if len(self.start) else np.zeros((0, length), np.uint64)
        self.tables = list(range(tables_for(windows, recall, edits, bits, seed)))
        k = keys(self.word, self.start, length, self.tables, bits, seed)
        order = np.argsort(k, axis=1, kind="stable")
        self.key, self.who = np.take_along_axis(k, order, 1), order
        runs, _, _ = cp.runs_of(self.word, at, gram)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(runs >> np.uint64(44)).astype(np.int64)] = True
        # a window of L words has L - g + 1 runs of g words; an edit breaks at most g of them
        self.least = max(1, length - gram + 1 - gram * edits)

    def search(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, item, edits) for every item a row's text contains a window of; the least edits of each."""
        word, at = cp.words(*cp.decode(text))
        n, none = self.length, np.zeros(0, np.int64)
        if len(word) < n or not len(self.start):
            return none, none, none
        row = np.repeat(np.arange(len(text)), np.diff(at))
        h = np.zeros(len(word) - self.gram + 1, np.uint64)
        for i in range(self.gram):
            h = cp.mix(h * np.uint64(3) + word[i : i + len(h)])
        known = np.zeros(len(h) + 1, np.int64)
        np.cumsum(self.seen[(h >> np.uint64(44)).astype(np.int64)], out=known[1:])
        windows = len(word) - n + 1
        many = known[n - self.gram + 1 : n - self.gram + 1 + windows] - known[:windows]
        start = np.flatnonzero((many >= self.least) & (row[:windows] == row[n - 1 :]))
        if not len(start):
            return none, none, none
        found = []
        for t, k in enumerate(keys(word, start, n, self.tables, self.bits, self.seed)):
            lo, hi = np.searchsorted(self.key[t], k, "left"), np.searchsorted(self.key[t], k, "right")
            size = hi - lo
            mine = np.repeat(np.arange(len(start)), size)
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            found.append(np.stack([start[mine], self.who[t][np.repeat(lo, size) + step]]))
        pair = np.unique(np.concatenate(found, axis=1), axis=1)
        # exact verification, equal windows all at once
        a = word[pair[0][:, None] + np.arange(n)]
        b = self.word[self.start[pair[1]][:, None] + np.arange(n)]
        away = (a != b).any(axis=1).astype(np.int64)
        if self.edits:
            off = np.flatnonzero(away)
            for lo in range(0, len(off), 100_000):
                part = off[lo : lo + 100_000]
                away[part] = edit_distances(a[part], b[part])
        good = away <= self.edits
        r, item, away = row[pair[0][good]], self.owner[pair[1][good]], away[good]
        order = np.lexsort((away, item, r))
        r, item, away = r[order], item[order], away[order]
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (item[1:] != item[:-1])
        return r[first], item[first], away[first]


def _search(index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in arrow.slices(batches, "text", 4_000_000):
            row, item, away = index.value.search(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(item), pa.array(away.astype(np.int32))], ["doc", "item", "edits"])

    return run


def leaks(
    documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text",
    item_text_col: str = "text", length: int = 13, edits: int = 0, recall: float = 0.95, bits: int = 4, seed: int = 7,
    most_windows: int = 200_000,
) -> DataFrame:
    """``(doc, item, edits)``: documents with a window of ``length`` words within ``edits`` word edits of a window of
    the item; ``edits`` comes out as the least found. With ``edits=0`` every exact run is found.

    Words are runs of letters and digits after lower-casing. Null ids or texts and items shorter than ``length`` words
    have no rows; repeated items and documents count once; an empty table on either side gives an empty result.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    kind = docs.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, item long, edits int"
    held = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text"))
    held = held.where("item is not null and text is not null").distinct().orderBy("item", "text")
    out, ids, texts, size = None, [], [], 0

    def add(out: DataFrame | None) -> DataFrame:
        index = ItemIndex(ids, texts, length, edits, recall, bits, seed)
        found = docs.mapInArrow(_search(spark.sparkContext.broadcast(index)), schema)
        return found if out is None else out.unionByName(found)

    for x in held.toLocalIterator():  # the query set, block by block
        ids.append(x.item)
        texts.append(x.text)
        size += len(x.text) // 2
        if size > most_windows:
            out, ids, texts, size = add(out), [], [], 0
    out = add(out) if ids or out is None else out
    return out.groupBy("doc", "item").agg(F.min("edits").alias("edits"))
