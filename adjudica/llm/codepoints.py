"""Text as numpy code-point arrays: a whole Arrow batch at a time, without a Python call per string.

A batch of strings is one ``uint32`` array of code points plus row offsets. Tables over code points are built from
``unicodedata`` by rule, once per Python worker.
"""

from __future__ import annotations

import hashlib
import itertools
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

TOP = 0x110000

# Cyrillic and Greek letters drawn like a Latin letter, and that letter.
LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P",
    "С": "C", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I", "Ѵ": "V",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "Ϝ": "F", "Ϻ": "M", "ϒ": "Y",
    # Greek small letters
    "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "α": "a", "γ": "y", "υ": "u", "ϲ": "c", "ϳ": "j",
}
# The code points that Unicode says are to be ignored in display (Default_Ignorable_Code_Point).
INVISIBLE = [
    0x00AD, 0x034F, 0x061C, *range(0x115F, 0x1161), *range(0x17B4, 0x17B6), *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F),
    *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xFFF0, 0xFFF9), *range(0x1BCA0, 0x1BCA4), *range(0x1D173, 0x1D17B), *range(0xE0000, 0xE1000),
]


def decode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points and row offsets of a string column; a null is a row of length 0."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1]
    raw = memoryview(data)[ends[0] : ends[-1]] if data is not None and n else b""
    try:
        points = np.frombuffer(bytes(raw).decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # bytes that are no UTF-8: each row on its own, bad bytes become U+FFFD
        rows = [bytes(raw[a - ends[0] : b - ends[0]]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
        points = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        return points, np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
    starts = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    count = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(starts, out=count[1:])
    return points, count[ends - ends[0]]


def encode(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The string column of code points and row offsets; rows where ``valid`` is false become null."""
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    size = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF), out=size[1:])
    at = size[offsets]
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    if at[-1] < 2**31 - 1:
        return pa.Array.from_buffers(pa.string(), len(offsets) - 1, [mask, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [mask, pa.py_buffer(at), pa.py_buffer(data)])


def keep(points: np.ndarray, offsets: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the positions where ``stay`` is false."""
    count = np.zeros(len(points) + 1, np.int64)
    np.cumsum(stay, out=count[1:])
    return points[stay], count[offsets]


def expand(points: np.ndarray, offsets: np.ndarray, at: np.ndarray, into: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every position ``at[i]`` replaced by the code points ``into[i]``."""
    width = np.ones(len(points), np.int64)
    width[at] = [len(x) for x in into]
    start = np.zeros(len(points) + 1, np.int64)
    np.cumsum(width, out=start[1:])
    out = np.repeat(points, width)
    if len(at):
        size = width[at]
        first = np.repeat(start[at], size)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out[first + step] = np.concatenate(into)
    return out, start[offsets]


# ---- tables ---------------------------------------------------------------------------------------------------------


def _assigned():
    """Planes 0 to 3 and 14: all assigned characters but those for private use."""
    return (i for i in itertools.chain(range(0xD800), range(0xE000, 0x40000), range(0xE0000, 0xE1000)))


@cache
def shape_table() -> tuple[np.ndarray, np.ndarray]:
    """What one character becomes by itself (full width, spaces, look-alikes), and which are dropped."""
    to = np.arange(TOP, dtype=np.uint32)
    gone = np.zeros(TOP, bool)
    gone[INVISIBLE] = True
    for i in range(0xFF00, 0xFFF0):
        if unicodedata.decomposition(chr(i)).startswith("<wide>"):
            to[i] = ord(unicodedata.normalize("NFKC", chr(i))[0])
    for i in range(0x80, 0x3001):
        if unicodedata.category(chr(i)) == "Zs":
            to[i] = 0x20
    for a, b in LOOKALIKES.items():
        to[ord(a)] = ord(b)
    for i in [*range(0x370, 0x530), *range(0x1F00, 0x2000)]:  # accented look-alikes: the Latin letter with that accent
        parts = unicodedata.normalize("NFD", chr(i))
        if len(parts) > 1 and parts[0] in LOOKALIKES:
            whole = unicodedata.normalize("NFC", LOOKALIKES[parts[0]] + parts[1:])
            if len(whole) == 1:
                to[i] = ord(whole)
    return to, gone


@cache
def mark_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Combining classes; which characters can attach to the one before; which never stay as they are; which split
    when a mark follows; composable pairs ``first << 21 | second``, sorted, and what they make."""
    ccc, joins = np.zeros(TOP, np.uint8), np.zeros(TOP, bool)
    never, splits = np.zeros(TOP, bool), np.zeros(TOP, bool)
    pairs: dict[int, int] = {}
    for i in _assigned():
        c = chr(i)
        ccc[i] = unicodedata.combining(c)
        way = unicodedata.decomposition(c)
        if way and way[0] != "<":
            splits[i] = True
            if unicodedata.normalize("NFC", c) != c:
                never[i] = True
            elif len(parts := way.split()) == 2:
                pairs[int(parts[0], 16) << 21 | int(parts[1], 16)] = i
    for lead in range(19):  # Hangul syllables compose by arithmetic
        for vowel in range(21):
            lv = 0xAC00 + (lead * 21 + vowel) * 28
            pairs[(0x1100 + lead) << 21 | (0x1161 + vowel)] = lv
            for tail in range(1, 28):
                pairs[lv << 21 | (0x11A7 + tail)] = lv + tail
    splits[0xAC00:0xD7A4] = True
    joins[ccc > 0] = True
    joins[[k & 0x1FFFFF for k in pairs]] = True
    key = np.array(sorted(pairs), np.int64)
    return ccc, joins, never, splits, key, np.array([pairs[k] for k in key.tolist()], np.uint32)


@cache
def word_table() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case form of every character (of those with a form of one character), and which are letters or digits."""
    lower, word = np.arange(TOP, dtype=np.uint32), np.zeros(TOP, bool)
    for i in _assigned():
        c = chr(i)
        if c.isalnum():
            word[i] = True
            x = c.lower()
            if x != c:
                lower[i] = ord(x) if len(x) == 1 else ord(x[0])
    return lower, word


# ---- P6 form --------------------------------------------------------------------------------------------------------


def compose(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Canonical composition (NFC) of every row, done on the runs of characters that attach to the one before."""
    ccc, joins, never, splits, key, made = mark_tables()
    hit = joins[points] | never[points]
    if not hit.any():
        return points, offsets
    # what is not canonical goes apart first, and so does the base under a run of marks
    base = np.zeros(len(points), bool)
    base[:-1] = joins[points[1:]]
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    base[ends - 1] = False
    at = np.flatnonzero(never[points] | (base & splits[points]))
    if len(at):
        kinds, which = np.unique(points[at], return_inverse=True)
        apart = [np.array([ord(x) for x in unicodedata.normalize("NFD", chr(c))], np.uint32) for c in kinds.tolist()]
        points, offsets = expand(points, offsets, at, [apart[k] for k in which.tolist()])
    else:
        points = points.copy()
    attach = joins[points]
    first = np.zeros(len(points), bool)
    first[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    # marks of one run in canonical order
    rank = ccc[points]
    after = np.flatnonzero((rank[1:] > 0) & (rank[1:] < rank[:-1]) & ~first[1:])
    if len(after):
        group = np.cumsum((rank == 0) | first)
        mine = np.flatnonzero(np.isin(group, group[after + 1]) & (rank > 0))
        order = np.lexsort((mine, rank[mine], group[mine]))
        points[mine] = points[mine[order]]
        rank = ccc[points]
    # runs: a base and what may attach to it; round k looks at the k-th of each run
    run = attach & ~first
    start = np.flatnonzero(run & ~np.concatenate([[False], run[:-1]]))
    if not len(start):
        return points, offsets
    stop = np.flatnonzero(run & ~np.concatenate([run[1:], [False]])) + 1
    head, last, stay = start - 1, np.zeros(len(start), np.int64), np.ones(len(points), bool)
    last[:] = -1  # nothing stands between the head and the next mark
    k, live = 0, np.arange(len(start))
    while len(live):
        at = start[live] + k
        pair = points[head[live]].astype(np.int64) << 21 | points[at]
        where = np.minimum(np.searchsorted(key, pair), len(key) - 1)
        rk = rank[at].astype(np.int64)
        free = (last[live] == -1) | ((last[live] < rk) & (rk > 0) & (last[live] > 0))
        joined = (key[where] == pair) & free
        points[head[live[joined]]] = made[where[joined]]
        stay[at[joined]] = False
        alone = ~joined
        anew = alone & (rk == 0)  # an attachable without class that found no partner is the next base
        head[live[anew]], last[live[anew]] = at[anew], -1
        marks = alone & (rk > 0)
        last[live[marks]] = rk[marks]
        k += 1
        live = live[start[live] + k < stop[live]]
    return keep(points, offsets, stay)


def visual_form(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The form in which texts that look the same are the same: plain widths and spaces, nothing invisible,
    look-alike letters Latin, accents composed. Case, punctuation, tabs and line breaks stay."""
    if not len(points) or points.max() < 0x80:
        return points, offsets
    to, gone = shape_table()
    drop = gone[points]
    if drop.any():
        points, offsets = keep(points, offsets, ~drop)
    return compose(to[points], offsets)


# ---- words ----------------------------------------------------------------------------------------------------------

#: Words of more characters are hashed one by one.
LONG_WORD = 200
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, mod 2^64."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for k, b in ((0, _BASE), (1, inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(points: np.ndarray) -> np.ndarray:
    """``H[i]``: polynomial hash of the first ``i`` code points, so that any span's hash is a difference."""
    h = np.zeros(len(points) + 1, np.uint64)
    up, _ = powers(len(points) + 1)
    np.cumsum((points.astype(np.uint64) + np.uint64(0x1F123BB5)) * up[:-1], out=h[1:], dtype=np.uint64)
    return h


def span_hash(h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = powers(len(h))
    return mix((h[stop] - h[start]) * down[start] + (stop - start).astype(np.uint64))


def words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words (runs of letters and digits) and the rows' offsets into them."""
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lower, word = word_table()
    inside = word[points]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(points))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    low = lower[points]
    h = span_hash(prefix_hash(low), start, stop)
    # a polynomial mod 2^64 is blind to some differences of a thousand characters and more: long words get another hash
    for i in np.flatnonzero(stop - start > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(low[start[i] : stop[i]].tobytes(), digest_size=8).digest(), "little")
    return h, np.searchsorted(start, offsets)


def runs_of(word: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words that lie in one row, the row of each and the position of its first word."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(3) + word[i : i + n])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:n] == row[k - 1 :]
    at = np.flatnonzero(inside)
    return h[at], row[at], at
