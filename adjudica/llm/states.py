"""What a ``suite.state`` says, apart from how it is written down.

A state that parses as a JSON object is that object; anything else (arrays, numbers, cut-off JSON) is plain text.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

from . import codepoints as cp


def parse_object(state: str | None) -> dict | None:
    """The object, or None. A key given twice has its last value."""
    if not state or state.lstrip(" \t\r\n")[:1] != "{":
        return None
    try:
        found = json.loads(state)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def leaves(value, path: str = "") -> Iterator[tuple[str, object]]:
    """(path, scalar) at every level; list members have their padded index as a path step. Empty objects and lists
    count as one leaf each."""
    todo = [(path, value)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict) and value:
            todo += [(f"{path}.{k}" if path else k, v) for k, v in value.items()]
        elif isinstance(value, list) and value:
            todo += [(f"{path}.{i:09d}", v) for i, v in enumerate(value)]
        else:
            yield path, value


def scalar(value) -> str:
    """A JSON scalar other than a string as text; equal numbers give equal text."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        value = int(value)
    return json.dumps(value)


def sound(text: str) -> str:
    """Half surrogates (escapes in JSON can make them) as U+FFFD."""
    return text if text.isascii() else text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def texts(states: pa.Array) -> pa.Array:
    """For each state its text: itself, or an object's values ordered by lower-cased path, joined by a space."""
    rows = states.to_pylist()
    for i, state in enumerate(rows):
        if (found := parse_object(state)) is not None:
            values = sorted(((p.lower(), k, v) for k, (p, v) in enumerate(leaves(found))), key=lambda x: (x[0], -x[1]))
            rows[i] = sound(" ".join(v if isinstance(v, str) else "" if v in ({}, []) else scalar(v) for _, _, v in values))
    return pa.array(rows, pa.string())


@cache
def _folds() -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Dropped characters (white space, punctuation), one-to-one case folding, and foldings to several characters."""
    drop, to, wide = np.zeros(cp.TOP, bool), np.arange(cp.TOP, dtype=np.uint32), {}
    for i in cp._assigned():
        c = chr(i)
        if c.isspace() or unicodedata.category(c)[0] == "P":
            drop[i] = True
        elif (x := c.casefold()) != c:
            to[i] = ord(x[0])
            if len(x) > 1:
                wide[i] = np.array([ord(k) for k in x], np.uint32)
    return drop, to, wide


def bare(column: pa.Array) -> pa.Array:
    """Without white space and punctuation, case folded."""
    drop, to, wide = _folds()
    points, offsets = cp.decode(column)
    points, offsets = cp.keep(points, offsets, ~drop[points])
    many = np.zeros(cp.TOP, bool)
    many[list(wide)] = True
    at = np.flatnonzero(many[points])
    folded = to[points]
    if len(at):
        folded, offsets = cp.expand(folded, offsets, at, [wide[x] for x in points[at].tolist()])
    return cp.encode(folded, offsets)


def canonical(states: pa.Array) -> pa.Array:
    """The key under which states that differ only in formatting are equal; null where nothing is left.

    Text: bare text. Object: the sorted set of (folded path, bare value); numbers, booleans and null keep their type.
    """
    rows = states.to_pylist()
    objects: dict[int, list[tuple[str, object]]] = {}
    for i, state in enumerate(rows):
        if (found := parse_object(state)) is not None:
            objects[i], rows[i] = list(leaves(found)), None
    strings = [sound(v) for x in objects.values() for _, v in x if isinstance(v, str)]
    said = iter(bare(pa.array(strings, pa.string())).to_pylist())
    out = bare(pa.array(rows, pa.string())).to_pylist()
    for i, found in objects.items():
        pairs, some = set(), False
        for path, v in found:
            value = next(said) if isinstance(v, str) else "\x1c" + scalar(v)
            some |= bool(value) and v not in ({}, [])
            pairs.add(f"{sound(path).casefold()}\x1f{value}")
        out[i] = "\x1d" + "\x1e".join(sorted(pairs)) if some else None
    return pa.array([x or None for x in out], pa.string())
