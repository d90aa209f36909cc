"""Plain versions of the pN_found definitions, for small inputs."""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from itertools import combinations

from adjudica.llm.codepoints import INVISIBLE, LOOKALIKES


def parse(state):
    try:
        x = json.loads(state)
    except Exception:
        return None
    return x if isinstance(x, dict) else None


def walk(x, path=()):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from walk(v, (*path, k))
    elif isinstance(x, list):
        for k, v in enumerate(x):
            yield from walk(v, (*path, f"{k:09d}"))
    else:
        yield ".".join(path), x


def strip(s):
    return "".join(c for c in s if not c.isspace() and unicodedata.category(c)[0] != "P").casefold()


def canon(state):
    if state is None:
        return None
    x = parse(state)
    if x is None:
        return strip(state) or None
    pairs = frozenset((p.casefold(), strip(v) if isinstance(v, str) else ("n", json.dumps(v))) for p, v in walk(x))
    return pairs if any(v for _, v in pairs) else None


def p1(rows):
    g = defaultdict(set)
    for i, s in rows:
        if i is not None and (k := canon(s)) is not None:
            g[k].add(i)
    return {(min(v), x) for v in g.values() for x in v if x != min(v)}


def groups(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {(find(x), x) for x in list(parent) if find(x) != x}


def p2(clusters, matches):
    by = defaultdict(set)
    for i, c in clusters:
        if i is not None and c not in (None, "", "unclustered"):
            by[c].add(i)
    links = [(min(v), x) for v in by.values() for x in v] + [(a, b) for a, b in matches if a is not None and b is not None]
    return groups(links)


def form(s):
    out = []
    for c in s:
        if ord(c) in INVISIBLE:
            continue
        if 0xFF01 <= ord(c) <= 0xFF5E:
            c = chr(ord(c) - 0xFEE0)
        elif unicodedata.category(c) == "Zs":
            c = " "
        out.append(c)
    s = unicodedata.normalize("NFC", "".join(out))
    s = "".join(LOOKALIKES.get(c, c) for c in s)
    return unicodedata.normalize("NFC", s)


def p6(rows):
    g = defaultdict(set)
    for i, s in rows:
        if s is not None:
            g[form(s)].add((i, s))
    return {(min(a, b)[0], max(a, b)[0]) for v in g.values() for a, b in combinations(v, 2) if a[1] != b[1] and a[0] != b[0]}


def words(s):
    return re.findall(r"[^\W_]+", s.lower())


def text(state):
    x = parse(state)
    if x is None:
        return state
    return " ".join(str(v) if not isinstance(v, bool) and v is not None else json.dumps(v) for _, v in sorted(((p.lower(), v) for p, v in walk(x)), key=lambda y: y[0]))


def grams(state):
    if state is None:
        return None
    w = words(form(text(state)))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 8 else None


def similar(rows, least=0.7):
    """((a, id), (b, id)) of different ids with similarity of at least ``least``."""
    by, sets = defaultdict(list), {}
    for i, s in dict(rows).items():
        if (g := grams(s)) is not None:
            sets[i] = g
            for x in g:
                by[x].append(i)
    seen, out = set(), set()
    for v in by.values():
        for a, b in combinations(sorted(v), 2):
            if (a, b) not in seen:
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if both >= least * (len(sets[a]) + len(sets[b]) - both) - 1e-12:
                    out.add((a, b))
    return out


def p5(rows):
    split = {i: s for i, _, s in rows}
    return {(a, b) for a, b in similar([(i, t) for i, t, _ in rows]) if split[a] and split[b] and (split[a] == "train") != (split[b] == "train")}


def p7(rows):
    return groups(similar(rows))


def p9(docs, items, n=13):
    by = defaultdict(set)
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            by[tuple(w[k : k + n])].add(i)
    out = set()
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in by.get(tuple(w[k : k + n]), ())}
    return out


def p10(docs, n=400):
    owner = {}
    for d, t in docs:
        for k in range(len(t or "") - n + 1):
            h = hash(t[k : k + n])
            owner[h] = d if owner.get(h, d) == d else None
    out = set()
    for d, t in docs:
        covered, last = 0, -1
        for k in range(len(t or "") - n + 1):
            if owner[hash(t[k : k + n])] is None:
                covered += k + n - max(k, last)
                last = k + n
        if covered:
            out.add((d, covered))
    return out
