"""Suffix automaton of several texts, with the owners of every substring (for matching statistics against other texts)."""

from __future__ import annotations


class SuffixAutomaton:
    """Online construction (Blumer et al. 1985) over texts added one after another, of owners numbered from 0. State ``v`` stands for the substrings
    of one set of end positions, the longest of ``size[v]`` characters; ``link[v]`` for the next shorter ones."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.least: list[int] = [1 << 62]
        self.most: list[int] = [-1]

    def _state(self, size: int, next_: dict[str, int], link: int) -> int:
        self.next.append(next_)
        self.size.append(size)
        self.link.append(link)
        self.least.append(1 << 62)
        self.most.append(-1)
        return len(self.size) - 1

    def _split(self, p: int, c: str) -> int:
        """The state of exactly the longest string of ``p`` followed by ``c``."""
        q = self.next[p][c]
        if self.size[p] + 1 == self.size[q]:
            return q
        clone = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, text: str, owner: int) -> list[int]:
        """Adds a text; returns the state of each of its prefixes."""
        last, states = 0, []
        for c in text:
            if c in self.next[last]:
                last = self._split(last, c)
            else:
                new, p = self._state(self.size[last] + 1, {}, 0), last
                while p != -1 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p != -1:
                    self.link[new] = self._split(p, c)
                last = new
            states.append(last)
            if owner < self.least[last]:
                self.least[last] = owner
            if owner > self.most[last]:
                self.most[last] = owner
        return states

    def shared_sizes(self) -> list[int]:
        """Per state, the length of its longest suffix that two owners have: read at the states of a text's prefixes, the
        matching statistics of that text against all texts of other owners."""
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for v in reversed(order):  # an occurrence of a string is one of its suffixes too
            u = self.link[v]
            if self.least[v] < self.least[u]:
                self.least[u] = self.least[v]
            if self.most[v] > self.most[u]:
                self.most[u] = self.most[v]
        out = [0] * len(self.size)
        for v in order:
            out[v] = self.size[v] if self.least[v] != self.most[v] else out[self.link[v]]
        return out


def shared_spans(texts: list[str], owners: list, length: int) -> list[list[tuple[int, int]]]:
    """For each text its maximal spans (start, stop) of at least ``length`` characters that a text of another owner has,
    overlapping ones merged. Owners are any hashable values."""
    automaton, number = SuffixAutomaton(), {}
    states = [automaton.add(t, number.setdefault(o, len(number))) for t, o in zip(texts, owners)]
    longest = automaton.shared_sizes()
    out = []
    for at in states:
        spans: list[tuple[int, int]] = []
        for stop, v in enumerate(at, 1):
            n = longest[v]
            if n >= length:
                start = stop - n
                if spans and start <= spans[-1][1]:
                    spans[-1] = (min(start, spans[-1][0]), stop)
                else:
                    spans.append((start, stop))
        out.append(spans)
    return out
