"""Likeness of two texts by their matching blocks: the longest run of characters that both have, and so on to its left and right."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: Meeting characters of a pair whose runs are kept; beyond, the longest run is looked for row by row each time.
KEPT = 4_000_000
#: A text of so many characters or more has common ones, those over a hundredth of it, that begin no run.
COMMON_FROM = 200


def _anchors(b: str) -> dict[str, np.ndarray]:
    """The places in ``b`` of each character that may begin a run."""
    n = Counter(b)
    most = len(b) // 100 + 1 if len(b) >= COMMON_FROM else len(b)
    places = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    order = np.argsort(places, kind="stable")
    values, first = np.unique(places[order], return_index=True)
    return {chr(v): p for v, p in zip(values.tolist(), np.split(order, first[1:])) if n[chr(v)] <= most} if b else {}


class Runs:
    """All maximal runs along the diagonals, found once; a search clips them to its rectangle."""

    def __init__(self, a: str, index: dict[str, np.ndarray]):
        hits = [(i, index[c]) for i, c in enumerate(a) if c in index]
        i = np.repeat(np.array([h[0] for h in hits], np.int64), [len(h[1]) for h in hits])
        j = np.concatenate([h[1] for h in hits]) if hits else np.zeros(0, np.int64)
        order = np.lexsort((i, j - i))
        i, j = i[order], j[order]
        new = np.ones(len(i), bool)
        new[1:] = (j[1:] - i[1:] != j[:-1] - i[:-1]) | (i[1:] != i[:-1] + 1)
        first = np.flatnonzero(new)
        self.i, self.j, self.n = i[first], j[first], np.diff(np.append(first, len(i)))

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        low = np.maximum(np.maximum(alo - self.i, blo - self.j), 0)
        size = np.minimum(np.minimum(ahi - self.i, bhi - self.j), self.n) - low
        most = int(size.max(initial=0))
        if most <= 0:
            return alo, blo, 0
        at = np.flatnonzero(size == most)
        i, j = self.i[at] + low[at], self.j[at] + low[at]
        first = np.lexsort((j, i))[0]
        return int(i[first]), int(j[first]), most


class Rows:
    """The same search without runs in memory: row by row, with the lengths that end at each place of the row before."""

    def __init__(self, a: str, index: dict[str, np.ndarray], width: int):
        self.a, self.index = a, index
        self.length, self.row = np.zeros(width + 1, np.int64), np.full(width + 1, -2)

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        best, none = (alo, blo, 0), np.zeros(0, np.int64)
        self.row[:] = -2
        for i in range(alo, ahi):
            js = self.index.get(self.a[i], none)
            js = js[np.searchsorted(js, blo) : np.searchsorted(js, bhi)]
            if len(js):
                k = np.where((self.row[js] == i - 1) & (js > blo), self.length[js], 0) + 1
                self.length[js + 1], self.row[js + 1] = k, i
                at = int(np.argmax(k))
                if k[at] > best[2]:
                    best = i - int(k[at]) + 1, int(js[at]) - int(k[at]) + 1, int(k[at])
        return best


def matched(a: str, b: str, kept: int = KEPT) -> int:
    """Characters in the matching blocks of ``a`` and ``b``. Of equally long runs the first in ``a`` counts, then the first
    in ``b``; a run found by its anchors grows over common characters on both sides."""
    index = _anchors(b)
    n = Counter(a)
    meet = sum(n[c] * len(p) for c, p in index.items())
    find = (Runs(a, index) if meet <= kept else Rows(a, index, len(b))).longest
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        i, j, size = find(alo, ahi, blo, bhi)
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            if alo < i and blo < j:
                todo.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                todo.append((i + size, ahi, j + size, bhi))
    return total


def ratio(a: str | None, b: str | None) -> float:
    """Twice the matched characters over those of both, stripped and lower-cased; 1 for two empty texts."""
    a, b = (a or "").strip().lower(), (b or "").strip().lower()
    both = len(a) + len(b)
    return 1.0 if a == b else 2.0 * matched(a, b) / both
