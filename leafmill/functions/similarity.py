"""The ratio of `difflib.SequenceMatcher` over two texts, without its steps over all pairs of equal characters."""

from __future__ import annotations

import difflib

import numpy as np

#: Texts whose lengths have a product up to this are left to the standard library, which is quicker there.
SHORT = 60_000


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def common_start(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class Runs:
    """Two texts as the runs of their anchors: the characters of both that the library doesn't call popular in the second.

    The library's longest match is one of anchors, the first in `a`, then the first in `b`; only then it is drawn
    out over other equal characters on both sides, which are never anchors on one side alone.
    """

    def __init__(self, a: str, b: str) -> None:
        self.a, self.b = a, b
        x, y = codes(a), codes(b)
        kinds, counts = np.unique(y, return_counts=True)
        if len(y) >= 200:
            kinds = kinds[counts <= len(y) // 100 + 1]
        rare, there = (np.zeros(int(max(x.max(), y.max())) + 1, bool) for _ in range(2))
        rare[kinds], there[x] = True, True
        rare &= there
        self.p, self.q = np.flatnonzero(rare[x]), np.flatnonzero(rare[y])
        self.x, self.y = x[self.p], y[self.q]
        self.ranks: list[np.ndarray] = []

    def aligned(self, alo: int, ahi: int, blo: int, bhi: int, pl: int, pr: int, ql: int, qr: int) -> int | None:
        """The matched characters of two stretches whose runs are the same in the same order, else none.

        There the first of the longest runs always meets itself, so each run does, and what is left are the gaps
        between: from both of their ends inwards, at the end of all from the start alone.
        """
        if pr - pl != qr - ql or not np.array_equal(self.x[pl:pr], self.y[ql:qr]):
            return None
        if pl == pr:
            return common_start(self.a[alo:ahi], self.b[blo:bhi])
        p, q = self.p[pl:pr], self.q[ql:qr]
        breaks = np.flatnonzero(np.diff(p) != 1)
        if not np.array_equal(breaks, np.flatnonzero(np.diff(q) != 1)):
            return None
        a, b, total = self.a, self.b, pr - pl + common_start(self.a[p[-1] + 1 : ahi], self.b[q[-1] + 1 : bhi])
        for s, e, t, f in zip([alo, *(p[breaks] + 1).tolist()], [*p[:1].tolist(), *p[breaks + 1].tolist()], [blo, *(q[breaks] + 1).tolist()], [*q[:1].tolist(), *q[breaks + 1].tolist()]):
            g, h = a[s:e], b[t:f]
            total += len(g) if g == h else min(common_start(g, h) + common_start(g[::-1], h[::-1]), len(g), len(h))
        return total

    def keys(self, n: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts in lo to hi of stretches of n anchors in a row, and numbers that are equal where the stretches are."""
        if not self.ranks:
            at = np.concatenate([self.p, self.q + len(self.a) + 1])
            ends = np.append(np.flatnonzero(np.diff(at) != 1), len(at) - 1)
            self.left = ends[np.searchsorted(ends, np.arange(len(at)))] - np.arange(len(at)) + 1
            self.ranks = [np.unique(np.concatenate([self.x, self.y]), return_inverse=True)[1]]
        k = n.bit_length() - 1
        while len(self.ranks) <= k:
            half, last = 1 << len(self.ranks) - 1, self.ranks[-1]
            long = np.flatnonzero(self.left >= 2 * half)
            rank = np.zeros_like(last)
            rank[long] = np.unique(last[long] * len(last) + last[long + half], return_inverse=True)[1]
            self.ranks.append(rank)
        starts = lo + np.flatnonzero(self.left[lo : hi - n + 1] >= n) if hi - n >= lo else np.zeros(0, int)
        rank = self.ranks[k]
        return starts, rank[starts] * len(rank) + rank[starts + n - (1 << k)]

    def longest(self, pl: int, pr: int, ql: int, qr: int, most: int) -> tuple[int, int, int]:
        """The longest stretch of anchors that both have, of `most` at most, the first in a, then in b: the numbers of its anchors, and its length."""
        m, found, low, n, step = len(self.p), (0, 0, 0), 0, min(most, pr - pl, qr - ql), 1
        high = n + 1
        while low + 1 < high:
            i, ki = self.keys(n, pl, pr)
            j, kj = self.keys(n, m + ql, m + qr)
            shared = np.flatnonzero(np.isin(ki, kj)) if len(i) and len(j) else ()
            if len(shared):
                found, low = (int(i[shared[0]]), int(j[np.flatnonzero(kj == ki[shared[0]])[0]]) - m, n), n
            else:
                high = n
            if low:
                n = (low + high) // 2
            else:
                n, step = max(1, high - step), 2 * step
        return found

    def matched(self) -> int:
        """Characters of the blocks that the library finds."""
        a, b, p, q, total = self.a, self.b, self.p, self.q, 0
        todo = [(0, len(a), 0, len(b), 0, len(p), 0, len(q), len(a))]
        while todo:
            alo, ahi, blo, bhi, pl, pr, ql, qr, most = todo.pop()
            if (n := self.aligned(alo, ahi, blo, bhi, pl, pr, ql, qr)) is not None:
                total += n
                continue
            u, v, n = self.longest(pl, pr, ql, qr, most)
            if not n:
                total += common_start(a[alo:ahi], b[blo:bhi])
                continue
            i, j = int(p[u]), int(q[v])
            k, l, r = n, i - alo, j - blo
            s = 0
            while s < l and s < r and a[i - s - 1] == b[j - s - 1]:
                s += 1
            while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
                k += 1
            total += s + k
            if alo < i - s and blo < j - s:
                todo.append((alo, i - s, blo, j - s, pl, int(np.searchsorted(p, i - s)), ql, int(np.searchsorted(q, j - s)), n))
            if i + k < ahi and j + k < bhi:
                todo.append((i + k, ahi, j + k, bhi, int(np.searchsorted(p, i + k)), pr, int(np.searchsorted(q, j + k)), qr, n))
        return total


def ratio(a: str, b: str) -> float:
    """`difflib.SequenceMatcher(None, a, b).ratio()`."""
    if a == b:
        return 1.0
    if len(a) * len(b) <= SHORT:
        return difflib.SequenceMatcher(None, a, b).ratio()
    return 2.0 * Runs(a, b).matched() / (len(a) + len(b))
