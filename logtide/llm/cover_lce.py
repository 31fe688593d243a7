"""Longest common extensions from a difference cover: only sampled suffixes are sorted.

A difference cover D of v has, for any two positions, a shift below v that takes both to sampled positions (those that
are in D modulo v).  The sampled suffixes are sorted by their first v words and then by doubling, and the lengths of
their neighbours' common prefixes go into a sparse table of range minima.  A query compares the few words before the
synchronised samples, and one range minimum answers the rest.
"""

from __future__ import annotations

import numpy as np

#: Perfect difference covers (every difference but 0 occurs once) by their modulus.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 31: (1, 5, 11, 24, 25, 27)}


class CoverLCE:
    """Queries on ``words`` (numbers from 0), whose last word must be different from all others."""

    def __init__(self, words: np.ndarray, v: int = 31):
        n, self.v, self.cover = len(words), v, np.array(COVERS[v])
        # Words past the end are all different, so that no two extensions are equal up to there.
        self.words = np.concatenate([words.astype(np.int64), int(words.max(initial=0)) + 1 + np.arange(2 * v)])
        residues = np.arange(v)
        sampled = np.isin(residues, self.cover)
        at = (residues[:, None] + residues[None, :]) % v
        self.shift = np.argmax(sampled[at][:, None, :] & sampled[at][None, :, :], axis=2)
        self.place = np.full(v, -1)
        self.place[self.cover] = np.arange(len(self.cover))
        k = np.arange(-(-n // v) * len(self.cover))
        at = v * (k // len(self.cover)) + self.cover[k % len(self.cover)]
        self.at = at[at < n]
        self._sort()

    def _sort(self) -> None:
        """Rank the sampled suffixes, and the common prefixes of neighbours."""
        v, step, at, m = self.v, len(self.cover), self.at, len(self.at)
        width = int(self.words.max()).bit_length()
        per = 63 // width
        keys = []
        for first in range(0, v, per):
            key = np.zeros(m, np.int64)
            for t in range(first, min(v, first + per)):
                key = (key << width) | self.words[at + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        differ = np.zeros(m, bool)
        for key in keys:
            differ[1:] |= np.diff(key[order]) != 0
        rank = np.empty(m, np.int64)
        rank[order] = np.cumsum(differ)
        levels, jump = [rank], step
        # A sample's successor in its residue class is ``step`` samples on.
        while m and int(rank.max()) + 1 < m:
            after = np.full(m, -1, np.int64)
            after[: max(0, m - jump)] = rank[jump:]
            key = rank * (m + 1) + after + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(m, np.int64)
            rank[order] = np.cumsum(np.append(0, np.diff(key[order]) != 0))
            levels.append(rank)
            jump *= 2
        self.rank = rank
        a, b = order[:-1], order[1:]
        moved, equal = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + moved, b + moved
            inside = np.flatnonzero(np.maximum(x, y) < m)
            same = inside[levels[k][x[inside]] == levels[k][y[inside]]]
            moved[same] += step << k
            equal[same] += v << k
        equal += self._direct(at[a] + equal, at[b] + equal, np.full(len(a), v))
        self.table = [equal]
        while len(self.table[-1]) > 1 << (len(self.table) - 1):
            half, last = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j`` on, ``most`` of them at most, compared one by one."""
        out, alive = np.zeros(len(i), np.int64), np.arange(len(i))
        for t in range(int(most.max(initial=0))):
            alive = alive[most[alive] > t]
            alive = alive[self.words[i[alive] + t] == self.words[j[alive] + t]]
            out[alive] += 1
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Numbers of equal words from positions ``i`` and ``j`` (``i`` < ``j``) on."""
        shift = self.shift[i % self.v, j % self.v]
        out = self._direct(i, j, shift)
        go = np.flatnonzero(out == shift)
        x, y = i[go] + shift[go], j[go] + shift[go]
        samples = [len(self.cover) * (p // self.v) + self.place[p % self.v] for p in (x, y)]
        a, b = self.rank[samples[0]], self.rank[samples[1]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        best = np.empty(len(go), np.int64)
        for k in np.unique(level):
            here = np.flatnonzero(level == k)
            best[here] = np.minimum(self.table[k][low[here]], self.table[k][high[here] - (1 << k)])
        out[go] += best
        return out
