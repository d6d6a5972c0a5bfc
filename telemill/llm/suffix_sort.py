"""Suffix sort of byte strings by hashes, many small groups of suffixes at a time.

A suffix is a place in a buffer and how many bytes it may reach from there (to
the right, or to the left).  Two suffixes are compared by their longest common
extension: polynomial hashes of all prefixes of the buffer give the hash of any
run of bytes, so the extension is found by binary search in as many steps as its
length has bits, and the next byte decides.  Groups are sorted by merging runs
of doubling width; one level of the merge is done for all groups at once.  The
extensions of neighbours are at last compared byte by byte.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Buffer:
    """Bytes with the hashes of all their prefixes."""

    def __init__(self, data: np.ndarray):
        self.data, n = data, len(data)
        self.back = _powers(pow(_BASE, -1, 1 << 64), n + 1)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n + 1)[:n], out=self.total[1:])

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` bytes from ``a`` and from ``b`` have one hash."""
        return (self.total[a + size] - self.total[a]) * self.back[a] == (self.total[b + size] - self.total[b]) * self.back[b]

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, left: bool = False, exact: bool = False) -> np.ndarray:
        """Bytes, ``most`` at most, that run alike from ``a`` and ``b`` on (to the left: that end there)."""
        if exact:
            return self._by_bytes(a, b, most, left)
        low, high = np.zeros(len(a), dtype=np.int64), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) >> 1
            equal = self.same(a - mid, b - mid, mid) if left else self.same(a, b, mid)
            low = np.where(open_ & equal, mid, low)
            high = np.where(open_ & ~equal, mid - 1, high)
        return low

    def _by_bytes(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, left: bool) -> np.ndarray:
        out, alive = np.zeros(len(a), dtype=np.int64), np.flatnonzero(most > 0)
        while len(alive):
            step = -out[alive] - 1 if left else out[alive]
            alive = alive[self.data[a[alive] + step] == self.data[b[alive] + step]]
            out[alive] += 1
            alive = alive[out[alive] < most[alive]]
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` bytes from ``a`` and ``b`` are the same, byte by byte."""
        ends = np.cumsum(size)
        step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        wrong = self.data[np.repeat(a, size) + step] != self.data[np.repeat(b, size) + step]
        out = np.ones(len(a), dtype=bool)
        out[np.repeat(np.arange(len(a)), size)[wrong]] = False
        return out


def _below(text: Buffer, x: np.ndarray, y: np.ndarray, at: np.ndarray, reach: np.ndarray, left: bool, exact: bool) -> np.ndarray:
    """Whether suffix ``x`` stands before suffix ``y`` (indices into ``at``; equal ones stand by index)."""
    most = np.minimum(reach[x], reach[y])
    same = text.extension(at[x], at[y], most, left, exact)
    whole = same == most
    step = np.where(whole, 0, -same - 1 if left else same)
    last = len(text.data) - 1
    by_byte = text.data[np.minimum(at[x] + step, last)] < text.data[np.minimum(at[y] + step, last)]
    by_size = (reach[x] < reach[y]) | ((reach[x] == reach[y]) & (x < y))
    return np.where(whole, by_size, by_byte)


def sort_groups(text: Buffer, at: np.ndarray, reach: np.ndarray, bounds: np.ndarray, left: bool = False, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): suffixes sorted inside each group ``bounds[i]:bounds[i + 1]``, and how many bytes each shares with the one before it (0 for a group's first).

    ``exact`` compares bytes instead of hashes; it is taken by itself where a hash has lied.
    """
    n = len(at)
    order, first = np.arange(n), np.repeat(bounds[:-1], np.diff(bounds))
    end = np.repeat(bounds[1:], np.diff(bounds))
    width = 1
    while width < np.diff(bounds).max(initial=0):
        run = first + (np.arange(n) - first) // (2 * width) * (2 * width)  # where the pair of runs of each place begins
        middle, stop = np.minimum(run + width, end), np.minimum(run + 2 * width, end)
        some = np.flatnonzero(middle < stop)
        right = some >= middle[some]
        low, high = np.where(right, run[some], middle[some]), np.where(right, middle[some], stop[some])
        begin = low.copy()
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            before = _below(text, order[mid], order[some[open_]], at, reach, left, exact)
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        place = some + (low - begin) - np.where(right, middle[some] - run[some], 0)
        merged = order.copy()
        merged[place] = order[some]
        order = merged
        width *= 2
    common = np.zeros(n, dtype=np.int64)
    later = np.flatnonzero(np.arange(n) != first)
    a, b = order[later - 1], order[later]
    common[later] = same = text.extension(at[a], at[b], np.minimum(reach[a], reach[b]), left, exact)
    shift = same if left else 0
    if not exact and not text.equal(at[a] - shift, at[b] - shift, same).all():
        return sort_groups(text, at, reach, bounds, left, exact=True)
    return order, common
