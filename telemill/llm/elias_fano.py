"""An n-gram trie of Elias-Fano coded levels that are searched as they are coded."""

from __future__ import annotations

import mmap

import numpy as np

STEP = 4096  # codes per power of ten of a quantised probability


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities, rounded down: 0 is none, k stands for 10 ** (-(k - 1) / STEP)."""
    with np.errstate(divide="ignore"):
        code = np.ceil(-np.log10(p) * STEP - 1e-9) + 1
    return np.where(p > 0, np.clip(code, 1, 65535), 0).astype(np.uint16)


_RESTORED = np.concatenate([[0.0], 10.0 ** (-np.arange(65535) / STEP)])


def restored(code: np.ndarray) -> np.ndarray:
    return _RESTORED[code]


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, one after the other from the least bit on, and room for a read past the end."""
    out = np.zeros((-(-len(values) // 8), width), dtype=np.uint8)
    eight = np.zeros(8 * len(out), dtype=np.uint64)
    eight[: len(values)] = values
    eight = eight.reshape(-1, 8)
    for k in range(8 if width else 0):
        first, shift = divmod(k * width, 8)
        x = eight[:, k] << np.uint64(shift)
        for b in range((shift + width + 7) // 8):
            out[:, first + b] |= (x >> np.uint64(8 * b)).astype(np.uint8)
    return np.concatenate([out.reshape(-1), np.zeros(8, dtype=np.uint8)])


def encode(values: np.ndarray) -> np.ndarray:
    """A sequence of non-negative numbers that never falls, as bytes: its size, low bits packed, high parts in unary."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    high = (values >> low).astype(np.int64)
    size = n + (int(high[-1]) if n else 0) + 1
    ones = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
    ones[high + np.arange(n)] = 1
    lows = _packed(values & ((1 << low) - 1), low)
    lows = np.concatenate([lows, np.zeros(-len(lows) % 8, dtype=np.uint8)])
    head = np.array([n, low, len(lows), len(ones) // 8], dtype=np.int64)
    return np.concatenate([head.view(np.uint8), lows, np.packbits(ones, bitorder="little")])


def _select(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) in each word."""
    words, k, at = words.copy(), k.astype(np.int64), np.zeros(len(words), dtype=np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        here = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
        up = k >= here
        k -= np.where(up, here, 0)
        at += np.where(up, half, 0)
        words >>= np.where(up, half, 0).astype(np.uint64)
    return at


class Sequence:
    """A coded sequence; beside the code it keeps one number for each 64 bits of the unary part."""

    def __init__(self, raw: np.ndarray):
        self.n, self.low, lows, bits = (int(x) for x in raw[:32].view(np.int64))
        self.end = 32 + lows + bits
        # a word at every byte, so that the low bits of any element are inside one
        self._lows = np.ndarray((lows - 7,), dtype="<u8", buffer=raw.data, offset=32, strides=(1,))
        self._words = raw[32 + lows : self.end].view("<u8")
        self._ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self._words), dtype=np.int64)])
        self.top = int(self._ones[-1] and self._last() - self.n + 1)  # the greatest high part
        self._zeros = 64 * np.arange(len(self._ones), dtype=np.int64) - self._ones

    def _last(self) -> int:
        """Place of the last one of the unary part."""
        word = int(np.flatnonzero(self._words)[-1])
        return 64 * word + int(self._words[word]).bit_length() - 1

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.low
        return (self._lows[at >> 3] >> (at & 7).astype(np.uint64)).astype(np.int64) & ((1 << self.low) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self._ones, i, side="right") - 1
        place = 64 * word + _select(self._words[word], i - self._ones[word])
        return (place - i) << self.low | self._low(i)

    def _bucket_end(self, high: np.ndarray) -> np.ndarray:
        """How many elements have at most this high part: the ones before the zero that ends it."""
        word = np.searchsorted(self._zeros, high, side="right") - 1
        return 64 * word + _select(~self._words[word], high - self._zeros[word]) - high

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where the first element of at least x stands, n: nowhere; whether it is x)."""
        high, low = x >> self.low, x & ((1 << self.low) - 1)
        at, same = np.full(len(x), self.n, dtype=np.int64), np.zeros(len(x), dtype=bool)
        if not self.n:
            return at, same
        known = np.flatnonzero(high <= self.top)
        h = high[known]
        stop = self._bucket_end(h)
        first = np.zeros(len(h), dtype=np.int64)
        first[h > 0] = self._bucket_end(h[h > 0] - 1)
        # among the elements of the high part, by halves over their low bits
        a, b, open_, want = first, stop.copy(), np.flatnonzero(first < stop), low[known]
        while len(open_):
            middle = (a[open_] + b[open_]) >> 1
            less = self._low(middle) < want[open_]
            a[open_[less]] = middle[less] + 1
            b[open_[~less]] = middle[~less]
            open_ = open_[a[open_] < b[open_]]
        at[known] = a
        inside = np.flatnonzero(a < stop)
        same[known[inside]] = self._low(a[inside]) == want[inside]
        return at, same


class Trie:
    """Levels of word ids; each node's children follow each other and are searched relative to it.

    A level has two sequences: for every node of the level above where its
    children begin, and for every child its word id plus its parent's base,
    which is one more than the last element of the parent before.  The levels
    stand in a memory map without a file; nothing of them is decoded whole.
    """

    def __init__(self, keys: np.ndarray):
        """keys: (n, depth) word ids, sorted and distinct."""
        n, depth = keys.shape
        parts: list[np.ndarray] = []
        parent, parents = np.zeros(n, dtype=np.int64), 1  # of each row, its node one level up
        for j in range(depth):
            new = np.ones(n, dtype=bool)
            new[1:] = (parent[1:] != parent[:-1]) | (keys[1:, j] != keys[:-1, j])
            first = np.flatnonzero(new)
            ids, up = keys[first, j].astype(np.int64), parent[first]
            starts = np.searchsorted(up, np.arange(parents + 1))
            last = np.zeros(parents, dtype=np.int64)
            full = starts[1:] > starts[:-1]
            last[full] = ids[starts[1:][full] - 1] + 1
            base = np.concatenate([[0], np.cumsum(last)[:-1]])
            parts += [encode(starts), encode(ids + base[up])]
            parent, parents = np.cumsum(new) - 1, len(first)
        self._map = mmap.mmap(-1, sum(map(len, parts)))
        raw, at = np.frombuffer(self._map, dtype=np.uint8), 0
        self.ids, self.pointers = [], []
        for k, part in enumerate(parts):
            raw[at : at + len(part)] = part
            (self.pointers, self.ids)[k % 2].append(Sequence(raw[at : at + len(part)]))
            at += len(part)

    def base(self, level: int, node: np.ndarray) -> np.ndarray:
        """What a node of the level above adds to the ids of its children."""
        ids = self.ids[level]
        begin = self.pointers[level].access(node)
        return np.where(begin > 0, ids.access(np.maximum(begin - 1, 0)) + 1, 0) if ids.n else np.zeros(len(node), dtype=np.int64)

    def child(self, level: int, base: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The child with this word of the node whose base is given, -1 for none.

        An id beyond the node's last one may be found with a later node: see :meth:`find`.
        """
        at, same = self.ids[level].successor(base + word)
        return np.where(same, at, -1)

    def find(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row of word ids the (base, begin, end) of its children; a context that is not there has none."""
        node = np.zeros(len(contexts), dtype=np.int64)
        for j in range(contexts.shape[1] + 1):
            known = np.flatnonzero(node >= 0)
            base, begin, end = (np.zeros(len(node), dtype=np.int64) for _ in range(3))
            base[known], begin[known], end[known] = self.base(j, node[known]), self.pointers[j].access(node[known]), self.pointers[j].access(node[known] + 1)
            if j == contexts.shape[1]:
                return base, begin, end
            at = self.child(j, base[known], contexts[known, j].astype(np.int64))
            node[known] = np.where((at >= begin[known]) & (at < end[known]), at, -1)
        raise AssertionError
