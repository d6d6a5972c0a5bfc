"""BagMinHash signatures of multisets of word shingles, in numpy.

A shingle d with weight w (how often it occurs) owns a Poisson process over time
and the weight axis (0, w].  The axis is discretised at the powers of two: each
interval (0, 1], (1, 2], (2, 4], ... has a process of its own, of a rate in
proportion to its size and seeded by the shingle and the interval alone; a point
in an interval that w only partly covers draws a place in it and counts if that
place is within w.  A point picks a component of the signature, and each
component keeps its earliest point.  Two multisets agree in a component with a
probability of their weighted Jaccard similarity, sum(min) / sum(max).
"""

from __future__ import annotations

import numpy as np

from telemill.llm.text import Words, mix, window_hashes, words_of

SHINGLE = 5
BANDS, ROWS = 21, 6
SIZE = BANDS * ROWS
_GOLD = 0x9E3779B97F4A7C15


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, where each text's begin): runs of ``size`` words; a text of fewer words, but not none, is one shingle."""
    n = words.counts()
    short = (n > 0) & (n < size)
    counts = np.where(short, 1, np.maximum(n - size + 1, 0))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(int(bounds[-1]), dtype=np.uint64)
    every = window_hashes(words.hashes, size)
    full = np.flatnonzero(n >= size)
    if len(full):
        at = np.arange(int(counts[full].sum())) - np.repeat(np.cumsum(counts[full]) - counts[full], counts[full])
        out[np.repeat(bounds[full], counts[full]) + at] = every[np.repeat(words.bounds[full], counts[full]) + at]
    for t in np.flatnonzero(short):
        out[bounds[t]] = window_hashes(words.hashes[words.bounds[t] : words.bounds[t + 1]], int(n[t]))[0]
    return out, bounds


def weighted(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of each distinct shingle of each text, sorted."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return t[at], h[at], np.diff(np.append(at, len(h)))


def _stream(k: int) -> np.uint64:
    """The k-th of a row of well-spread seeds."""
    return np.uint64(_GOLD * k & (1 << 64) - 1)


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, size: int = SIZE) -> np.ndarray:
    """(n_texts, size) earliest times; a text without shingles has infinity everywhere."""
    out = np.full(n_texts * size, np.inf)
    total = np.bincount(text, weight, n_texts)
    left, slack = np.flatnonzero(total > 0), 4.0
    while len(left):
        wanted = np.zeros(n_texts, dtype=bool)
        wanted[left] = True
        limit = np.where(total > 0, (np.log(size) + slack) / np.maximum(total, 1), 0)
        _points(out, text, shingle, weight, wanted, limit, size)
        open_ = ~np.isfinite(out.reshape(n_texts, size)).all(axis=1) & wanted
        left, slack = np.flatnonzero(open_), slack * 2
    return out.reshape(n_texts, size)


def _points(out: np.ndarray, text, shingle, weight, wanted, limit, size: int) -> None:
    """Put every point up to its text's time limit into ``out``."""
    own = wanted[text]
    low, k = 0, 0
    while True:
        some = own & (weight > low)
        if not some.any():
            return
        high = max(1, 2 * low)
        rate = float(high - low) * size
        t, w = text[some], weight[some]
        seed = mix(shingle[some] + _stream(k + 1))
        until, x, r = limit[t], np.zeros(len(t)), 0
        while len(t):
            r += 1
            a = mix(seed + _stream(2 * r))
            x = x - np.log(_uniform(a)) / rate
            on = x <= until
            t, w, seed, until, x = t[on], w[on], seed[on], until[on], x[on]
            b = mix(seed + _stream(2 * r + 1))
            inside = low + 1 + ((b >> np.uint64(40)) % np.uint64(high - low)).astype(np.int64) <= w
            part = (b & np.uint64(0xFFFFFFFF)) % np.uint64(size)
            np.minimum.at(out, t[inside] * size + part[inside].astype(np.int64), x[inside])
        low, k = high, k + 1


def bands(signature: np.ndarray, n_bands: int = BANDS) -> np.ndarray:
    """(texts, n_bands) bucket keys: a hash of each band's rows and of the band's number."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), n_bands, -1)
    out = np.tile(np.array([_stream(k) for k in range(1, n_bands + 1)], dtype=np.uint64), (len(bits), 1))
    for k in range(bits.shape[2]):
        out = mix(out ^ bits[:, :, k]) * np.uint64(0x2545F4914F6CDD1D)
    return out.view(np.int64)


def overlaps(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of texts 0 and 1, 2 and 3, and so on."""
    hashes, bounds = shingles(words_of(data, offsets), size)
    n = len(bounds) // 2
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pair, side = text >> 1, text & 1
    order = np.lexsort((hashes, pair))
    h, p, s = hashes[order], pair[order], side[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    at = np.flatnonzero(new)
    if not len(at):
        return np.ones(n)
    b = np.add.reduceat(s, at)
    a = np.diff(np.append(at, len(h))) - b
    low, high = np.bincount(p[at], np.minimum(a, b), n), np.bincount(p[at], np.maximum(a, b), n)
    return np.where(high > 0, low / np.maximum(high, 1), 1.0)


def similar(docs: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float, columns: int = 1 << 14) -> list[tuple[int, int]]:
    """Pairs (i of left, j of right) of ``docs`` whose weighted Jaccard similarity is at least ``least``.

    docs: sorted shingle hashes with repeats.  Overlaps of all pairs come from
    products of dense blocks, one column for each copy of a shingle.
    """
    used = np.union1d(left, right)
    text = np.repeat(np.arange(len(used)), [len(docs[i]) for i in used])
    h = np.concatenate([docs[i] for i in used]) if len(used) else np.zeros(0, dtype=np.uint64)
    # the copies of a shingle in a text are columns of their own
    copy = np.arange(len(h)) - np.maximum.accumulate(np.where(np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]), np.arange(len(h)), 0)) if len(h) else np.zeros(0, dtype=np.int64)
    key = np.where(copy == 0, h, mix(h + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    distinct, column, often = np.unique(key, return_inverse=True, return_counts=True)
    shared = often[column] > 1
    text, column = text[shared], column[shared]
    place = np.cumsum(often > 1) - 1
    column = place[column]
    order = np.argsort(column, kind="stable")
    text, column = text[order], column[order]
    a, b = np.searchsorted(used, left), np.searchsorted(used, right)
    both = np.zeros((len(left), len(right)), dtype=np.float64)
    for i in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        x, y = np.searchsorted(column, [i, i + columns])
        block = np.zeros((len(used), columns), dtype=np.float32)
        block[text[x:y], column[x:y] - i] = 1
        both += block[a] @ block[b].T
    sizes = np.array([len(docs[i]) for i in used], dtype=np.float64)
    union = sizes[a][:, None] + sizes[b][None, :] - both
    i, j = np.nonzero(both >= least * union - 1e-9)
    return [(int(left[x]), int(right[y])) for x, y in zip(i, j) if left[x] != right[y]]
