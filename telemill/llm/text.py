"""Vectorised tokenising of Arrow text columns, shared by the operators of this package.

All functions work on whole texts.  Bytes are UTF-8; a word is a maximal run of
bytes that ``word_bytes`` marks.  Words are named by a 64-bit hash of their
folded bytes (A-Z lower-cased), so equal words have equal hashes in every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_QINV = np.uint64(pow(int(_Q), -1, 1 << 64))
_STEP = 1 << 18  # bytes hashed at once, so that temporaries stay in cache

#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def byte_class(members) -> np.ndarray:
    """A 256-entry table that is True at ``members``."""
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: Digits, letters and every byte above 0x7F.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Everything but space, tab, newline, vertical tab, form feed and carriage return.
NONSPACE = ~byte_class([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every bit depends on all of them."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of an odd number modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.table = base, np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            size = max(n, _STEP + 1024)
            grown = np.full(size, self.base, dtype=np.uint64)
            grown[0] = 1
            self.table = np.multiply.accumulate(grown)
        return self.table[:n]


_RP, _RI, _QP, _QI = _Powers(_R), _Powers(_RINV), _Powers(_Q), _Powers(_QINV)


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if off is not None and len(column) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return raw[lo:hi], offsets - lo


@dataclass
class Words:
    """Words of a batch of texts: hash, byte range, and where each text's words begin."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # words of text i are bounds[i]:bounds[i + 1]
    prefixes: tuple[np.ndarray, ...] = ()  # for each size asked for, the hash of each word's first bytes

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def words_of(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray = ALNUM, prefix_sizes: tuple[int, ...] = ()) -> Words:
    """Split every text into words and hash them, and on request their first bytes (a shorter word's whole)."""
    n = len(data)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return Words(np.zeros(0, dtype=np.uint64), empty, empty, np.zeros(len(offsets), dtype=np.int64), tuple(np.zeros(0, dtype=np.uint64) for _ in prefix_sizes))
    mask = word_bytes[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    heads = tuple(np.empty(len(starts), dtype=np.uint64) for _ in prefix_sizes)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, a + _STEP)))
        b = ends[j - 1]
        part = FOLD[data[a:b]].astype(np.uint64)
        part += np.uint64(1)
        part *= _RP.upto(b - a)
        total = np.empty(b - a + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(part, out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        back = _RI.upto(b - a)[s]
        hashes[i:j] = mix((total[e] - total[s]) * back + (e - s).astype(np.uint64))
        for size, out in zip(prefix_sizes, heads):
            out[i:j] = mix((total[np.minimum(e, s + size)] - total[s]) * back + np.uint64(1 << 32 | size))
        i = j
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets), heads)


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, by where it starts; texts' bounds are not looked at."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out, step = np.empty(n, dtype=np.uint64), _STEP // 4
    for i in range(0, n, step):
        j = min(n, i + step)
        part = hashes[i : j + length - 1] * _QP.upto(j - i + length - 1)
        total = np.empty(len(part) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(part, out=total[1:])
        out[i:j] = mix((total[length:] - total[:-length]) * _QI.upto(j - i) + np.uint64(length))
    return out


def in_one_text(bounds: np.ndarray, length: int, n: int) -> np.ndarray:
    """For each of ``n`` windows, whether all of its words are of one text."""
    ok = np.ones(max(n, 0), dtype=bool)
    for k in range(1, length):
        cut = bounds[1:-1] - k
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes each (a longer text stands alone)."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        out.append((i, min(j, n)))
        i = out[-1][1]
    return out
