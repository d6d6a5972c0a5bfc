"""Byte-level BPE ids of whole texts, with each distinct pre-token encoded once per worker.

Pre-tokens never influence each other's merges, so a text's ids are the ids of
its pre-tokens in a row.  Their borders are found with array operations over
code points; only pre-tokens that the worker has not met go to the tokenizer.
This holds for files that split by the usual byte-level pattern and normalise
nothing; with any other file whole texts go to the tokenizer.  Pre-tokens are
remembered by 64 bits of hash: among the at most 3 million that a worker
remembers two collide with a probability below one in a million.
"""

from __future__ import annotations

import json
import os
import sys

import numpy as np
import regex

from telemill.llm.text import _RI, _RP, mix

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_SLICE = 1 << 19  # code points at once
_KEEP = 3_000_000  # pre-tokens that a worker remembers; then it starts afresh


def _classes() -> np.ndarray:
    """Class of every code point: white space, letter, number, or other."""
    table = np.full(sys.maxunicode + 1, _OTHER, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for kind, pattern in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                table[a : b + 1] = kind
            else:
                table[[ord(x) for x in m[0]]] = kind
    return table


def borders(points: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens start among the code points of texts that start at ``bounds[:-1]``."""
    n = len(points)
    kind = classes[points]
    head = np.zeros(n + 1, dtype=bool)
    head[bounds] = True  # also the end
    space, blank = kind == _SPACE, points == 32
    start = np.ones(n, dtype=bool)
    start[1:] = kind[1:] != kind[:-1]
    start |= head[:-1]
    # a run of white space gives its last character to what follows it in the same text
    more = np.zeros(n, dtype=bool)  # the next character is no white space and of the same text
    more[:-1] = ~space[1:] & ~head[1:-1]
    last = space & more
    start |= last
    # and what follows such a blank goes on with it
    joined = np.zeros(n, dtype=bool)
    joined[1:] = (last & blank)[:-1]
    start &= ~joined
    # contractions
    quote = np.flatnonzero((points == 39) & start & ~joined)
    if len(quote):
        padded = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
        end = bounds[np.searchsorted(bounds, quote, side="right")]
        one, two = padded[quote + 1], padded[quote + 2]
        short = np.isin(one, [ord(x) for x in "stmd"]) & (quote + 2 <= end)
        long_ = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        long_ &= quote + 3 <= end
        for at, size in ((quote[short], 2), (quote[long_], 3)):
            start[at + 1] = False
            if size == 3:
                start[at + 2] = False
            after = at + size
            start[after[after < n]] = True
            # a quote right after a contraction begins a pre-token of its own, which can be a contraction again
    return np.flatnonzero(start)


class Encoder:
    """Ids of texts by one tokenizer file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        split = setup.get("pre_tokenizer") or {}
        self.by_pattern = setup.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self.classes = _classes()
        self._forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The worker's encoder for ``path``; it lives as long as the worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)  # into ids
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        got = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        ids = np.fromiter((i for x in got for i in x), dtype=np.uint32, count=int(size.sum()))
        at = len(self.ids) + np.cumsum(size) - size
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in a row, where each text's ids start and end); ``end`` closes each text."""
        flat, sizes = [], []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < _SLICE):
                size += len(texts[j] or "") + 1
                j += 1
            part, counts = self._encode([x or "" for x in texts[i:j]], end)
            flat.append(part)
            sizes.append(counts)
            i = j
        counts = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
        return (np.concatenate(flat) if flat else np.zeros(0, dtype=np.uint32)), np.concatenate([[0], np.cumsum(counts)])

    def _encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        whole = "".join(texts)
        if not whole:
            return np.full(len(texts), end, dtype=np.uint32), np.ones(len(texts), dtype=np.int64)
        special = any(x.content in whole for x in self.tokenizer.get_added_tokens_decoder().values())
        if special or not self.by_pattern:  # the tokenizer has its own way with these strings
            got = [[*x.ids, end] for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in got for i in x], dtype=np.uint32), np.array([len(x) for x in got], dtype=np.int64)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        start = borders(points, bounds, self.classes)
        stop = np.append(start[1:], len(points))
        part = (points.astype(np.uint64) + np.uint64(1)) * _RP.upto(len(points))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part, dtype=np.uint64)])
        keys = mix((total[stop] - total[start]) * _RI.upto(len(points))[start] + (stop - start).astype(np.uint64))
        distinct, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > _KEEP:
            self._forget()
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        if not known.all():
            new = first[~known]
            self._learn(distinct[~known], [whole[a:b] for a, b in zip(start[new].tolist(), stop[new].tolist())])
            at = np.searchsorted(self.keys, distinct)
        size, src = self.size[at][which], self.at[at][which]
        # pre-tokens of each text, and after the last of them its end
        of = np.searchsorted(start, bounds)
        done = np.concatenate([[0], np.cumsum(size)])
        counts = done[of[1:]] - done[of[:-1]] + 1
        row = np.repeat(np.arange(len(texts)), np.diff(of))
        out = np.full(int(counts.sum()), end, dtype=np.uint32)
        n = int(done[-1])
        step = np.arange(n) - np.repeat(done[:-1], size)
        out[np.arange(n) + np.repeat(row, size)] = self.ids[np.repeat(src, size) + step]
        return out, counts
