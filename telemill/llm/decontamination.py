"""Benchmark decontamination by word windows.

The windows of the benchmark items form a hash set that every task holds: sorted
arrays over the items' text, some thirty bytes a window.  The text is bounded,
and items beyond the bound are taken in several blocks, which the documents pass
one after the other.  A task scans its documents' rolling window hashes, looks
hits up, and compares the words themselves before it believes a hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.text import FOLD, Words, slices, text_buffers, window_hashes, words_of

ITEM_BYTES = 4 << 20  # of item text that one block may hold: at most some 2 million windows
_SLICE = 4 << 20


@dataclass
class _Table:
    """Windows of one length, those of equal words together."""

    size: int  # words of a window
    keys: np.ndarray  # sorted, distinct hashes
    filter: np.ndarray  # by the top bits of a hash, whether a key has them
    shift: np.uint64
    groups: np.ndarray  # where each key's groups begin; nearly always a key has one
    word: np.ndarray  # of each group, the item word where an example begins
    begin: np.ndarray  # of each group, where its items begin
    items: np.ndarray  # numbers of items, without repeats in a group

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where, which key) of the hashes that are keys."""
        maybe = np.flatnonzero(self.filter[hashes >> self.shift])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == hashes[maybe]
        return maybe[hit], at[hit]


@dataclass
class _Block:
    """Items and their windows by length."""

    ids: list[int]
    data: np.ndarray
    words: Words
    tables: list[_Table]


def _joined(data: np.ndarray, words: Words, i: int, n: int) -> bytes:
    """Words i to i + n, folded, with a blank between them."""
    return b" ".join(FOLD[data[a:b]].tobytes() for a, b in zip(words.starts[i : i + n].tolist(), words.ends[i : i + n].tolist()))


def _block(items: list[tuple[int, str | None]], length: int) -> _Block:
    data, offsets = text_buffers(pa.array([t for _, t in items], pa.string()))
    words = words_of(data, offsets)
    sizes = np.minimum(words.counts(), length)
    tables = []
    for size in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == size)
        n = words.counts()[own] - size + 1
        item = np.repeat(own, n)
        start = np.repeat(words.bounds[own], n) + np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        hashes = window_hashes(words.hashes, size)[start]
        order = np.lexsort((item, hashes))
        item, start, hashes = item[order], start[order], hashes[order]
        new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        group = np.cumsum(new) - 1
        # windows of one hash but other words, of which there should be none, get groups of their own
        head = np.flatnonzero(new)[group]
        again = np.flatnonzero(~new)
        other = [i for i in again.tolist() if _joined(data, words, int(start[i]), size) != _joined(data, words, int(start[head[i]]), size)]
        if other:
            texts = [_joined(data, words, int(i), size) for i in start.tolist()]
            order = np.array(sorted(range(len(texts)), key=lambda i: (hashes[i], texts[i], item[i])))
            item, start, hashes, texts = item[order], start[order], hashes[order], [texts[i] for i in order]
            group = np.cumsum(np.array([True, *((hashes[i], texts[i]) != (hashes[i - 1], texts[i - 1]) for i in range(1, len(texts)))])) - 1
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        keys, groups = np.unique(hashes[first], return_index=True)
        once = np.concatenate([[True], (group[1:] != group[:-1]) | (item[1:] != item[:-1])])
        bits = min(26, max(16, int(len(keys) * 16).bit_length()))
        shift = np.uint64(64 - bits)
        seen = np.zeros(1 << bits, dtype=bool)
        seen[keys >> shift] = True
        tables.append(_Table(size, keys, seen, shift, np.append(groups, len(first)), start[first], np.searchsorted(group[once], np.arange(len(first) + 1)), item[once]))
    return _Block([i for i, _ in items], data, words, tables)


def _hits(data: np.ndarray, words: Words, block: _Block, n_texts: int) -> tuple[list[tuple[int, int, int]], list[set[int]]]:
    """(first word, number of words, text) of every window of an item in a text, and each text's items."""
    runs, items = [], [set() for _ in range(n_texts)]
    for table in block.tables:
        size = table.size
        where, which = table.find(window_hashes(words.hashes, size))
        text = np.searchsorted(words.bounds, where, side="right") - 1
        inside = where + size <= words.bounds[text + 1]
        for i, k, t in zip(where[inside].tolist(), which[inside].tolist(), text[inside].tolist()):
            seen = _joined(data, words, i, size)
            for g in range(int(table.groups[k]), int(table.groups[k + 1])):
                if _joined(block.data, block.words, int(table.word[g]), size) == seen:
                    runs.append((i, size, t))
                    items[t].update(table.items[table.begin[g] : table.begin[g + 1]].tolist())
    return runs, items


def _covered(words: Words, runs: list[tuple[int, int, int]]) -> np.ndarray:
    mark = np.zeros(len(words.hashes) + 1, dtype=np.int32)
    if runs:
        at = np.array(runs, dtype=np.int64)
        np.add.at(mark, at[:, 0], 1)
        np.add.at(mark, at[:, 0] + at[:, 1], -1)
    return np.cumsum(mark)[:-1] > 0


def _ranges(words: Words, hit: np.ndarray, n_texts: int) -> list[list[tuple[int, int]]]:
    """For each text, its runs of hit words, as word numbers in the text."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n_texts)]
    if hit.any():
        text = np.searchsorted(words.bounds, np.flatnonzero(hit), side="right") - 1
        for t in np.unique(text).tolist():
            a, b = int(words.bounds[t]), int(words.bounds[t + 1])
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
            out[t] = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
    return out


def _blocks(items: DataFrame, length: int, item_bytes: int) -> list:
    """Each block of items, as a broadcast."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // item_bytes))
    out = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = [(r.item_id, r.text) for r in part.collect()]  # at most item_bytes or so
        out.append(items.sparkSession.sparkContext.broadcast(_block(rows, length)))
    return out


_FOUND = "item_hits array<long>, ranges array<struct<begin:long,end:long>>"


def scan(docs: DataFrame, items: DataFrame, length: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (distinct ids, null ids left out), ranges of hit words.

    A window is ``length`` consecutive words of an item, or a shorter item's all
    words; a document word inside any occurrence of a window is hit.  Null and
    empty texts have no words and no hits; an item without words has no window.
    Rows with the same doc_id are documents of their own; doc_id and item_id
    are numbers.  Texts are scanned whole.  No documents: no rows; no items: no
    hits.  Other columns are ignored.
    """
    cur = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _blocks(items, length, item_bytes)
    schema = T.StructType([*cur.schema.fields, T.StructField("n_words", T.LongType()), *T.StructType.fromDDL(_FOUND).fields])
    for k, shared in enumerate(blocks):
        last = k == len(blocks) - 1
        cur = cur.mapInArrow(_scanner(shared, keep_text=not last), schema)
    return cur.select(
        "doc_id",
        "n_words",
        F.aggregate("ranges", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"]).alias("n_hit"),
        F.array_distinct(F.filter("item_hits", lambda x: x.isNotNull())).alias("items"),
        "ranges",
    )


def _merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def _scanner(shared, keep_text: bool):
    kinds = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            before = batch.num_columns > 2
            for i, j in slices(offsets, _SLICE):
                own = data[offsets[i] : offsets[j]]
                words = words_of(own, offsets[i : j + 1] - offsets[i])
                runs, items = _hits(own, words, block, j - i)
                ranges = _ranges(words, _covered(words, runs), j - i)
                named = [[block.ids[k] for k in sorted(x)] for x in items]
                few = batch.slice(i, j - i)
                if before:
                    named = [(a or []) + b for a, b in zip(few.column("item_hits").to_pylist(), named)]
                    ranges = [_merged([(x["begin"], x["end"]) for x in a or []], b) for a, b in zip(few.column("ranges").to_pylist(), ranges)]
                yield pa.RecordBatch.from_arrays(
                    [
                        few.column("doc_id"),
                        few.column("text") if keep_text else pa.nulls(j - i, pa.string()),
                        pa.array(words.counts()),
                        pa.array(named, pa.list_(pa.int64())),
                        pa.array([[{"begin": a, "end": b} for a, b in x] for x in ranges], kinds),
                    ],
                    names=["doc_id", "text", "n_words", "item_hits", "ranges"],
                )

    return run


def _clean_text(text: str, block: _Block) -> tuple[str, int, int]:
    """(the text without its hit spans, words taken out, words there were); scans again until nothing hits."""
    taken = total = 0
    first = True
    while True:
        raw = text.encode()
        data, offsets = np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)])
        words = words_of(data, offsets)
        runs, _ = _hits(data, words, block, 1)
        if first:
            total, first = len(words.hashes), False
        if not runs:
            return text, taken, total
        at, kept = 0, []
        for a, b in _ranges(words, _covered(words, runs), 1)[0]:
            taken += b - a
            kept.append(raw[at : words.starts[a]])
            at = words.ends[b - 1]
        text = b"".join([*kept, raw[at:]]).decode()


def clean(docs: DataFrame, items: DataFrame, length: int = 10, most: float = 0.5, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``docs`` with hit spans cut out of their texts; documents of which more than the share ``most`` is hit go.

    Documents without a hit come back as they are, with null and empty texts
    among them.  Columns stay as they are; n_chars, where there is one, counts
    the new text.
    """
    cur = docs
    for shared in _blocks(items, length, item_bytes):
        cur = _cleaned(cur, shared, most)
    return cur


def _cleaned(docs: DataFrame, shared, most: float) -> DataFrame:
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(names.index("text")))
            for i, j in slices(offsets, _SLICE):
                own = data[offsets[i] : offsets[j]]
                words = words_of(own, offsets[i : j + 1] - offsets[i])
                runs, _ = _hits(own, words, block, j - i)
                few = batch.slice(i, j - i)
                if runs:
                    texts, keep = few.column(names.index("text")).to_pylist(), np.ones(j - i, dtype=bool)
                    changed = {}
                    for t in {t for _, _, t in runs}:
                        texts[t], taken, total = _clean_text(texts[t], block)
                        keep[t] = taken <= most * total
                        changed[t] = len(texts[t])
                    columns = list(few.columns)
                    columns[names.index("text")] = pa.array(texts, few.schema.field("text").type)
                    if "n_chars" in names:
                        at = names.index("n_chars")
                        sizes = columns[at].to_pylist()
                        for t, n in changed.items():
                            sizes[t] = n
                        columns[at] = pa.array(sizes, columns[at].type)
                    few = pa.RecordBatch.from_arrays(columns, schema=few.schema).filter(pa.array(keep))
                yield few

    return docs.mapInArrow(run, docs.schema)
