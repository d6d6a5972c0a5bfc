"""Removal of byte strings that repeat across or inside documents.

Every string of ``LENGTH`` bytes holds cores of ``CORE`` bytes; the one with the
least hash (the leftmost of equals) is its anchor, which depends on the string
alone, so equal strings have equal anchors at equal distances.  A text has an
anchor about every 70 bytes, not one suffix a byte.

1. Each distinct text is written once with the number of its copies.
2. Anchors whose core hash occurs once in the corpus are done: no string of
   theirs repeats.
3. The others take along the bytes that their strings cover, and meet by core.
   Each group is sorted twice, as suffixes to the right of the anchor and to
   the left (:mod:`telemill.llm.suffix_sort`).  A string that begins ``d`` bytes
   before its anchor repeats if another anchor shares ``d`` bytes to the left
   and ``LENGTH - d`` to the right: neighbours' common extensions cut both
   orders into classes, and strings that share both classes are equal.
4. Groups of over ``GROUP`` anchors (a passage in a large part of all texts) are
   not gathered.  Equal contexts of theirs are one row with a count, a kind.
   Groups of up to ``GROUP`` kinds are sorted like small ones; of those of more,
   each string of a kind is counted by 128 bits of its SHA-256, pre-aggregated.
5. Covered ranges go back to their text, which is cut.

Nulls are empty texts; texts of under ``LENGTH`` bytes lose nothing.  Repeated
rows are copies of each other, so a text of at least ``LENGTH`` bytes that two
rows have is removed whole in both.  An empty table gives no rows.  Other
columns are not read, so their names do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.store import bucketed, dropped, written
from telemill.llm.suffix_sort import Buffer, sort_groups
from telemill.llm.text import slices, text_buffers, window_hashes

LENGTH = 200
CORE = 64
GROUP = 4096  # anchors, or of more anchors kinds, of one core that are sorted in one place, some 1.4 MB
KINDS = 1 << 16  # ranges of large groups' contexts that every task gets, some 4 MB; more of them are joined
NAMES = 1 << 18  # repeated strings' names that every task gets, some 4 MB and as a set 25; more of them are joined
HELD = 1 << 15  # kinds that a task counts before it gives them out, some 10 MB
_SLICE = 1 << 20
_SORTED = 4 << 20  # bytes of contexts that are sorted at once
_AT = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core hash, place, first, last): anchors of all strings of ``length`` bytes inside one text, and the starts of the first and last string of each.

    Places count from the start of ``data``.
    """
    n, none = len(data) - length + 1, np.zeros(0, dtype=np.int64)
    if n <= 0:
        return np.zeros(0, dtype=np.uint64), none, none, none
    hashes = window_hashes(data.astype(np.uint64) + np.uint64(1), core)
    places = []
    span = length - core + 1  # cores of a string
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    starts = offsets[:-1][np.diff(offsets) >= length]
    ends = offsets[1:][np.diff(offsets) >= length] - length + 1
    inside[starts] += 1
    inside[ends] -= 1
    valid = np.cumsum(inside, dtype=np.int8)[:n] > 0
    step = int(_AT) // 2
    for i in range(0, n, step):
        j = min(n, i + step)
        part = (hashes[i : j + span - 1] & ~_AT) | np.arange(j + span - 1 - i, dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            part = np.minimum(part[: len(part) - width], part[width:])
            width *= 2
        least = np.minimum(part[: j - i], part[span - width : span - width + j - i])
        places.append((least & _AT).astype(np.int64) + i)
    place = np.concatenate(places)
    change = np.flatnonzero(np.diff(place) != 0) + 1
    cut = np.flatnonzero(valid[1:] != valid[:-1]) + 1
    first = np.unique(np.concatenate([[0], change, cut]))
    last = np.append(first[1:], n) - 1
    some = valid[first]
    first, last = first[some], last[some]
    return hashes[place[first]], place[first], first, last


def _text(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def _node():
    """A text's name: 128 bits of its SHA-256."""
    return F.substring(F.unhex(F.sha2(_text(), 256)), 1, 16).alias("node")


def _texts(docs: DataFrame) -> DataFrame:
    """(node, text, copies): each distinct text once, in buckets by node."""
    named = docs.select(_node(), _text().alias("text"))
    return bucketed(named.groupBy("node").agg(F.first("text").alias("text"), F.count("*").alias("copies")), "repeats_texts", "node")


def _anchor_rows(texts: DataFrame, length: int, core: int) -> DataFrame:
    """(core, node, at): place, and the starts of the strings before it, of each anchor as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            node = batch.column("node")
            for i, j in slices(offsets, _SLICE):
                begin = offsets[i : j + 1] - offsets[i]
                hashes, place, first, last = anchors(data[offsets[i] : offsets[j]], begin, length, core)
                text = np.searchsorted(begin, first, side="right") - 1
                at = ((place - begin[text]) << 20) | ((place - first) << 10) | (place - last)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), node.take(pa.array(text + i)), pa.array(at)], names=["core", "node", "at"])

    return texts.select("node", "text").mapInArrow(run, "core long, node binary, at long")


def _bodies(batch: pa.RecordBatch, length: int) -> Iterator[tuple[pa.StructArray, np.ndarray, pa.Array]]:
    """(anchors, their texts' rows, bytes that their strings cover), some at a time, of rows of a text and its anchors."""
    data, offsets = text_buffers(batch.column("text"))
    lists = batch.column("anchors")
    fields = lists.flatten()
    text = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    at = fields.field("at").to_numpy(zero_copy_only=False)
    place, before, after = offsets[text] + (at >> 20), (at >> 10) & 1023, at & 1023
    low, high = place - before, place - after + length
    for i, j in slices(np.concatenate([[0], np.cumsum(high - low)]), 8 << 20):
        size = high[i:j] - low[i:j]
        ends = np.cumsum(size)
        flat = data[np.arange(int(ends[-1])) + np.repeat(low[i:j] - (ends - size), size)]
        yield fields.slice(i, j - i), text[i:j], pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(flat)])


def _with_texts(kept: DataFrame, texts: DataFrame) -> DataFrame:
    return texts.select("node", "text").join(kept.hint("shuffle_hash"), "node").select("node", "text", "anchors")


def _contexts(kept: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(core, node, at, bytes): the bytes that each anchor's strings cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fields, text, body in _bodies(batch, length):
                yield pa.RecordBatch.from_arrays([fields.field("core"), batch.column("node").take(pa.array(text)), fields.field("at"), body], names=["core", "node", "at", "bytes"])

    return _with_texts(kept, texts).mapInArrow(run, "core long, node binary, at long, bytes binary")


def _equal_rows(text: Buffer, start: np.ndarray, size: np.ndarray, place: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): contexts sorted so that equal ones of a group stand together, and which begin a new kind."""
    name = (text.total[start + size] - text.total[start]) * text.back[start]
    order = np.lexsort((place, size, name, group))
    a, b = order[:-1], order[1:]
    same = (group[a] == group[b]) & (name[a] == name[b]) & (size[a] == size[b]) & (place[a] == place[b])
    some = np.flatnonzero(same)
    same[some] = text.equal(start[a[some]], start[b[some]], size[a[some]])
    return order, np.concatenate([[True], ~same])


def repeated(data: np.ndarray, offsets: np.ndarray, before: np.ndarray, group: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, low, high): the range of each context, from its start on, that strings which repeat cover.

    Contexts of a group (given in a row) hold their anchor ``before`` bytes after
    their start.  All strings of a context hold its anchor, so those that repeat
    cover one range, from the first one's start to the last one's end.
    """
    text, start, size = Buffer(data), offsets[:-1], np.diff(offsets)
    order, new = _equal_rows(text, start, size, before, group)
    kind = np.cumsum(new) - 1
    one = order[new]  # one context of each kind
    many = np.bincount(kind) > 1
    out = [(order[many[kind]], np.zeros(int(many[kind].sum()), dtype=np.int64), size[order[many[kind]]])]
    own = group[one]
    bounds = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
    some = np.flatnonzero(np.repeat(np.diff(bounds), np.diff(bounds)) > 1)
    if not len(some):
        return out[0]
    many, one, own = many[some], one[some], own[some]
    at, left, right = (start + before)[one], before[one], (size - before)[one]
    bounds = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
    by_right, common_right = sort_groups(text, at, right, bounds)
    by_left, common_left = sort_groups(text, at, left, bounds, left=True)
    low, high = np.full(len(at), -1), np.full(len(at), -1)  # starts of the first and last string that repeats
    first = bounds[:-1][np.diff(bounds) == 2]
    common = common_left[first + 1], common_right[first + 1]
    for k in (first, first + 1):
        hit = common[0] + common[1] >= length
        low[k[hit]], high[k[hit]] = (left[k] - common[0])[hit], (left[k] + common[1])[hit] - length
    rest = np.flatnonzero(np.repeat(np.diff(bounds), np.diff(bounds)) > 2)
    if len(rest):
        heads = np.zeros(len(at), dtype=bool)
        heads[bounds[:-1]] = True
        heads, common_right, common_left, by_right, by_left = heads[rest], common_right[rest], common_left[rest], by_right[rest], by_left[rest]
        for d in range(int(left[rest].max()) + 1):
            names = np.empty((2, len(at)), dtype=np.int64)
            names[0, by_right] = np.cumsum(heads | (common_right < length - d))
            names[1, by_left] = np.cumsum(heads | (common_left < d))
            key = names[0, rest] * (len(rest) + 1) + names[1, rest]
            turn = np.argsort(key, kind="stable")
            equal = np.flatnonzero(key[turn[1:]] == key[turn[:-1]])
            twice = np.zeros(len(rest), dtype=bool)
            twice[turn[equal]] = twice[turn[equal + 1]] = True
            hit = rest[twice & (left[rest] >= d) & (right[rest] >= length - d)]
            low[hit] = left[hit] - d
            high[hit] = np.where(high[hit] < 0, low[hit], high[hit])
    single = np.flatnonzero(~many & (low >= 0))
    out.append((one[single], low[single], high[single] + length))
    return tuple(np.concatenate(x) for x in zip(*out))


def _begin(at: np.ndarray) -> np.ndarray:
    """Where an anchor's first string starts in its text."""
    return (at >> 20) - ((at >> 10) & 1023)


def _group_wise(contexts: DataFrame, judge: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``judge`` over whole groups of ``contexts`` (by core), some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            core = batch.column("core").to_numpy()
            if size >= _SORTED and core[0] != core[-1]:
                cut = int(np.searchsorted(core, core[-1]))
                held[-1], rest = batch.slice(0, cut), batch.slice(cut)
                yield judge(pa.Table.from_batches(held).combine_chunks())
                held, size = [rest], rest.nbytes
        if held:
            yield judge(pa.Table.from_batches(held).combine_chunks())

    return contexts.repartition("core").sortWithinPartitions("core").mapInArrow(run, schema)


def _repeated_of(table: pa.Table, before: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`repeated` of rows (core, bytes) that are sorted by core."""
    body = table.column("bytes").combine_chunks() if table.column("bytes").num_chunks != 1 else table.column("bytes").chunk(0)
    data, offsets = text_buffers(body.cast(pa.large_binary()).view(pa.large_string()))
    core = table.column("core").to_numpy()
    return repeated(data, offsets, before, np.cumsum(np.append(True, core[1:] != core[:-1])), length)


def _sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """(node, low, high) of all groups that are sorted in one place."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        at = table.column("at").to_numpy()
        some, low, high = _repeated_of(table, (at >> 10) & 1023, length)
        node = table.column("node").combine_chunks().take(pa.array(some))
        return pa.RecordBatch.from_arrays([node, pa.array(_begin(at)[some] + low), pa.array(_begin(at)[some] + high)], names=["node", "low", "high"])

    return _group_wise(contexts, judge, "node binary, low long, high long")


def _sorted_kinds(kinds: DataFrame, length: int) -> DataFrame:
    """(kind, low, high) of large groups of few kinds; what more than one context has repeats whole."""

    def judge(table: pa.Table) -> pa.RecordBatch:
        some, low, high = _repeated_of(table, table.column("before").to_numpy(), length)
        whole = table.column("copies").to_numpy() > 1
        one, twice = ~whole[some], np.flatnonzero(whole)
        size = pc.binary_length(table.column("bytes")).to_numpy().astype(np.int64)
        kind = table.column("kind").combine_chunks().take(pa.array(np.append(some[one], twice)))
        return pa.RecordBatch.from_arrays([kind, pa.array(np.append(low[one], np.zeros(len(twice), dtype=np.int64))), pa.array(np.append(high[one], size[twice]))], names=["kind", "low", "high"])

    return _group_wise(kinds, judge, "kind binary, low long, high long")


def _name(bodies: pa.Array) -> list[bytes]:
    return [hashlib.sha256(x).digest()[:16] for x in bodies.to_pylist()]


def _counted_spans(kept: DataFrame, texts: DataFrame, length: int, group: int) -> tuple[DataFrame, Callable[[], None]]:
    """(node, low, high) of the large groups, and what frees that which it reads.

    Equal contexts are one kind; their core and the place of their anchor are
    equal, too.  A group of at most ``group`` kinds is sorted, so that only those
    of more get a row for each string, at most ``length - core + 1`` a kind.  A
    short list of the kinds' ranges goes to the texts, as one kind may have a
    large part of all anchors; a long one is joined.
    """

    def kinds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            columns = zip(("bytes", "copies", "core", "before"), (pa.binary(), pa.int64(), pa.int64(), pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), *(pa.array([x[k] for x in held.values()], kind) for k, (_, kind) in enumerate(columns))], names=["kind", "bytes", "copies", "core", "before"])

        for batch in batches:
            for fields, _, body in _bodies(batch, length):
                core, before = fields.field("core"), (fields.field("at").to_numpy(zero_copy_only=False) >> 10) & 1023
                for k, name in enumerate(_name(body)):
                    if name in held:
                        held[name][1] += 1
                    else:
                        held[name] = [body[k].as_py(), 1, core[k].as_py(), int(before[k])]
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fields, text, body in _bodies(batch, length):
                begin = _begin(fields.field("at").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(_name(body), pa.binary()), batch.column("node").take(pa.array(text)), pa.array(begin)], names=["kind", "node", "begin"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, starts, names = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], []
            for k, x in enumerate(batch.column("bytes").to_pylist()):
                n = len(x) - length + 1
                kinds.append(np.full(n, k))
                starts.append(np.arange(n))
                names.extend(hashlib.sha256(x[i : i + length]).digest()[:16] for i in range(n))
            take = pa.array(np.concatenate(kinds))
            yield pa.RecordBatch.from_arrays([batch.column("kind").take(take), batch.column("copies").take(take), pa.array(np.concatenate(starts)), pa.array(names, pa.binary())], names=["kind", "copies", "start", "name"])

    own = _with_texts(kept, texts)
    firsts = [F.first(c).alias(c) for c in ("bytes", "core", "before")]
    every = written(own.mapInArrow(kinds_of, "kind binary, bytes binary, copies long, core long, before long").groupBy("kind").agg(*firsts, F.sum("copies").alias("copies")), "repeats-contexts")
    kinds = written(every.join(every.groupBy("core").agg((F.count("*") > group).alias("many")), "core"), "repeats-kinds")
    few = _sorted_kinds(kinds.where("not many").select("core", "kind", "before", "copies", "bytes"), length)
    many = kinds.where("many").select("kind", "bytes", "copies")
    rows = many.mapInArrow(strings, "kind binary, copies long, start long, name binary")
    twice = written(rows.groupBy("name").agg(F.sum("copies").alias("n")).where("n > 1").select("name"), "repeats-twice")
    if twice.count() <= NAMES:
        # a passage that many kinds share has its strings in all of them, so each kind asks for its own where it is
        names = kept.sparkSession.sparkContext.broadcast(b"".join(twice.toArrow().column("name").to_pylist()))
        ranges = written(_repeated_ranges(many, names, length).unionByName(few), "repeats-ranges")
        names.destroy()
    else:
        asked = rows.join(twice, "name", "left_semi").groupBy("kind").agg(F.min("start").alias("low"), (F.max("start") + length).alias("high"))
        ranges = written(asked.unionByName(few), "repeats-ranges")
    short = ranges.count() <= KINDS
    table = kept.sparkSession.sparkContext.broadcast({bytes(r.kind): (r.low, r.high) for r in ranges.collect()} if short else {})
    if short:
        spans = _looked_up(own, table, length)
    else:
        spans = own.mapInArrow(named, "kind binary, node binary, begin long").join(ranges, "kind").select("node", (F.col("begin") + F.col("low")).alias("low"), (F.col("begin") + F.col("high")).alias("high"))

    def free() -> None:
        table.destroy()
        dropped(every, kinds, twice, ranges)

    return spans, free


def _repeated_ranges(kinds: DataFrame, names: Broadcast, length: int) -> DataFrame:
    """(kind, low, high): from the first to the last of each kind's strings whose name, 16 bytes, is in ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = names.value
        twice = {own[i : i + 16] for i in range(0, len(own), 16)}
        for batch in batches:
            out = []
            for kind, x in zip(batch.column("kind").to_pylist(), batch.column("bytes").to_pylist()):
                hit = [i for i in range(len(x) - length + 1) if hashlib.sha256(x[i : i + length]).digest()[:16] in twice]
                if hit:
                    out.append((kind, hit[0], hit[-1] + length))
            kind, low, high = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["kind", "low", "high"])

    return kinds.mapInArrow(run, "kind binary, low long, high long")


def _looked_up(texts: DataFrame, table: Broadcast, length: int) -> DataFrame:
    """(node, low, high): of each of ``texts`` (with their anchors) the merged ranges of those of its anchors whose kind is in ``table``, which has at most ``KINDS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table.value
        for batch in batches:
            found = [np.zeros((0, 3), dtype=np.int64)]
            for fields, text, body in _bodies(batch, length):
                ranges = np.array([own.get(k, (-1, -1)) for k in _name(body)], dtype=np.int64)
                begin, some = _begin(fields.field("at").to_numpy(zero_copy_only=False)), ranges[:, 0] >= 0
                found.append(np.column_stack([text, begin + ranges[:, 0], begin + ranges[:, 1]])[some])
            text, low, high = merged(*np.concatenate(found).T)
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(text)), pa.array(low), pa.array(high)], names=["node", "low", "high"])

    return texts.mapInArrow(run, "node binary, low long, high long")


def merged(text: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, low, high): maximal ranges of each text, in order; ranges that touch are one."""
    order = np.lexsort((low, text))
    text, low, high = text[order], low[order], high[order]
    if not len(text):
        return text, low, high
    shift = text * (int(high.max()) + 2)  # texts stand apart, so one running maximum serves all
    reach = np.maximum.accumulate(high + shift)
    begins = np.append(True, low[1:] + shift[1:] > reach[:-1])
    return text[begins], low[begins], (reach - shift)[np.append(begins[1:], True)]


def _cut_rows(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(node, n_removed, n_spans, kept, kept_sha256) of the texts that have spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            lists = batch.column("spans")
            own = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            text, low, high = merged(own, *(lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("low", "high")))
            first = np.searchsorted(text, np.arange(batch.num_rows + 1))
            kept = []
            for k in range(batch.num_rows):
                a, b = low[first[k] : first[k + 1]], high[first[k] : first[k + 1]]
                body = data[offsets[k] : offsets[k + 1]]
                kept.append(b"".join(body[i:j].tobytes() for i, j in zip(np.append(0, b), np.append(a, len(body)))))
            removed = np.add.reduceat(np.append(high - low, 0), first[:-1]) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(removed), pa.array(np.diff(first)), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                names=["node", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    wanted = spans.groupBy("node").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    return texts.where("copies = 1").select("node", "text").join(wanted.hint("shuffle_hash"), "node").mapInArrow(run, "node binary, n_removed long, n_spans long, kept binary, kept_sha256 string")


def _of_size(kept: DataFrame, large: bool) -> DataFrame:
    """Texts with their anchors in large groups, or with the others."""
    some = kept.withColumn("anchors", F.filter("anchors", lambda x: x["large"] if large else ~x["large"]))
    return some.where(F.size("anchors") > 0)


def _spans(texts: DataFrame, length: int, core: int, group: int) -> DataFrame:
    """(node, low, high): ranges of distinct texts that strings which repeat cover."""
    rows = written(_anchor_rows(texts, length, core), "repeats-anchors")
    # written apart, so that the join has a shuffle of its own, of which Spark can split a core's large part
    shared = written(rows.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core", (F.col("n") > group).alias("large")), "repeats-shared")
    kept = written(rows.join(shared, "core").groupBy("node").agg(F.collect_list(F.struct("core", "large", "at")).alias("anchors")), "repeats-kept")
    dropped(rows, shared)
    counted, free = _counted_spans(_of_size(kept, True), texts, length, group)
    found = written(_sorted_spans(_contexts(_of_size(kept, False), texts, length), length).unionByName(counted), "repeats-spans")
    dropped(kept)
    free()
    return found


def removed(docs: DataFrame, length: int = LENGTH, core: int = CORE, group: int = GROUP) -> DataFrame:
    """(node, n_removed, n_spans, kept, kept_sha256) of each distinct text of ``docs`` that loses bytes.

    ``node`` is 128 bits of the text's SHA-256, ``kept`` its remaining bytes (a cut
    may split a character, so they are binary).  ``length`` is 500 at most, and
    ``core`` less.
    """
    if not 0 < core < length <= 500:
        raise ValueError("strings have at most 500 bytes, and a core fewer than its string")
    texts = _texts(docs)
    spans = _spans(texts, length, core, group)
    whole = texts.where((F.col("copies") > 1) & (F.octet_length("text") >= length)).select(
        "node", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.unhex(F.lit("")).alias("kept"), F.sha2(F.lit(""), 256).alias("kept_sha256")
    )
    out = written(_cut_rows(texts, spans).unionByName(whole), "repeats-cut")
    dropped(texts, spans)
    return out


def cut(docs: DataFrame, length: int = LENGTH, core: int = CORE, group: int = GROUP, into: str = "repeats") -> DataFrame:
    """All columns of ``docs``, and a struct ``into`` of n_bytes, n_removed, n_spans and kept_sha256 of each row's text."""
    found = removed(docs, length, core, group).select("node", F.struct("n_removed", "n_spans", "kept_sha256").alias("found"))
    rows = docs.select(F.struct("*").alias("row"), _node(), F.octet_length(_text()).cast("long").alias("n_bytes"), F.sha2(_text(), 256).alias("sha256"))
    zero = F.lit(0).cast("long")
    got = F.struct("n_bytes", F.coalesce("found.n_removed", zero).alias("n_removed"), F.coalesce("found.n_spans", zero).alias("n_spans"), F.coalesce("found.kept_sha256", "sha256").alias("kept_sha256"))
    return rows.join(found, "node", "left").select("row.*", got.alias(into))
