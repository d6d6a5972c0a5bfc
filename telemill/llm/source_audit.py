"""How far sources of one language differ in the words that they use.

Single-pass in-memory indexing: every task reads its documents once and keeps
postings (language, source, term: occurrences and documents) in memory.  When
they fill ``RUN_BYTES``, a run sorted by term is spilled: it leaves the task as
rows, and Spark deals runs to hash shards of (language, term) and merges them in
order.  One streaming pass over a shard adds up equal postings into frequencies
and drops terms of fewer than ``LEAST`` documents of their language.

Each group (language, source) gives each kept term a smoothed, integer
probability p, terms that it lacks included.  Two groups differ by the sum of
f(p, q) = floor((p - q)**2 / (p + q)) over all kept terms.  Most terms are in few
sources, so that the sum is taken in parts: f of a source's terms against the
other's smallest p comes from how many terms have each count, and only terms
that both have bring a correction, which is streamed off the shards.

Nulls of text, lang and source are empty strings; equal rows count each; groups
without terms are there, with the smallest p throughout.  A language without kept
terms has value 0 for all pairs.  An empty table gives no rows.  Texts are read
whole.  Other columns are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.llm.store import dropped, written
from telemill.llm.text import FOLD, byte_class, slices, text_buffers, words_of

LEAST = 10  # documents of a language that a kept term is in
TOP = 10  # ranks of the terms of a group
UNIT = 1_000_000_000
RUN_BYTES = 48 << 20  # of postings that a task holds before it spills them
PAIR_ROWS = 1 << 20  # pairs of sources whose corrections a task holds
SALTS = 32
_SLICE = 2 << 20
#: ASCII letters and every byte above 0x7F.
LETTER = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the bytes of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _told_apart(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): words sorted by hash and text, and which differ from the one before; equal hashes of unequal words are told apart by their bytes."""
    order = np.argsort(hashes, kind="stable")
    a, b = order[:-1], order[1:]
    same = (hashes[a] == hashes[b]) & (sizes[a] == sizes[b])
    some = np.flatnonzero(same)
    wrong = FOLD[data[_flat(starts[a[some]], sizes[a[some]])]] != FOLD[data[_flat(starts[b[some]], sizes[b[some]])]]
    lied = (hashes[a] == hashes[b]) & ~same
    if wrong.any() or lied.any():
        words = [FOLD[data[i : i + n]].tobytes() for i, n in zip(starts, sizes)]
        order = np.array(sorted(range(len(words)), key=lambda k: (words[k], k)), dtype=np.int64)
        return order, np.array([True] + [words[p] != words[q] for p, q in zip(order[:-1], order[1:])])
    return order, np.append(True, ~same)


def postings(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of a slice of texts."""
    words = words_of(data, offsets, LETTER)
    sizes = words.ends - words.starts
    if not len(sizes):
        none = np.zeros(0, dtype=np.int64)
        return pa.array([], pa.binary()), none, none, none
    order, new = _told_apart(data, words.starts, sizes, words.hashes)
    text = np.repeat(np.arange(len(offsets) - 1), words.counts())[order]  # ascending inside a word, as the sort is stable
    kind = np.cumsum(new) - 1
    first = np.flatnonzero(new | np.append(True, text[1:] != text[:-1]))  # of each (word, text)
    n = np.diff(np.append(first, len(order)))
    key = kind[first] * (int(group.max()) + 1) + group[text[first]]
    names, inverse = np.unique(key, return_inverse=True)
    occurrences, documents = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=np.int64)
    np.add.at(occurrences, inverse, n)
    np.add.at(documents, inverse, 1)
    one = order[new]
    ends = np.cumsum(sizes[one])
    body = FOLD[data[_flat(words.starts[one], sizes[one])]]
    terms = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(body)])
    own = names // (int(group.max()) + 1)
    return terms.take(pa.array(own)), names % (int(group.max()) + 1), occurrences, documents


def _run_rows(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, docs): the runs of all tasks, each sorted by language and term."""
    names, kinds = ["lang", "term", "source"], "lang string, term binary, source string, n long, docs long"

    def added(parts: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(parts).group_by(names, use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return table.rename_columns([*names, "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            both = [batch.column(c).cast(pa.string()).dictionary_encode() for c in ("lang", "source")]
            lang, source = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in both)
            many = len(both[1].dictionary)
            for i, j in slices(offsets, _SLICE):
                terms, group, n, docs = postings(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], (lang * many + source)[i:j])
                held.append(pa.table([both[0].dictionary.take(pa.array(group // many)), terms, both[1].dictionary.take(pa.array(group % many)), pa.array(n), pa.array(docs)], names=[*names, "n", "docs"]))
                if len(held) >= 16:
                    held = [added(held)]
                    if held[0].nbytes >= RUN_BYTES:
                        yield from held.pop().sort_by([("lang", "ascending"), ("term", "ascending")]).to_batches(max_chunksize=50_000)
        if held:
            yield from added(held).sort_by([("lang", "ascending"), ("term", "ascending")]).to_batches(max_chunksize=50_000)

    return docs.mapInArrow(run, kinds)


def _starts(batch: pa.RecordBatch, *columns: str) -> np.ndarray:
    """Which rows differ from the row before in one of the columns."""
    out = np.zeros(batch.num_rows, dtype=bool)
    out[0] = True
    for c in columns:
        x = batch.column(c)
        out[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return out


def _whole(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches that do not cut a group of equal ``columns``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        cut = int(np.flatnonzero(_starts(batch, *columns))[-1])
        before = held[0].num_rows if len(held) > 1 else 0
        if cut or (before and any(held[0].column(c)[-1] != batch.column(c)[0] for c in columns)):
            held[-1] = batch.slice(0, cut)
            yield pa.Table.from_batches([x for x in held if x.num_rows]).combine_chunks().to_batches()[0]
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def frequencies(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, source, n, n_lang): occurrences of each kept term in each source that has it, and in its language.

    ``docs`` has text, lang and source without nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, "lang", "term"):
            term = np.flatnonzero(_starts(batch, "lang", "term"))
            posting = np.flatnonzero(_starts(batch, "lang", "term", "source"))
            n, found = (batch.column(c).to_numpy() for c in ("n", "docs"))
            size = np.diff(np.append(np.searchsorted(posting, term), len(posting)))
            kept = np.repeat(np.add.reduceat(found, term) >= least, size)
            rows = batch.take(pa.array(posting[kept]))
            yield pa.RecordBatch.from_arrays(
                [rows.column("lang"), rows.column("term"), rows.column("source"), pa.array(np.add.reduceat(n, posting)[kept]), pa.array(np.repeat(np.add.reduceat(n, term), size)[kept])],
                names=["lang", "term", "source", "n", "n_lang"],
            )

    shards = _run_rows(docs).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return shards.mapInArrow(run, "lang string, term binary, source string, n long, n_lang long")


def _p(n: Column, total: Column, terms: Column) -> Column:
    wide = lambda x: x.cast("decimal(18,0)")
    """The smoothed probability of a term in units of 1 / UNIT, rounded down, plus one."""
    return F.call_function("div", (wide(n) + F.lit(2)) * F.lit(UNIT), wide(total) + F.lit(2) * wide(terms)) + F.lit(1)


def difference(p: Column, q: Column) -> Column:
    """f of two probabilities of at most UNIT + 1: within 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _corrections(kept: DataFrame) -> DataFrame:
    """(lang, source, item, x): what the terms that both sources have add to the sum of their parts; ``source`` is the lesser one.

    ``kept`` has p and least_p, the p of a term that the source lacks.  A task adds
    up the pairs that it meets and gives out what it holds when there are many.
    """

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str], int] = {}

        def out() -> pa.RecordBatch:
            columns = [list(x) for x in zip(*held)] if held else [[], [], []]
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in columns), pa.array(list(held.values()), pa.int64())], names=["lang", "source", "item", "x"])

        for batch in _whole(batches, "lang", "term"):
            first = np.append(np.flatnonzero(_starts(batch, "lang", "term")), batch.num_rows)
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            names = source.dictionary.to_pylist()
            langs = lang.dictionary.to_pylist()
            of_lang, of_source = lang.indices.to_numpy(), source.indices.to_numpy().astype(np.int64)
            p, least = batch.column("p").to_numpy(), batch.column("least_p").to_numpy()
            size = np.diff(first)
            home = np.repeat(np.arange(len(size)), size)
            for step in range(1, int(size.max())):  # rows of one term that stand ``step`` apart
                a = np.flatnonzero(home[step:] == home[:-step])
                b = a + step
                x = f(p[a], p[b]) - f(p[a], least[b]) - f(least[a], p[b]) + f(least[a], least[b])
                key = (of_lang[a].astype(np.int64) * len(names) + of_source[a]) * len(names) + of_source[b]
                found, inverse = np.unique(key, return_inverse=True)
                total = np.zeros(len(found), dtype=np.int64)
                np.add.at(total, inverse, x)
                for k, v in zip(found.tolist(), total.tolist()):
                    name = (langs[k // len(names) ** 2], names[k // len(names) % len(names)], names[k % len(names)])
                    held[name] = held.get(name, 0) + v
                if len(held) >= PAIR_ROWS:
                    yield out()
                    held.clear()
        yield out()

    rows = kept.select("lang", "term", "source", "p", "least_p").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return rows.mapInArrow(run, "lang string, source string, item string, x long").groupBy("lang", "source", "item").agg(F.sum("x").alias("x"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every group (lang, source) of ``docs``.

    Part ``pair``: each other source of the language.  Part ``term``: the ``top``
    kept terms that the group has and uses more than its language does.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    named = docs.select(blank("text"), blank("lang"), blank("source"))
    groups = written(named.select("lang", "source").distinct(), "audit-groups")
    counts = written(frequencies(named, least), "audit-counts")
    terms = counts.groupBy("lang").agg(F.countDistinct("term").alias("terms"))
    sums = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(terms, "lang", "left")
    zero = F.lit(0).cast("long")
    stats = sums.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"))
    stats = stats.withColumn("least_p", F.when(F.col("terms") > 0, _p(zero, F.col("total"), F.col("terms"))))
    stats = written(stats.join(stats.groupBy("lang").agg(F.sum("total").alias("lang_total")), "lang"), "audit-groups")
    salts = F.explode(F.sequence(zero, F.lit(SALTS - 1).cast("long"))).alias("salt")
    salt_of = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    # a group may hold a third of all postings, so its terms are dealt over salts
    kept = counts.withColumn("salt", salt_of("term")).join(stats.select("*", salts), ["lang", "source", "salt"]).drop("salt").withColumn("p", _p(F.col("n"), F.col("total"), F.col("terms")))

    # pairs: f of each source's terms against the other's least p, by count, then what terms of both correct
    own = kept.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).withColumn("salt", salt_of("source"))
    others = stats.select("lang", F.col("source").alias("item"), F.col("least_p").alias("q"), salts)
    against = own.join(others, ["lang", "salt"]).where(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(F.sum(F.col("m") * difference(F.col("p"), F.col("q"))).alias("x"), F.sum("m").alias("m"))
    every = stats.withColumn("salt", salt_of("source")).join(others, ["lang", "salt"]).where(F.col("source") != F.col("item"))
    base = every.select("lang", "source", "item", (F.col("terms") * difference(F.col("least_p"), F.col("q"))).alias("x"), F.lit(0).alias("side"))
    # V f(p0, q0) + sum over own terms (f(p, q0) - f(p0, q0)) + the same from the other side + corrections
    mine = against.join(stats.select("lang", "source", "least_p"), ["lang", "source"]).join(stats.select("lang", F.col("source").alias("item"), F.col("least_p").alias("q")), ["lang", "item"])
    gain = mine.select("lang", "source", "item", (F.col("x") - F.col("m") * difference(F.col("least_p"), F.col("q"))).alias("x"))
    both = _corrections(kept)
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "x")
    parts = base.select("lang", "source", "item", F.coalesce("x", zero).alias("x")).unionByName(gain).unionByName(turned(gain)).unionByName(both).unionByName(turned(both))
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("x").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))

    # terms: against the language, which has all of its groups' occurrences
    used = kept.withColumn("q", _p(F.col("n_lang"), F.col("lang_total"), F.col("terms"))).where("p > q")
    valued = used.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    term = valued.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = written(pair.unionByName(term), "audit")
    dropped(groups, counts, stats)
    return out
