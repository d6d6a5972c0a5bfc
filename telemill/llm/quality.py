"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The units are characters (whole Unicode code points, none folded together), in
n-grams of up to ORDER.  Tasks count the n-grams of whole trusted texts and
combine before they shuffle; the counts of every order, their contexts'
statistics and the lower orders' probabilities meet in joins that are sharded
by the n-gram or its context.  A document goes if its perplexity is above the
quantile of held-out trusted documents of its language and length; where these
are few, of beginnings of longer ones, of neighbouring lengths, or of all
languages.

Characters have few distinct n-grams (some hundred thousand of order five in a
gigabyte), so a table of up to MODEL_ROWS goes to every task, which scores
documents where they stand.  A larger model stays sharded: documents are cut
into blocks, blocks ask for their distinct n-grams in a join, and each is
scored with the rows that it got.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.llm.store import dropped, written
from telemill.llm.text import mix, slices, text_buffers

ORDER = 5
QUANTILE = 0.995  # of held-out trusted documents that stay, by language
MARGIN = 1.03  # on the perplexity at the quantile, which is estimated
HOLD_OUT = 4  # one of so many trusted documents sets thresholds, the others the model
LEAST = 100  # trusted documents that a language and length needs for a quantile of its own; with fewer, documents are pooled
SHRINK = 5  # documents of the overall level of perplexity that count into each language's
IDS_BROADCAST = 2_000_000  # trusted ids up to which each task holds them all (some 50 MB); more are joined by a shuffle
MODEL_ROWS = 4_000_000  # n-grams of all orders up to which each task holds the model (some 50 MB); a larger one is joined by blocks
BLOCK_BYTES = 16 << 20  # of text in a block
START = 0xFFFF  # stands before a text's first character; no character
STEP = 4096  # codes per power of ten of a stored probability
_SLICE = 1 << 18  # bytes of text that are counted or scored at once


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, where each text's begin) of UTF-8 texts; bytes that are none give some code point, always the same."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), offsets
    lead = (data & 0xC0) != 0x80
    lead[offsets[:-1][offsets[:-1] < len(data)]] = True
    at = np.flatnonzero(lead)
    x = data[at].astype(np.uint32)
    more = np.concatenate([data, np.zeros(3, dtype=np.uint8)])
    tail = [more[at + k].astype(np.uint32) & 0x3F for k in (1, 2, 3)]
    out = np.where(x < 0x80, x, np.where(x < 0xE0, (x & 0x1F) << 6 | tail[0], np.where(x < 0xF0, (x & 0xF) << 12 | tail[0] << 6 | tail[1], (x & 7) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2])))
    out[(out >= 0xD800) & (out < 0xE000)] = 0xFFFD
    out[(out == 0) | (out > 0x10FFFF)] = 0xFFFD
    return out.astype(np.uint32), np.concatenate([[0], np.cumsum(lead)])[offsets]


def padded(symbols: np.ndarray, bounds: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with ``order - 1`` starts before each text, where each character stands among them)."""
    n, pad = np.diff(bounds), order - 1
    where = bounds[:-1] + pad * np.arange(1, len(n) + 1)
    out = np.full(len(symbols) + pad * len(n), START, dtype=np.uint32)
    at = np.arange(len(symbols)) + np.repeat(where - bounds[:-1], n)
    out[at] = symbols
    return out, at


def keys_of(symbols: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of the ``length`` symbols that end at each place."""
    total = np.full(len(at), length, dtype=np.uint64)
    for k in range(length):
        total = (total + symbols[at - (length - 1 - k)]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(32)
    return mix(total)


def _texts(rows: np.ndarray) -> pa.Array:
    """Strings of rows of code points."""
    n, width = rows.shape
    flat = "".join(map(chr, rows.reshape(-1).tolist())) if n else ""
    return pa.array([flat[i : i + width] for i in range(0, n * width, width)], pa.string())


def ngram_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n): how often each n-gram of the highest order is in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, counts = np.zeros(0, dtype=np.uint64), np.zeros((0, order), dtype=np.uint32), np.zeros(0, dtype=np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in slices(offsets, 4 * _SLICE):
                symbols, bounds = characters(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                symbols, at = padded(symbols, bounds, order)
                new, first, n = np.unique(keys_of(symbols, at, order), return_index=True, return_counts=True)
                place = np.searchsorted(keys, new)
                there = (keys[np.minimum(place, len(keys) - 1)] == new) if len(keys) else np.zeros(len(new), dtype=bool)
                counts[place[there]] += n[there]
                first = at[first[~there]]
                added = np.stack([symbols[first - (order - 1 - k)] for k in range(order)], axis=1)
                keys, rows, counts = np.concatenate([keys, new[~there]]), np.concatenate([rows, added]), np.concatenate([counts, n[~there]])
                by = np.argsort(keys)
                keys, rows, counts = keys[by], rows[by], counts[by]
                if len(keys) > 2_000_000:
                    yield from out(rows, counts)
                    keys, rows, counts = keys[:0], rows[:0], counts[:0]
        yield from out(rows, counts)

    def out(rows: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(rows), 100_000):
            yield pa.RecordBatch.from_arrays([_texts(rows[i : i + 100_000]), pa.array(counts[i : i + 100_000])], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def model_table(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(length, gram, p, gamma): for every n-gram seen its smoothed probability, for every context what it leaves to the next lower order.

    p is null for contexts that are no n-gram (they end with a start), gamma for
    n-grams that are no context.  Below the first order stands the uniform
    distribution over the characters seen and an unknown one, whose context is
    the empty text.
    """
    top = written(ngram_counts(trusted, order), "kn-counts")
    by_order = {order: top}
    for k in range(order - 1, 0, -1):  # continuation counts: distinct characters before the n-gram
        by_order[k] = by_order[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n"))
    every = None
    for k, rows in by_order.items():
        rows = rows.select(F.lit(k).alias("length"), "gram", "n")
        every = rows if every is None else every.unionByName(rows)
    every = written(every, "kn-orders")
    tallies = every.groupBy("length").agg(F.count("*").alias("size"), *[F.count_if(F.col("n") == k).alias(f"t{k}") for k in (1, 2, 3, 4)]).collect()  # one row for each order
    cuts, units = {r.length: _discounts(r) for r in tallies}, next((r.size for r in tallies if r.length == 1), 0) + 1
    below, parts = None, []
    for k in range(1, order + 1):
        d = cuts.get(k, (0.5, 1.0, 1.0))
        cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        counts = every.where(F.col("length") == k).select("gram", "n", cut.alias("cut"), F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
        contexts = counts.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(F.least("cut", F.col("n").cast("double"))) / F.sum("n")).alias("gamma"))
        joined = counts.join(contexts, "context")
        if below is None:
            joined = joined.withColumn("lower", F.lit(1.0 / units))
        else:
            joined = joined.join(below.select(F.col("gram").alias("suffix"), F.col("p").alias("lower")), "suffix")
        p = joined.select(F.lit(k).alias("length"), "gram", (F.greatest(F.col("n") - F.col("cut"), F.lit(0.0)) / F.col("total") + F.col("gamma") * F.col("lower")).alias("p"))
        below = written(p, "kn-p")
        parts += [below.withColumn("gamma", F.lit(None).cast("double")), contexts.select(F.lit(k - 1).alias("length"), F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "gamma")]
    result = parts[0]
    for x in parts[1:]:
        result = result.unionByName(x)
    out = written(result.groupBy("length", "gram").agg(F.max("p").alias("p"), F.max("gamma").alias("gamma")), "kn-model")
    dropped(top, every)
    return out


def _discounts(t) -> tuple[float, float, float]:
    """The three discounts of an order, from how many n-grams have the counts 1 to 4."""
    n, y = [t.size, t.t1, t.t2, t.t3, t.t4], t.t1 / (t.t1 + 2 * t.t2) if t.t1 + 2 * t.t2 else 0.0
    return tuple(min(float(k), max(0.1, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] and y else min(k, 2) * 0.5 for k in (1, 2, 3))


def _code(p: np.ndarray) -> np.ndarray:
    """Stored form of probabilities above 0: their logarithm in steps; 1 is none, as 0 stands for what is not there."""
    return np.clip(np.rint(-np.log10(p) * STEP), 0, 65533).astype(np.uint16) + np.uint16(1)


class Model:
    """Rows of the table by the name of their n-gram: the codes of p and gamma, 0 for none."""

    def __init__(self, keys: np.ndarray, p: np.ndarray, gamma: np.ndarray, order: int, floor: float):
        by = np.argsort(keys)
        self.keys, self.p, self.gamma, self.order, self.floor = keys[by], p[by], gamma[by], order, floor
        # where the names with the same first bits begin, about one for each name
        self.shift = np.uint64(64 - max(8, min(26, len(keys).bit_length())))
        self.begin = np.searchsorted(self.keys, np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift).astype(np.int32)

    @classmethod
    def of_rows(cls, rows: pd.DataFrame, order: int) -> Model:
        """From rows of :func:`model_table`, all or those that a block asked for."""
        keys, p, gamma = [], [], []
        for length, own in rows.groupby("length"):
            symbols = np.frombuffer("".join(own["gram"]).encode("utf-32-le"), dtype=np.uint32)
            keys.append(keys_of(symbols, np.arange(1, len(own) + 1) * length - 1, int(length)) if length else np.zeros(len(own), dtype=np.uint64))
            for out, name in ((p, "p"), (gamma, "gamma")):
                x = own[name].to_numpy(dtype=np.float64)
                some = ~np.isnan(x) & (x > 0)
                code = np.zeros(len(x), dtype=np.uint16)
                code[some] = _code(x[some])
                out.append(code)
        none = [np.zeros(0, dtype=np.uint16)]
        units = int(((rows["length"] == 1) & rows["p"].notna()).sum()) + 1
        return cls(np.concatenate([np.zeros(0, dtype=np.uint64), *keys]), np.concatenate(none + p), np.concatenate(none + gamma), order, float(-np.log10(units)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each name, -1 for none."""
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        at = self.begin[keys >> self.shift].astype(np.int64)
        while len(open_):
            inside = at < len(self.keys)
            open_, at = open_[inside], at[inside]
            seen, want = self.keys[at], keys[open_]
            hit = seen == want
            out[open_[hit]] = at[hit]
            less = seen < want
            open_, at = open_[less], at[less] + 1
        return out

    def logs(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of the character at each place of padded symbols."""
        out, left = np.zeros(len(at)), np.arange(len(at))
        for k in range(self.order, 0, -1):
            row = self.find(keys_of(symbols, at[left], k))
            code = np.where(row >= 0, self.p[np.maximum(row, 0)], 0) if len(self.keys) else np.zeros(len(left), dtype=np.uint16)
            hit = code > 0
            out[left[hit]] -= (code[hit] - 1.0) / STEP
            left = left[~hit]
            if not len(left):
                return out
            # what the context leaves to the next lower order; one that was never seen leaves all
            row = self.find(keys_of(symbols, at[left] - 1, k - 1) if k > 1 else np.zeros(len(left), dtype=np.uint64))
            code = np.where(row >= 0, self.gamma[np.maximum(row, 0)], 0) if len(self.keys) else np.zeros(len(left), dtype=np.uint16)
            out[left] -= np.where(code > 0, code - 1.0, 0.0) / STEP
        out[left] += self.floor
        return out

    def scores(self, data: np.ndarray, offsets: np.ndarray, heads: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(units of every text, their log10 probability, on request the perplexities of each text's first 2, 4, 8 and so on units, text by text)."""
        symbols, bounds = characters(data, offsets)
        symbols, at = padded(symbols, bounds, self.order)
        total = np.concatenate([[0.0], np.cumsum(self.logs(symbols, at))])
        sums = total[bounds[1:]] - total[bounds[:-1]]
        if not heads:
            return np.diff(bounds), sums, None
        n = head_counts(np.diff(bounds))
        k = 2 ** (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1)
        start = np.repeat(bounds[:-1], n)
        return np.diff(bounds), sums, 10 ** (-(total[start + k] - total[start]) / k)


def head_counts(n_units: np.ndarray) -> np.ndarray:
    """How many of 2, 4, 8 and so on are at most each text's length."""
    return np.frexp(np.maximum(n_units, 1).astype(np.float64))[1].astype(np.int64) - 1


_VERDICT = [T.StructField("n_units", T.LongType()), T.StructField("log10_p", T.DoubleType()), T.StructField("perplexity", T.DoubleType())]
_HEADS = T.StructField("heads", T.ArrayType(T.DoubleType()))


def _scored(texts: pa.Array, model: Model, heads: bool) -> pa.StructArray:
    """n_units, log10_p, perplexity and on request heads of every text."""
    data, offsets = text_buffers(texts)
    got = [model.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], heads) for i, j in slices(offsets, _SLICE)]
    n, logs = (np.concatenate([np.zeros(0, kind), *(x[i] for x in got)]) for i, kind in ((0, np.int64), (1, np.float64)))
    with np.errstate(divide="ignore", invalid="ignore"):
        columns = [pa.array(n), pa.array(logs), pa.array(10 ** (-logs / n), mask=n == 0)]
    if heads:
        ends = np.concatenate([[0], np.cumsum(head_counts(n))]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0), *(x[2] for x in got)]))))
    return pa.StructArray.from_arrays(columns, names=[f.name for f in [*_VERDICT, *([_HEADS] if heads else [])]])


def score(docs: DataFrame, table: DataFrame, into: str, order: int = ORDER, heads: bool = False, model_rows: int = MODEL_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``into``: n_units (characters of the text), log10_p, perplexity per unit (of an empty or null text: null).

    table: rows of :func:`model_table`.  With ``heads`` the struct has the
    perplexities of the text's first 2, 4, 8 and so on units as well.  Columns
    of docs of any name but ``into`` stay as they are.
    """
    kind = T.StructField(into, T.StructType([*_VERDICT, *([_HEADS] if heads else [])]))
    schema, at = T.StructType([*docs.schema.fields, kind]), docs.columns.index("text")
    names = [f.name for f in schema.fields]

    def with_scores(batch: pa.RecordBatch, model: Model) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], _scored(batch.column(at), model, heads)], names=names)

    if table.limit(model_rows + 1).count() > model_rows:
        return _score_by_blocks(docs, table, schema, with_scores, order, block_bytes)

    def built(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"length": [], "gram": [], "p": [], "gamma": []}), *pages])
        m = Model.of_rows(rows.astype({"length": int}), order)
        yield pd.DataFrame({"keys": [m.keys.tobytes()], "p": [m.p.tobytes()], "gamma": [m.gamma.tobytes()], "floor": [m.floor]})

    r = table.repartition(1).mapInPandas(built, "keys binary, p binary, gamma binary, floor double").first()  # twelve bytes a row of at most ``model_rows``
    shared = docs.sparkSession.sparkContext.broadcast((bytes(r["keys"]), bytes(r["p"]), bytes(r["gamma"]), r["floor"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, p, gamma, floor = shared.value
        model = Model(np.frombuffer(keys, dtype=np.uint64), np.frombuffer(p, dtype=np.uint16), np.frombuffer(gamma, dtype=np.uint16), order, floor)
        for batch in batches:
            yield with_scores(batch, model)

    return docs.mapInArrow(run, schema)


def _score_by_blocks(docs: DataFrame, table: DataFrame, schema: T.StructType, with_scores, order: int, block_bytes: int) -> DataFrame:
    """:func:`score` with a model of any size: blocks of documents meet the rows of their own n-grams."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(docs.columns[at])), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // block_bytes))
    cut = written(docs.select(F.pmod(F.xxhash64(F.rand(1)), F.lit(n_blocks)).alias("block"), F.struct(*[docs[c] for c in docs.columns]).alias("of")), "kn-blocks")
    whole = T.StructType([T.StructField("block", T.LongType())])

    def ask(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for block, own in page.groupby("block"):
                symbols, at_ = padded(*characters(*text_buffers(pa.array(own["text"], pa.string()))), order)
                for k in range(order + 1):
                    rows = np.stack([symbols[at_ - (order - 1 - j)] for j in range(order)], axis=1)
                    # the n-grams that end at a character, and the contexts that end before one
                    some = np.unique(np.concatenate([rows[:, order - k :], rows[:, order - 1 - k : order - 1]]) if k < order else rows, axis=0) if k else np.zeros((1, 0), dtype=np.uint32)
                    yield pd.DataFrame({"block": block, "length": k, "gram": _texts(some).to_pandas() if k else [""]})

    asked = cut.select("block", F.col("of.text").alias("text")).mapInPandas(ask, T.StructType([*whole.fields, T.StructField("length", T.IntegerType()), T.StructField("gram", T.StringType())])).distinct()
    answers = asked.join(table, ["length", "gram"]).unionByName(asked.select("block").distinct().join(F.broadcast(table.where((F.col("length") == 1) & F.col("p").isNotNull()).agg(F.count("*").alias("n"))), F.lit(True)).select("block", F.lit(-1).alias("length"), F.lit("").alias("gram"), F.col("n").cast("double").alias("p"), F.lit(None).cast("double").alias("gamma")))

    def scored(block: pa.Table, rows: pa.Table) -> pa.Table:
        pdf = rows.select(["length", "gram", "p", "gamma"]).to_pandas()
        model = Model.of_rows(pdf[pdf["length"] >= 0], order)
        model.floor = float(-np.log10(pdf.loc[pdf["length"] < 0, "p"].iloc[0] + 1)) if (pdf["length"] < 0).any() else 0.0
        of = block.column("of").combine_chunks()
        of = of if isinstance(of, pa.StructArray) else pa.concat_arrays(of.chunks)
        batch = pa.RecordBatch.from_arrays(of.flatten(), names=[f.name for f in schema.fields[:-1]])
        return pa.Table.from_batches([with_scores(batch, model)])

    return cut.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, schema)


def band(n_units):
    """Length band: the binary logarithm of the units; short texts vary more."""
    return F.floor(F.log2(F.greatest(n_units, F.lit(1)))).cast("int")


def thresholds(trusted: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, least: int = LEAST) -> list[tuple[str | None, int, float]]:
    """(lang, band, threshold) from scored trusted documents with heads, for every language and band from 1 to the longest document's.

    A threshold is a quantile of the first of these pools with at least
    ``least`` documents: those of the language and band; beginnings of the
    band's least length of all of the language at least as long; the
    language's documents of this band or longer ones, with as many shorter
    bands as it takes; the same three over all languages, where perplexities
    are relative to their language's level; all trusted documents.  Rows of lang None are for
    languages without trusted text (a null language is '').  Without trusted text: none.
    """
    base = trusted.where(F.size("heads") > 0).select(F.coalesce("lang", F.lit("")).alias("lang"), F.size("heads").alias("band"), "perplexity", "heads")
    means = base.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.log10("perplexity")).alias("total")).collect()
    if not means:
        return []
    overall = sum(r.total for r in means) / sum(r.n for r in means)
    level = {r.lang: 10 ** ((r.total + SHRINK * overall) / (r.n + SHRINK)) for r in means}
    own_level = F.create_map(*[F.lit(x) for pair in level.items() for x in pair])[F.col("lang")]
    # (kind, band, perplexity): of its own band, of its beginnings, and of itself as one of at least a length
    whole = F.array(F.struct(F.lit("own").alias("kind"), F.col("band").alias("band"), F.col("perplexity").alias("x")))
    starts = F.transform("heads", lambda x, k: F.struct(F.lit("head").alias("kind"), (k + 1).alias("band"), x.alias("x")))
    at_least = F.transform(F.sequence(F.lit(1), F.col("band")), lambda k: F.struct(F.lit("tail").alias("kind"), k.alias("band"), F.col("perplexity").alias("x")))
    each = base.select("lang", own_level.alias("level"), F.explode(F.concat(whole, starts, at_least)).alias("c")).select("lang", "level", "c.*")
    q = lambda x: F.percentile_approx(x, quantile, 20_000)
    fine = each.groupBy("lang", "kind", "band").agg(q(F.col("x")).alias("x"), F.count("*").alias("n"))
    common = each.groupBy("kind", "band").agg(q(F.col("x") / F.col("level")).alias("x"), F.count("*").alias("n")).withColumn("lang", F.lit(None).cast("string"))
    pools = {(r.lang, r.kind, r.band): (r.x, r.n) for r in fine.unionByName(common).collect()}
    top = max(b for _, _, b in pools)

    def pooled(lang: str | None, at: int, least: int) -> float | None:
        for key in [(lang, "own", at), (lang, "head", at), *((lang, "tail", k) for k in range(at, 0, -1))]:
            if pools.get(key, (0, 0))[1] >= least:
                return pools[key][0]
        return None

    out = []
    for lang in [None, *sorted(level)]:
        for at in range(1, top + 1):
            x = None if lang is None else pooled(lang, at, least)
            if x is None:
                x = pooled(None, at, least) or pooled(None, at, min(least, pools[None, "tail", 1][1]))
                x *= 10**overall if lang is None else level[lang]
            out.append((lang, at, x * margin))
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def with_ids(rows: DataFrame, ids: DataFrame, most: int = IDS_BROADCAST) -> DataFrame:
    """Rows whose doc_id is among ``ids``; the ids are broadcast only if they are at most ``most``."""
    few = ids.limit(most + 1).count() <= most
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def verdicts(docs: DataFrame, labels: DataFrame, into: str, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, least: int = LEAST, hold_out: int = HOLD_OUT, model_rows: int = MODEL_ROWS) -> DataFrame:
    """``docs`` with a struct column ``into``: n_units, log10_p, perplexity, threshold and keep; see :func:`judge`."""
    trusted = with_ids(docs.select("doc_id", "lang", "text"), trusted_ids(labels))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(hold_out)) == 0
    table = model_table(trusted.where(~held), order)
    numbers = written(score(trusted.where(held), table, "v", order, True, model_rows).select("lang", "v.perplexity", "v.heads"), "kn-held-out")
    limit = F.lit(None).cast("double")
    each: dict[str | None, dict[int, float]] = {}
    for lang, at, value in thresholds(numbers, quantile, margin, least):  # some tens for each language
        each.setdefault(lang, {})[at] = value
    units = F.col(f"`{into}`.n_units")
    for lang, by_band in each.items():  # None comes first and holds for all others
        own = F.create_map(*[F.lit(x) for pair in by_band.items() for x in pair])[F.least(band(units), F.lit(max(by_band)))]
        limit = own if lang is None else F.when(F.coalesce("lang", F.lit("")) == lang, own).otherwise(limit)
    scored = score(docs, table, into, order, False, model_rows)
    keep = F.coalesce(F.col(f"`{into}`.perplexity") <= limit, F.lit(True))
    return scored.withColumn(into, F.struct(f"`{into}`.*", limit.alias("threshold"), keep.alias("keep")))


def judge(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``docs`` with n_units, log10_p, perplexity, threshold and keep.

    docs: doc_id, text, lang; labels: doc_id, quality (1: trusted).  A document
    stays if its perplexity is at most the threshold of its language and length
    band (see :func:`thresholds`).  One of HOLD_OUT trusted documents, by a hash
    of the doc_id, is held out of the model and sets the thresholds.  Null and
    empty texts and those of a single unit stay: there is no sequence to judge.
    Without held-out trusted text all stay.  Texts may have any length; repeated
    rows are judged each.  Columns of docs with the name of a result are left
    out; :func:`verdicts` leaves all in place.
    """
    out = verdicts(docs.drop("n_units", "log10_p", "perplexity", "threshold", "keep"), labels, "__verdict", **settings)
    return out.select(*[c for c in out.columns if c != "__verdict"], "__verdict.*")
