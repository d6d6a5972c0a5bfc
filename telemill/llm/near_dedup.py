"""MinHash near-deduplication of whole texts.

Every distinct text gets a BagMinHash signature of its word shingles and one
bucket key for each band.  Texts that share a bucket are candidates; a candidate
counts once the overlap of the shingle multisets themselves is large enough.
Classes are the connected components of these links.

No step emits all pairs of a bucket.  First each text is held against the most
central text of its buckets (twice), which joins groups of copies into stars.
What then remains in a bucket are texts of different components; blocks of them
are compared by matrix products inside a task, which gives out a spanning
forest of the links it finds.  So no link between texts that share a bucket is
lost, and rows stay linear in the number of texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from telemill.llm.bagminhash import bands, overlaps, shingles, signatures, similar, weighted
from telemill.llm.store import bucketed, dropped, written
from telemill.llm.text import slices, text_buffers, words_of

SIMILARITY = 0.8
BLOCK = 256  # texts of a bucket that are compared at once
BLOCK_BYTES = 8 << 20  # of text in a block (a longer text stands alone)
SALTS = 32  # tasks over which the texts that are held against one central text are dealt
_SLICE = 1 << 20


def _node():
    """A text's name: 128 bits of its digest; null texts count as empty."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("node")


def _unseen(batch: pa.RecordBatch, seen: set[bytes]) -> pa.RecordBatch:
    """Rows of texts that the task has not met, so that copies are few before any shuffle."""
    new = []
    for k, x in enumerate(batch.column("node").to_pylist()):
        if x not in seen:
            seen.add(x)
            new.append(k)
    return batch.take(pa.array(new, pa.int64()))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(_node(), F.coalesce("text", F.lit("")).alias("text"))


def _once(docs: DataFrame) -> DataFrame:
    """(node, text): each text once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            yield _unseen(batch, seen)

    return _named(docs).mapInArrow(run, "node binary, text string")


def _bucket_rows(docs: DataFrame) -> DataFrame:
    """(bucket, node): the band keys of every text, each text once a task; texts without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            few = _unseen(batch, seen)
            data, offsets = text_buffers(few.column("text"))
            for i, j in slices(offsets, _SLICE):
                hashes, bounds = shingles(words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                keys = bands(signatures(*weighted(hashes, bounds), j - i))
                some = np.flatnonzero(np.diff(bounds) > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[some].reshape(-1)), few.column("node").slice(i, j - i).take(pa.array(np.repeat(some, keys.shape[1])))], names=["bucket", "node"]
                )

    return _named(docs).mapInArrow(run, "bucket long, node binary")


def _overlap(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs that carry both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.concat_arrays([batch.column("text_a"), batch.column("text_b")]) if batch.num_rows else batch.column("text_a")
            order = pa.array(np.arange(2 * batch.num_rows).reshape(2, -1).T.reshape(-1))
            data, offsets = text_buffers(both.take(order))
            got = np.zeros(batch.num_rows)
            for i, j in slices(offsets[::2], 2 * _SLICE):
                got[i:j] = overlaps(data[offsets[2 * i] : offsets[2 * j]], offsets[2 * i : 2 * j + 1] - offsets[2 * i])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(got)], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, similarity double")


def _marked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges``, written, and their number and sum of hashes, taken while they are written."""
    seen = Observation()
    out = written(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "star")
    return out, (seen.get.get("n"), seen.get.get("sum"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that ``edges`` (a, b) name; the root is the least node of its component.

    Large and small stars in turn until nothing changes; every round is written
    to the shared folder, none is collected.  Edges that are stars around the
    least node take one round.
    """
    cur, state = _marked(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct())
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(small, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new, mark = _marked(step.where(F.col("a") != F.col("b")).distinct())
        dropped(cur)
        cur = new
        if mark == state:
            out = written(cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
            dropped(cur)
            return out
        state = mark


def _pointed(links: DataFrame) -> DataFrame:
    """(node, root): where each text's link of the first round leads in at most four steps.

    There a text has one link at most, to a more central one, so no steps go in a
    circle.  Longer chains get several roots, which costs comparisons, not links.
    """
    up = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(2):
        up = up.join(up.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return up


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _star(rows: DataFrame, texts: DataFrame, tried: DataFrame | None) -> DataFrame:
    """(a, b, similarity) of each text with the most central text of its buckets that is of another component."""
    top = rows.groupBy("bucket").agg(F.max(F.struct("degree", "node", "root")).alias("top"))
    pairs = rows.join(top, "bucket").where(F.col("root") != F.col("top.root")).groupBy("node").agg(F.max("top").alias("top")).select(F.col("node").alias("a"), F.col("top.node").alias("b"))
    if tried is not None:
        pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
    pairs = written(pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS))), "star-asked")
    # a central text may be that of a third of all rows: each salt gets a copy of it and its share of the others
    central = pairs.select("b", "salt").distinct().join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    out = written(_overlap(pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(central, ["b", "salt"])), "star-pairs")
    dropped(pairs)
    return out


def _blocks(rows: DataFrame, texts: DataFrame, least: float, block: int) -> DataFrame:
    """(a, b) links between texts of one bucket and of different components: a spanning forest for each pair of blocks."""
    rows = rows.join(texts.select("node", F.octet_length("text").cast("long").alias("bytes")), "node")
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "root", "bytes")).alias("main"))
    # the largest component of a bucket needs no comparison inside itself; its texts and the others get blocks of their own
    rows = rows.drop("bytes").join(sizes, "bucket").withColumn("is_main", F.col("root") == F.col("main.root"))
    count = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_BYTES))
    k_main, k_rest = count(F.col("main.n"), F.col("main.bytes")), count(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes"))
    spot = F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), k_main).otherwise(k_rest))
    rows = rows.withColumn("at", F.when(F.col("is_main"), -1 - spot).otherwise(spot))
    rest = F.sequence(F.lit(0).cast("long"), k_rest - 1)
    main = F.sequence(-k_main, F.lit(-1).cast("long"))
    partners = F.when(F.col("is_main"), rest).otherwise(F.concat(main, rest))
    rows = rows.select("bucket", "node", "root", "at", F.explode(partners).alias("with")).select("bucket", "node", "root", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), (F.col("at") == F.least("at", "with")).alias("left"))
    packed = rows.join(texts.select("node", "text"), "node")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        data, offsets = text_buffers(pa.array(pdf["text"], pa.string()))
        hashes, bounds = shingles(words_of(data, offsets))
        docs = [np.sort(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        side = pdf["left"].to_numpy()
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            left = right = np.arange(len(pdf))
        roots, parent, out = pdf["root"].tolist(), {}, []

        def find(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for a, b in similar(docs, left, right, least):
            x, y = find(roots[a]), find(roots[b])
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((pdf["node"].iloc[a], pdf["node"].iloc[b]))
        return pd.DataFrame(out, columns=["a", "b"])

    return packed.groupBy("bucket", "i", "j").applyInPandas(links, "a binary, b binary")


def classes(docs: DataFrame, least: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(node, root) for every distinct text that is near another one: the component of its links.

    docs: text; a text's node is the binary MD5 digest (null counts as empty).
    Texts that differ only in case or marks have equal words and are linked;
    texts of fewer than five words are one shingle; texts without words have no
    link.  Texts that nothing is near are left out: each is a class of its own.
    """
    every = written(_bucket_rows(docs), "buckets")
    shared = every.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.approx_count_distinct("node", 0.2).alias("size")).where(F.col("least") != F.col("most"))
    rows = every.join(shared.select("bucket", "size"), "bucket").distinct()
    degree = rows.groupBy("node").agg(F.sum("size").alias("degree"))
    rows = written(rows.select("bucket", "node").join(degree, "node"), "shared-buckets")
    dropped(every)
    texts = bucketed(_once(docs).join(rows.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "near_texts", "node")
    near = lambda pairs: pairs.where(F.col("similarity") >= least).select("a", "b")
    seen = first = _star(rows.withColumn("root", F.col("node")), texts, None)
    labels = written(_pointed(near(first)), "labels")
    live = written(_open(_labelled(rows, labels)), "open-buckets")
    second = None if live.isEmpty() else _star(live, texts, first)
    dropped(live, labels)
    if second is not None:
        seen = first.unionByName(second)
    roots = components(near(seen))
    live = written(_open(_labelled(rows, roots)), "open-buckets")
    if not live.isEmpty():
        # buckets that hold the same texts are compared once, and buckets of two texts that were held against each other not again
        sets = live.groupBy("bucket").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n"), F.min("node").alias("x"), F.max("node").alias("y"))
        sets = sets.groupBy("sum", "n", "x", "y").agg(F.min("bucket").alias("bucket"))
        known = seen.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.lit(2).cast("long").alias("n"))
        todo = sets.join(known, ["x", "y", "n"], "left_anti").select("bucket")
        more = written(_blocks(live.join(todo, "bucket", "left_semi").select("bucket", "node", "root"), texts, least, block), "block-links")
        if not more.isEmpty():
            before, roots = roots, components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
            dropped(before)
        dropped(more)
    dropped(rows, texts, live, first, *([] if second is None else [second]))
    return roots


def _open(rows: DataFrame) -> DataFrame:
    """Rows of the buckets that hold texts of more than one component."""
    several = rows.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi")).select("bucket")
    return rows.join(several, "bucket", "left_semi")


def classify(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id and class_id, the least doc_id of its class (a null one only if all are null).

    Equal texts share a class, null and empty ones together.  Rows with the
    same doc_id are documents of their own; doc_id is a number.  A very long
    text is hashed in one task and compared whole.  No rows: no rows.
    """
    found = classes(docs, least)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node()).join(found, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    first = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return rows.join(first, "root").select("doc_id", "class_id")


def deduplicate(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class: the one of the least doc_id (of rows equal in that, the least text).

    Of rows that are equal in doc_id and text, but not in other columns, the
    one whose digest is least stays.  Columns of any name stay as they are.
    """
    found = classes(docs, least)
    rows = docs.select("doc_id", _node()).join(found, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    # of each text and id one row, with how often it is there
    each = rows.groupBy("root", "doc_id", "node").agg(F.count("*").alias("n"))
    kept = written(each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "n")).alias("of")).select("of.*"), "kept")
    dropped(found)
    columns = docs.columns
    mark = docs.select(F.struct(*[docs[c] for c in columns]).alias("of"), _node(), docs["doc_id"].alias("id")).join(
        kept.select("node", F.col("doc_id").alias("kept_id"), "n").alias("k"), ["node"]
    ).where(F.col("id").eqNullSafe(F.col("kept_id")))
    again = mark.where(F.col("n") > 1).groupBy("node").agg(F.min_by("of", F.sha2(F.to_json("of"), 256)).alias("of"))
    return mark.where(F.col("n") == 1).select("of.*").unionByName(again.select("of.*"))
