"""Packing: concatenate and cut.

Pass one tokenises every document once and stores its ids with the running
token count inside its partition.  A prefix sum over the partitions' totals
(one number a partition) turns these into global offsets.  Pass two cuts every
document's ids at multiples of the window; a document that crosses a cut leaves
a boundary record on either side.  No step sorts or gathers documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.store import written
from telemill.llm.tokenise import Encoder

_TOKENS = "part int, begins long, doc_id long, n long, ids binary"
_PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, boundary boolean, ids binary"


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """One row per document: its partition, the tokens before it there, and its ids (unsigned 16 or 32 bits)."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, begins = Encoder.of(tokenizer_path), TaskContext.get().partitionId(), 0
        kind = np.uint16 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                few = batch.slice(i, 1000)
                ids, bounds = encoder.encode(few.column("text").to_pylist(), end_id)
                ids = ids.astype(kind)
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(few.num_rows, part, dtype=np.int32)),
                        pa.array(begins + bounds[:-1]),
                        few.column("doc_id"),
                        pa.array(n),
                        pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary()),
                    ],
                    names=["part", "begins", "doc_id", "n", "ids"],
                )
                begins += int(bounds[-1])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tokens, _TOKENS)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents in windows of ``length`` tokens; only the last window has room left.

    docs: doc_id (a number), text; other columns are ignored.  A null or empty text is the
    end id alone.  Rows with the same doc_id are documents of their own.  An
    empty table gives no pieces.  ``ids`` holds the piece's ids, each little-endian
    unsigned 32 bits; ``boundary`` marks a piece whose document goes on in the next window.
    """
    stored = written(token_table(docs, tokenizer_path, end_id), "pack-tokens")
    totals = {r.part: r.total for r in stored.groupBy("part").agg(F.max(F.col("begins") + F.col("n")).alias("total")).collect()}  # a row for each partition
    base, at = {}, 0
    for part in sorted(totals):
        base[part] = at
        at += totals[part]
    shared = docs.sparkSession.sparkContext.broadcast(base)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, n = batch.column("part").to_numpy(), batch.column("n").to_numpy()
            first = np.array([shared.value[p] for p in part.tolist()], dtype=np.int64) + batch.column("begins").to_numpy()
            last = first + n - 1
            pieces = last // length - first // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] // length + k
            a = np.maximum(first[row], sequence * length)
            b = np.minimum(last[row] + 1, (sequence + 1) * length)
            start, size = a - first[row], b - a
            blobs = [x.as_py() for x in batch.column("ids")]
            wide = [np.frombuffer(x, dtype=np.uint16 if len(x) == 2 * m else np.uint32).astype("<u4").tobytes() for x, m in zip(blobs, n.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row)),
                    pa.array(start),
                    pa.array(size),
                    pa.array(n[row]),
                    pa.array(sequence),
                    pa.array(a - sequence * length),
                    pa.array(b < last[row] + 1),
                    pa.array([wide[r][4 * s : 4 * (s + z)] for r, s, z in zip(row.tolist(), start.tolist(), size.tolist())], pa.binary()),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "boundary", "ids"],
            )

    return stored.mapInArrow(cut, _PIECES)
