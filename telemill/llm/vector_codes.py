"""Product quantisation of integer vectors; nearest entries are found by a GNAT.

Vectors become integers, ``floor(4096 x)``, and are cut into equal parts.  Each
part position has a codebook, which starts as that part of the first kept
vectors and moves to the floored mean of its parts in a fixed number of rounds.
All arithmetic is on integers: 64 bits where they suffice, else Python's.

A GNAT (geometric near-neighbour access tree) over the entries keeps at each node
some split points and, for each pair of a split point and a child, the least and
the greatest distance from the point to the child's entries.  A query's distance
to a split point then rules out whole children.  Distances are rounded outwards
(lower bounds down, upper bounds and the query's radius up) and a child goes only
if all its entries are strictly farther than the best one, so that ties, which
are told by the integers, go to the lower index as in a full search.

Rows whose vector is null, empty, holds null or non-finite components, or has
another length than the first one's (the least vec_id's), are dropped.  Without
a length that the number of parts divides there are no rows.  Rows of equal ids
are each coded; null ids come last among the first vectors.  Fewer vectors than
entries make a smaller codebook.  An error above 2**63 - 1 is given as that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.store import written

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
DEGREE = 4
LABEL_SALTS = 16
MOST = (1 << 63) - 1


def quantised(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE x) of finite numbers, as int64 or, where one does not fit, as Python integers."""
    if len(flat) and float(np.abs(flat).max()) >= 2.0**50:
        return np.array([math.floor(Fraction(float(x)) * SCALE) for x in flat], dtype=object)
    return np.floor(flat.astype(np.float64) * SCALE).astype(np.int64)


def _exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as they are, if squared distances between their rows fit 62 bits, else as Python integers."""
    if a.dtype != object and b.dtype != object:
        top = max((int(np.abs(x).max()) for x in (a, b) if x.size), default=0)
        if 4 * top * top * max(1, a.shape[-1]) < 1 << 62:
            return a, b
    return a.astype(object), b.astype(object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of ``a`` and of ``b``."""
    a, b = _exact(a, b)
    out = np.zeros((len(a), len(b)), dtype=a.dtype)
    for k in range(a.shape[1]):
        step = a[:, k, None] - b[None, :, k]
        out += step * step
    return out


def root(x: np.ndarray, up: bool) -> np.ndarray:
    """Integer square root, rounded down or up."""
    if x.dtype == object:
        low = np.array([math.isqrt(v) for v in x.reshape(-1)], dtype=object).reshape(x.shape)
    else:
        low = np.sqrt(x.astype(np.float64)).astype(np.int64)
        low -= low * low > x
        low += (low + 1) * (low + 1) <= x
    return low + (low * low < x) if up else low


@dataclass
class _Node:
    split: np.ndarray  # entries that the node's split points are
    low: np.ndarray = None  # low[i, j]: least distance from split point i to the entries of child j, rounded down
    high: np.ndarray = None
    children: list[_Node | None] = field(default_factory=list)


class Gnat:
    """Nearest of ``entries`` (rows of integers) for many queries; ties go to the lower index."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE):
        self.entries, self.degree = entries, degree
        self.between = squared(entries, entries)
        self.top = self._node(np.arange(len(entries)))
        self.compared = 0

    def _node(self, members: np.ndarray) -> _Node:
        """Split points far from each other; every other entry goes to the nearest one's child."""
        if len(members) <= self.degree:
            return _Node(members)
        chosen = [0]
        near = self.between[members[0], members].copy()
        while len(chosen) < self.degree:
            near[chosen] = -1
            chosen.append(int(np.argmax(near)))
            near = np.minimum(near, self.between[members[chosen[-1]], members])
        split, rest = members[chosen], np.delete(members, chosen)
        home = np.argmin(self.between[np.ix_(rest, split)], axis=1)
        node = _Node(split, np.zeros((len(split), len(split)), dtype=self.between.dtype), np.zeros((len(split), len(split)), dtype=self.between.dtype))
        for j in range(len(split)):
            child = rest[home == j]
            node.children.append(self._node(child) if len(child) else None)
            if len(child):
                apart = self.between[np.ix_(split, child)]
                node.low[:, j], node.high[:, j] = root(apart.min(axis=1), up=False), root(apart.max(axis=1), up=True)
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) for each row of ``queries``."""
        best = np.full(len(queries), -1, dtype=np.int64)
        error = np.zeros(len(queries), dtype=_exact(queries, self.entries)[0].dtype)
        self._visit(self.top, queries, np.arange(len(queries)), best, error)
        return best, error

    def _visit(self, node: _Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, error: np.ndarray) -> None:
        apart = squared(queries[rows], self.entries[node.split])
        self.compared += apart.size
        for i, entry in enumerate(node.split):
            got = apart[:, i]
            nearer = (best[rows] < 0) | (got < error[rows]) | ((got == error[rows]) & (entry < best[rows]))
            best[rows[nearer]], error[rows[nearer]] = entry, got[nearer]
        if not node.children:
            return
        floor, ceiling = root(apart, up=False), root(apart, up=True)
        for j, child in enumerate(node.children):
            if child is None:
                continue
            radius = root(error[rows], up=True)
            far = ((floor - node.high[None, :, j] > radius[:, None]) | (node.low[None, :, j] - ceiling > radius[:, None])).any(axis=1)
            if not far.all():
                self._visit(child, queries, rows[~far], best, error)


def _finite(vector: str):
    """Whether the vector is there and all of its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))), F.lit(False))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return quantised(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, dims)


def _trees(books: list[np.ndarray]) -> list[Gnat]:
    return [Gnat(b) for b in books]


def _limbs(x: int) -> list[int]:
    """``x`` by powers of 2**32, the last one signed; sums of limbs fit 64 bits."""
    out = []
    while not -(1 << 31) <= x < 1 << 31:
        out.append(x & 0xFFFFFFFF)
        x >>= 32
    return [*out, x]


def _sums(kept: DataFrame, vector: str, books: list[np.ndarray], dims: int) -> dict[tuple[int, int], tuple[list[int], int]]:
    """Sum and number of the parts nearest to each (part, entry); a task gives one row for each of its components."""
    width = dims // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books)
        total = [[[0] * width for _ in b] for b in books]
        count = [[0] * len(b) for b in books]
        for batch in batches:
            rows = _matrix(batch.column(0), dims)
            for part, tree in enumerate(trees):
                piece = rows[:, part * width : (part + 1) * width]
                index, _ = tree.nearest(piece)
                for entry in np.unique(index).tolist():
                    mine = piece[index == entry]
                    wide = mine.dtype == object or int(np.abs(mine).max()) * len(mine) >= 1 << 62
                    for k, x in enumerate((mine.astype(object) if wide else mine).sum(axis=0)):
                        total[part][entry][k] += int(x)
                    count[part][entry] += len(mine)
        found = [(p, e, k, limb, x, n) for p, row in enumerate(count) for e, n in enumerate(row) if n for k in range(width) for limb, x in enumerate(_limbs(total[p][e][k]))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(6)], names=["part", "entry", "at", "limb", "x", "n"])

    rows = kept.select(vector).mapInArrow(run, "part long, entry long, at long, limb long, x long, n long")
    out: dict[tuple[int, int], tuple[list[int], int]] = {}
    for r in rows.groupBy("part", "entry", "at", "limb").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        total, n = out.setdefault((r.part, r.entry), ([0] * width, 0))
        total[r.at] += r.x << (32 * r.limb)
        out[r.part, r.entry] = (total, n + (r.n if r.at == r.limb == 0 else 0))
    return out


def codebooks(kept: DataFrame, vector: str, key: str, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The final entries of each part position; no entries where there is no vector."""
    first = kept.orderBy(F.col(key).asc_nulls_last(), vector).limit(entries).select(vector).collect()
    if not first:
        return []
    dims = len(first[0][0])
    start = quantised(np.array([x for r in first for x in r[0]], dtype=np.float64)).reshape(-1, dims)
    width = dims // parts
    books = [start[:, p * width : (p + 1) * width] for p in range(parts)]
    for _ in range(rounds):
        moved = [b.astype(object) for b in books]
        for (part, entry), (total, n) in _sums(kept, vector, books, dims).items():
            moved[part][entry] = [x // n for x in total]
        books = [b.astype(np.int64) if not b.size or max(abs(x) for x in b.reshape(-1).tolist()) < 1 << 62 else b for b in moved]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.reshape(-1)).encode()).hexdigest()


def compress(rows: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(coded, codebooks): ``coded`` has ``key``, ``label``, ``code`` (two hex digits a part), ``error`` and ``label_error``.

    ``entries`` is 256 at most.  The driver holds codebooks only.  Each round reads
    the vectors once; the codes are written, as label sums and rows both come from them.
    """
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits, so that a codebook has 1 to 256 entries")
    named = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    finite = named.where(_finite("vector") & (F.size("vector") > 0))
    first = finite.orderBy(F.col("key").asc_nulls_last(), "vector").limit(1).select(F.size("vector").alias("n")).first()
    dims = first.n if first and first.n % parts == 0 else 0
    kept = finite.where(F.size("vector") == dims)
    books = codebooks(kept, "vector", "key", parts, entries, rounds) if dims else []
    width = dims // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _trees(books)
        for batch in batches:
            matrix = _matrix(batch.column("vector"), dims)
            code, error = np.zeros((len(matrix), parts), dtype=np.uint8), np.zeros(len(matrix), dtype=object)
            for part, tree in enumerate(trees):
                code[:, part], e = tree.nearest(matrix[:, part * width : (part + 1) * width])
                error += e
            text = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array([text[2 * parts * i : 2 * parts * (i + 1)] for i in range(len(matrix))], pa.string()), pa.array([min(int(e), MOST) for e in error], pa.int64())],
                names=["key", "label", "code", "error"],
            )

    kinds = {n: t for n, t in named.dtypes}
    coded = written(kept.mapInArrow(run, f"key {kinds['key']}, label {kinds['label']}, code string, error long"), "vector-codes")
    total = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long").alias("label_error"))
    # a label may hold a third of the rows: they are dealt over salts, which the few label rows are copied for
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("key", "code"), F.lit(LABEL_SALTS)))
    copies = total.select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LABEL_SALTS - 1).cast("long"))).alias("copy"))
    joined = salted.join(copies, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("copy")))
    return joined.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error"), books
