import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from pyspark.sql import functions as F
from telemill.llm import vector_codes
from telemill.llm.queries import QUERIES, table
from telemill.llm.vector_codes import MOST, Gnat, compress, digest, quantised, root
from tests.llm.conftest import SMALL


def brute(rows, parts=8, entries=16, rounds=6):
    """{(vec_id, code): [error, label_error]...} and the codebooks' digest, by Python integers."""
    good = [(i, v, la) for i, v, la in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    if not good or len(good[0][1]) % parts:
        return [], hashlib.sha256(b"").hexdigest()
    dims = len(good[0][1])
    good = [(i, [math.floor(Fraction(x) * 4096) for x in v], la) for i, v, la in good if len(v) == dims]
    w = dims // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    vectors = [cut(v) for _, v, _ in good]
    books = [[v[p] for v in vectors[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            homes = [near(v[p], books[p])[1] for v in vectors]
            books[p] = [[sum(c) // homes.count(k) for c in zip(*(v[p] for v, h in zip(vectors, homes) if h == k))] if k in homes else e for k, e in enumerate(books[p])]
    out, labels = [], {}
    for (i, _, la), v in zip(good, vectors):
        got = [near(x, b) for x, b in zip(v, books)]
        error = min(sum(d for d, _ in got), MOST)
        labels[la] = labels.get(la, 0) + error
        out.append([i, la, "".join(f"{k:02x}" for _, k in got), error])
    text = ",".join(str(x) for b in books for e in b for x in e)
    return sorted(([i, code, error, min(labels[la], MOST)] for i, la, code, error in out), key=str), hashlib.sha256(text.encode()).hexdigest()


def by_operator(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"code": F.lit("x"), "key": F.lit(1)})
    coded, books = compress(df.repartition(3), **options)
    return sorted(([r.vec_id, r.code, r.error, r.label_error] for r in coded.collect()), key=str), digest(books)


@pytest.mark.parametrize("seed", range(30))
def test_gnat_is_a_full_search(seed):
    """Also with equal entries, ties between entries, and numbers beyond 64 bits."""
    r = np.random.default_rng(seed)
    top = [3, 40, 1000, 10**6][seed % 4]
    entries = r.integers(-top, top + 1, (r.integers(1, 60), 4))
    queries = r.integers(-top, top + 1, (300, 4))
    if seed % 5 == 4:
        entries, queries = entries.astype(object) * 10**15, queries.astype(object) * 10**15
    tree = Gnat(entries, int(r.integers(2, 6)))
    index, error = tree.nearest(queries)
    for q, k, e in zip(queries, index, error):
        apart = [sum(int(x) ** 2 for x in q - p) for p in entries]
        assert (e, k) == (min(apart), apart.index(min(apart)))


def test_gnat_rules_out_subtrees():
    r = np.random.default_rng(5)
    entries = np.concatenate([r.integers(-50, 50, (16, 8)) + 5000 * k for k in range(8)])
    tree = Gnat(entries)
    tree.nearest(r.integers(-50, 50, (100, 8)))
    assert tree.compared < 0.5 * 100 * len(entries)


def test_roots():
    x = np.array([0, 1, 2, 3, 4, (1 << 31) ** 2 - 1, (1 << 31) ** 2, (1 << 61) + 1], dtype=np.int64)
    for values in (x, x.astype(object)):
        assert list(root(values, up=False)) == [math.isqrt(int(v)) for v in x]
        assert list(root(values, up=True)) == [math.isqrt(int(v) - 1) + 1 if v else 0 for v in x]


def test_floors_go_down():
    assert list(quantised(np.array([-1e-9, 0.0, 1 / 4096, -1.5 / 4096]))) == [-1, 0, 1, -2]


def vectors(seed, n, dims, scale=1.0):
    r = random.Random(seed)
    return [(i, [float(np.float32(r.choice([-1, 1]) * r.random() * scale)) for _ in range(dims)], r.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e30])
def test_against_brute_force(spark, scale):
    rows = vectors(1, 60, 16, scale)
    r = random.Random(2)
    r.shuffle(rows)
    rows += [(5, rows[0][1], 1), (5, rows[0][1], 1), (None, rows[1][1], None), (100, None, 1), (101, [], 1), (102, [None] * 16, 1), (103, [float("nan")] + [0.0] * 15, 1), (104, [float("-inf")] + [0.0] * 15, 1), (105, [1.0] * 8, 1)]
    assert by_operator(spark, rows) == brute(rows)


def test_few_vectors_and_options(spark):
    rows = vectors(3, 5, 8)
    assert by_operator(spark, rows) == brute(rows)
    rows = vectors(4, 40, 12)
    assert by_operator(spark, rows, parts=3, entries=4, rounds=2) == brute(rows, 3, 4, 2)


def test_doubles_of_any_size(spark):
    rows = [(k, [x] * 8, 1) for k, x in enumerate([1e300, -1e300, 1e299, 5e-324, 0.1])]
    got, name = by_operator(spark, rows, "double", entries=2)
    assert (got, name) == brute(rows, entries=2)


def test_no_rows(spark):
    nothing = ([], hashlib.sha256(b"").hexdigest())
    assert by_operator(spark, []) == nothing
    assert by_operator(spark, [(1, [0.0] * 7, 1), (2, [0.0] * 8, 1)]) == nothing
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), entries=257)


def test_query_on_small_tables(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SMALL, "embeddings").limit(60).collect()]
    got, name = by_operator(spark, rows)
    assert (got, name) == brute(rows)
    assert QUERIES["op12_vector_codes"](spark, SMALL).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_label_salts_are_few_rows():
    assert vector_codes.LABEL_SALTS <= 64
