import math
import re
from collections import Counter

import numpy as np
import pytest

from telemill.llm import language_model as lm
from telemill.llm.elias_fano import Sequence, Trie, encode

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
TOKEN = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, order):
    toks = [(i, [*TOKEN.findall((t or "").translate(LOWER)), None], h) for i, t, h in rows]
    train = [w for _, w, h in toks if not h]
    c1 = Counter(x for w in train for x in w)
    n, v = sum(c1.values()), len(c1)
    counts = {k: Counter(tuple((["<s>"] * (k - 1) + w)[i : i + k]) for w in train for i in range(len(w))) for k in range(2, order + 1)}
    of = {k: Counter() for k in counts}
    kinds = {k: Counter() for k in counts}
    for k, c in counts.items():
        for g, m in c.items():
            of[k][g[:-1]] += m
            kinds[k][g[:-1]] += 1
    out = []
    for i, w, h in toks:
        alone = full = base = 0.0
        for j, x in enumerate(w):
            base += math.log10((c1[x] + 1) / (n + v + 1))
            p = ((c1[x] - 0.5) / n if c1[x] else 0.5 * v / n) if n else 1.0
            alone += math.log10(p)
            for k in counts:
                g = tuple((["<s>"] * (k - 1) + w)[j : j + k])
                d = {2: 0.75}.get(k, 0.5)
                if of[k][g[:-1]]:
                    p = (max(counts[k][g] - d, 0) + d * kinds[k][g[:-1]] * p) / of[k][g[:-1]]
            full += math.log10(p)
        top = max(alone, full)
        out.append((i, bool(h), len(w), sum(c1[x] > 0 for x in w), n, base, top + math.log10(0.5 * 10 ** (alone - top) + 0.5 * 10 ** (full - top))))
    return sorted(out)


ROWS = [(1, "a b c A b d", False), (2, "a b x y", True), (3, None, False), (4, "", True), (5, "the cat the dog the cat sat", False), (6, "zz zz zz", False), (7, "zz q zz", True), (7, "a b c A b d", True), (8, "the é cat\tsat\x0bdown " * 50, None)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
@pytest.mark.parametrize("block_bytes", [1, 30, 1 << 20])
def test_scores_equal_brute_force(spark, monkeypatch, order, block_bytes):
    monkeypatch.setattr(lm, "HOT", 3)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, held boolean").repartition(2)
    got = sorted(tuple(r) for r in lm.score(docs, "held", order=order, block_bytes=block_bytes, shard_ngrams=5).collect())
    for a, b in zip(got, brute(ROWS, order), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-9 and abs(a[6] - b[6]) < 1e-3 * a[2]


def test_no_rows_and_no_training(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, held boolean")
    assert lm.score(docs.limit(0), "held").count() == 0
    got = lm.score(docs.where("held"), "held").collect()
    assert all(r.score == r.base_score == 0 and r.n_known == 0 for r in got)


def test_sequences_and_tries():
    r = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 5), (500, 40), (500, 10**9)):
        v = np.sort(r.integers(0, top, n)).astype(np.int64)
        s = Sequence(encode(v))
        q = np.concatenate([r.integers(0, top + 9, 300), v[:50]])
        at, same = s.successor(q)
        assert (s.access(np.arange(n)) == v).all() and (at == np.searchsorted(v, q)).all() and (same == np.isin(q, v)).all()
    v = np.sort(r.integers(0, 10**9, 5000))
    assert len(encode(v)) < 0.5 * v.nbytes  # 18 or so bits of each stay low, 2 or 3 go into the unary part
    keys = np.unique(r.integers(0, 20, (900, 3)), axis=0)
    ask = r.integers(0, 22, (2000, 3))
    at = {tuple(x): i for i, x in enumerate(keys.tolist())}
    trie = Trie(keys)
    base, begin, end = trie.find(ask[:, :2])
    node, same = trie.ids[-1].successor(base + ask[:, 2])
    got = np.where(same & (node >= begin) & (node < end), node, -1)
    assert got.tolist() == [at.get(tuple(x), -1) for x in ask.tolist()]


def test_pack():
    for kind in (np.uint8, np.uint16, np.uint32, np.uint64):
        x = np.arange(1000).astype(kind)
        assert (lm.unpack(lm.pack(x)) == x).all() and len(lm.unpack(lm.pack(x[:0]))) == 0
