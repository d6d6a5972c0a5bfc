import random
import re
from collections import Counter

import numpy as np

from telemill.llm import bagminhash, near_dedup
from telemill.llm.text import words_of

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def bag(text):
    w = WORD.findall((text or "").translate(LOWER))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    low, high = sum((a & b).values()), sum((a | b).values())
    return low / high if high else 0.0


def brute_classes(rows, least=0.8):
    """Least id of the component of each row; equal texts are linked."""
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {i: bag(t) for i, t in rows}
    for i, s in rows:
        for j, t in rows:
            if j < i and ((s or "") == (t or "") or similarity(bags[i], bags[j]) >= least):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def corpus(seed=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([8, 60, 200]))]
        for _ in range(r.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 5])):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    return rows


def test_classes_equal_brute_force(spark, docs_of):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in near_dedup.classify(docs_of(*rows)).collect()}
    assert got == brute_classes(rows)


def test_blocks_compare_what_stars_leave(spark, docs_of):
    """A chain of texts, each near the next alone, and blocks of two."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(f"x{k}" if k < 6 * i else w for k, w in enumerate(words))) for i in range(8)]
    found = near_dedup.classes(docs_of(*rows), block=2)
    want = brute_classes(rows)
    assert found.select("root").distinct().count() == len({c for c in want.values() if list(want.values()).count(c) > 1})


def test_edge_cases(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "One two three"), (4, "one TWO, three!"), (5, "other words"), (6, "a b c d e f g " * 5000), (7, "a b c d e f g " * 5000), (7, "a b c d e f g " * 5000)]
    got = sorted((r.doc_id, r.class_id) for r in near_dedup.classify(docs_of(*rows)).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (7, 6)]
    kept = near_dedup.deduplicate(docs_of(*rows))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 5, 6] and kept.columns == docs_of(*rows).columns
    assert near_dedup.classify(docs_of((1, "x")).limit(0)).count() == 0
    assert near_dedup.deduplicate(docs_of((1, "x"), (1, "x"), (1, "y"))).count() == 2


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(0)
    a = np.repeat(np.arange(1, 400, dtype=np.uint64), r.integers(1, 9, 399))
    b = np.concatenate([a[:1200], np.arange(5000, 5200, dtype=np.uint64)])
    hashes, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
    text, shingle, weight = bagminhash.weighted(hashes, bounds)
    want = similarity(Counter(a.tolist()), Counter(b.tolist()))
    s = bagminhash.signatures(text, shingle, weight, 2, 6000)
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_similar_equals_the_counters():
    r = np.random.default_rng(1)
    docs = [np.sort(r.integers(0, 40, 60).astype(np.uint64)) for _ in range(12)]
    every = np.arange(12)
    got = {(a, b) for a, b in bagminhash.similar(docs, every, every, 0.5, columns=8)}
    want = {(a, b) for a in range(12) for b in range(12) if a != b and similarity(Counter(docs[a].tolist()), Counter(docs[b].tolist())) >= 0.5}
    assert got == want


def test_components_of_a_path(spark):
    n = 40
    edges = spark.createDataFrame([(i.to_bytes(2, "big"), (i + 1).to_bytes(2, "big")) for i in range(n)] + [(b"\xff\x01", b"\xff\x02")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.root) for r in near_dedup.components(edges).collect()}
    assert len(got) == n + 3 and set(got.values()) == {b"\x00\x00", b"\xff\x01"}


def test_few_exchanges(spark, docs_of, monkeypatch):
    """Every exchange is a thread of a driver that keeps it for a minute; stars took three calls of components, of three rounds and more each."""
    names, write = [], near_dedup.written

    def kept(df, name, *more):
        names.append(name)
        return write(df, name, *more)

    monkeypatch.setattr(near_dedup, "written", kept)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[:90] + [f"x{i}"] * (i > 0))) for i in range(6)] + [(6, "one two three four five six")]
    got = {r.doc_id: r.class_id for r in near_dedup.classify(docs_of(*rows)).collect()}
    assert got == brute_classes(rows) and set(got.values()) == {0, 6}
    assert names.count("star") <= 4 and names.count("roots") == 1 and "block-links" not in names


def test_components_of_nothing_and_of_stars(spark, monkeypatch):
    names, write = [], near_dedup.written
    monkeypatch.setattr(near_dedup, "written", lambda df, name, *more: names.append(name) or write(df, name, *more))
    edges = spark.createDataFrame([(bytes([9 - k % 2, k]), bytes([k % 2])) for k in range(10)], "a binary, b binary")
    assert near_dedup.components(edges.limit(0)).count() == 0
    names.clear()
    got = {bytes(r.node): bytes(r.root) for r in near_dedup.components(edges).collect()}
    assert got == {bytes([9 - k % 2, k]): bytes([k % 2]) for k in range(10)} | {b"\0": b"\0", b"\1": b"\1"}
    assert names == ["star", "star", "roots"]


def test_words_of_one_text():
    data = np.frombuffer(b"A b", dtype=np.uint8)
    assert len(bagminhash.shingles(words_of(data, np.array([0, 3])))[0]) == 1
