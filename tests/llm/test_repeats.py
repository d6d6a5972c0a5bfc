import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from telemill.llm import repeats
from telemill.llm.queries import QUERIES, table
from telemill.llm.suffix_sort import Buffer, sort_groups
from tests.llm.conftest import SMALL


def brute(texts: list[bytes], length: int) -> list[bytearray]:
    """For each text, which bytes a string that also starts elsewhere covers."""
    seen: dict[bytes, list[tuple[int, int]]] = {}
    for t, x in enumerate(texts):
        for i in range(len(x) - length + 1):
            seen.setdefault(x[i : i + length], []).append((t, i))
    out = [bytearray(len(x)) for x in texts]
    for places in seen.values():
        for t, i in places if len(places) > 1 else ():
            out[t][i : i + length] = b"\x01" * length
    return out


def digest_of(text: bytes, covered: bytearray) -> tuple[int, int, int, str]:
    kept = bytes(x for x, c in zip(text, covered) if not c)
    return len(text), sum(covered), sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1])), hashlib.sha256(kept).hexdigest()


def random_texts(r: random.Random, size: int) -> list[bytes]:
    letters = r.choice([b"a", b"ab", b"abcdefgh"])
    passages = [bytes(r.choice(letters) for _ in range(r.randint(1, 4 * size))) for _ in range(5)]
    piece = lambda: r.choice(passages)[r.randint(0, 10) :] if r.random() < 0.6 else bytes(r.choice(letters) for _ in range(r.randint(0, 2 * size)))
    return [b"".join(piece() for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 12))]


def covered_by_operator(texts: list[bytes], length: int, core: int) -> list[bytearray]:
    """The operator's steps over one buffer, without Spark."""
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
    hashes, place, first, last = repeats.anchors(data, offsets, length, core)
    order = np.argsort(hashes, kind="stable")
    hashes, place, first, last = hashes[order], place[order], first[order], last[order]
    body = b"".join(data[a : b + length].tobytes() for a, b in zip(first, last))
    out = np.zeros(len(data), dtype=np.uint8)
    if body:
        found = repeats.repeated(np.frombuffer(body, dtype=np.uint8), np.cumsum(np.append(0, last - first + length)), place - first, np.cumsum(np.append(True, hashes[1:] != hashes[:-1])), length)
        for k, low, high in zip(*found):
            out[first[k] + low : first[k] + high] = 1
    return [bytearray(out[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]


@pytest.mark.parametrize("seed", range(60))
def test_steps_against_brute_force(seed):
    r = random.Random(seed)
    length = r.choice([20, 30, 50])
    texts = random_texts(r, length)
    assert covered_by_operator(texts, length, r.choice([5, 8, length - 1, length // 2])) == brute(texts, length)


@pytest.mark.parametrize("left", [False, True])
@pytest.mark.parametrize("exact", [False, True])
def test_sort_groups(left, exact):
    r = random.Random(3)
    data = np.array([r.choice(b"ab") for _ in range(900)], dtype=np.uint8)
    bounds = np.cumsum([0, 1, 2, 3, 40, 0, 17])
    n = bounds[-1]
    at = np.array([r.randint(0, 900) for _ in range(n)])
    reach = np.array([min(r.randint(0, 60), x if left else 900 - x) for x in at])
    bounds = np.unique(bounds)
    order, common = sort_groups(Buffer(data), at, reach, bounds, left, exact)
    text = lambda k: data[at[k] - reach[k] : at[k]].tobytes()[::-1] if left else data[at[k] : at[k] + reach[k]].tobytes()
    for a, b in zip(bounds, bounds[1:]):
        assert list(order[a:b]) == sorted(range(a, b), key=lambda k: (text(k), k))
        for i in range(a + 1, b):
            x, y = text(order[i - 1]), text(order[i])
            assert common[i] == next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))


def test_false_hash_is_found(monkeypatch):
    """Where hashes call unequal bytes equal, the order and the extensions come from the bytes."""
    data = np.frombuffer(b"abcaabdaabea", dtype=np.uint8)
    monkeypatch.setattr(Buffer, "same", lambda self, a, b, size: np.ones(len(a), dtype=bool))
    order, common = sort_groups(Buffer(data), np.array([0, 4, 8]), np.array([4, 4, 4]), np.array([0, 3]))
    assert list(order) == [0, 1, 2] and list(common) == [0, 2, 2]


def cases() -> list[tuple[int, str | None]]:
    r = random.Random(11)
    words = ["".join(r.choice("aeioubdfgklmnrst") for _ in range(r.randint(2, 9))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, once = prose(60), prose(300)
    texts = [prose(r.randint(5, 200)) for _ in range(30)]
    texts += [f"{prose(30)} {passage} {prose(30)}" for _ in range(12)]  # one passage in many texts
    texts += [once, once, once[:-5] + "other", once[7:]]  # copies and near copies
    texts += [None, "", "x", "a" * 5000, "ab " * 2000, prose(20) + "\x00é" * 300, "Привет мир " * 40, "y" * 199, "z" * 200, "z" * 200]
    texts += [passage[:250], passage[100:299], passage[100:300]]
    return list(enumerate(texts)) + [(3, texts[3]), (None, "no id " + passage)]


@pytest.mark.parametrize("group, kinds", [(repeats.GROUP, repeats.KINDS), (3, repeats.KINDS), (3, 0), (0, 0)])
def test_rows_against_brute_force(spark, monkeypatch, group, kinds):
    """Also where groups of over 3 anchors, or all of them, are counted instead of sorted, and their ranges joined instead of looked up."""
    monkeypatch.setattr(repeats, "KINDS", kinds)
    monkeypatch.setattr(repeats, "HELD", 1 + kinds % 7)
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"node": F.lit(1), "row": F.lit("x"), "copies": F.lit(None).cast("int")})
    got = sorted(((r.doc_id, *r.repeats) for r in repeats.cut(docs.repartition(3), group=group).collect()), key=str)
    raw = [(t or "").encode() for _, t in rows]
    want = sorted(((i, *digest_of(x, c)) for (i, _), x, c in zip(rows, raw, brute(raw, 200))), key=str)
    assert got == want


def test_kept_bytes_and_clashes(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(2))
    out = repeats.cut(docs, into="result")
    assert out.columns == ["doc_id", "text", "found", "result"]
    kept = {r.kept_sha256: bytes(r.kept) for r in repeats.removed(docs).collect()}
    assert all(hashlib.sha256(x).hexdigest() == k for k, x in kept.items())


def test_empty_table(spark, docs_of):
    assert repeats.cut(docs_of()).collect() == []


def test_limits():
    with pytest.raises(ValueError):
        repeats.removed(None, length=64)


def test_query_on_small_tables(spark):
    rows = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    raw = [(r.text or "").encode() for r in rows]
    want = {r.doc_id: digest_of(x, c) for r, x, c in zip(rows, raw, brute(raw, 200))}
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op11_repeats"](spark, SMALL).collect()} == want


@pytest.mark.parametrize("names", [repeats.NAMES, 0])
def test_strings_of_large_groups_are_looked_up_and_not_joined(spark, monkeypatch, names):
    """A passage that many kinds share was a row of a join for each of its strings in each of them."""
    monkeypatch.setattr(repeats, "NAMES", names)
    plans, write = {}, repeats.written

    def kept(df, name, *more):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return write(df, name, *more)

    monkeypatch.setattr(repeats, "written", kept)
    r = random.Random(6)
    passage = "".join(r.choice("abcdefgh ") for _ in range(300))
    texts = ["".join(r.choice("ijklmn ") for _ in range(150)) + passage + "".join(r.choice("opqrs ") for _ in range(150)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.repeats for x in repeats.cut(docs, group=3).collect()}
    assert all(got[i].n_removed >= 300 and got[i].n_spans == 1 for i in range(12))
    assert ("Join" in plans["repeats-ranges"]) == (names == 0)


@pytest.mark.parametrize("kinds", [repeats.KINDS, 0])
def test_large_groups_of_few_kinds_are_sorted(spark, monkeypatch, kinds):
    """A kind of a large group had a row for each of its strings, however few kinds the group had."""
    monkeypatch.setattr(repeats, "KINDS", kinds)
    seen, write = [], repeats.written

    def kept(df, name, *more):
        out = write(df, name, *more)
        if name == "repeats-kinds":
            seen.extend(out.collect())
        return out

    monkeypatch.setattr(repeats, "written", kept)
    r = random.Random(7)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    passage, ends = some("abcdefgh ", 500), [some("xyz", 200) for _ in range(3)]
    texts = [some("ijklmn ", 150) + passage + ends[i % 3] + some("opqrs ", 150) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raw = [t.encode() for t in texts]
    got = {x.doc_id: tuple(x.repeats) for x in repeats.cut(docs, group=4).collect()}
    assert got == {i: digest_of(x, c) for i, (x, c) in enumerate(zip(raw, brute(raw, 200)))}
    by_core: dict[int, list] = {}
    for x in seen:
        by_core.setdefault(x.core, []).append(x)
    assert all(x.many == (len(own) > 4) for own in by_core.values() for x in own)
    assert {len(own) for own in by_core.values()} >= {1, 3, 12}
