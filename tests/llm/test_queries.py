"""Registered queries and the pipeline's stages against plain Python, on a small folder of tables with planted rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from pyspark.sql import functions as F
from telemill.llm import queries, quality, toxicity
from telemill.llm.queries import QUERIES, table, tokenizer_path
from tests.llm.test_language_model import brute as brute_language_model
from tests.llm.test_quality import brute_model, brute_score
from tests.llm.test_toxicity import brute_score as brute_toxicity

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
ITEM = " ".join(f"question{i} about" for i in range(12))
VILE = ["vileone", "viletwo", "vilethree", "vilefour"]


def crc(i: int, n: int) -> int:
    return zlib.crc32(str(i).encode()) % n


def make() -> tuple[list[tuple], list[tuple], dict[str, set[int]]]:
    """(documents, labels, planted ids by kind)."""
    r = random.Random(7)
    vocabulary = ["".join(r.choice("aeiou" if k % 2 else "bdfgklmnprst") for k in range(r.choice([3, 4, 5, 6, 7]))) for _ in range(500)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).capitalize() + "."
    docs, labels, kinds = [], [], {k: set() for k in ("toxic", "junk", "copy", "leak", "clean")}

    def add(text, kind, lang="en", quality=None, toxic=None):
        i = len(docs)
        docs.append((i, text, lang, f"s{i % 3}", None if text is None else len(text)))
        kinds[kind].add(i)
        if quality is not None or toxic is not None:
            labels.append((i, quality, toxic))
        return i

    for _ in range(180):
        add(prose(r.randint(30, 90)), "clean", r.choice(["en", "fr"]), 1, 0)
    for k in range(60):
        words = prose(40).split()
        for _ in range(3):
            words.insert(r.randrange(len(words)), r.choice(VILE))
        add(" ".join(words), "toxic", "en", 1 if k % 2 else None, 1)
    for k in range(20):
        add(" ".join(w.upper() + "!!$%|" for w in prose(40).split()), "junk", "fr", 0 if k % 2 else None, 0)
    for _ in range(8):
        words = prose(120).split()
        add(" ".join(words), "clean")
        for _ in range(3):
            near = list(words)
            near[r.randrange(len(near))] = r.choice(vocabulary)
            add(" ".join(near), "copy")
        add(" ".join(words), "copy")
    for _ in range(5):
        words = prose(60).split()
        add(" ".join([*words[:30], ITEM, *words[30:]]), "leak")
    for text in (None, "", "x", "Привет мир, это текст", "a\x00b c"):
        add(text, "clean", None)
    return docs, labels, kinds


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    docs, labels, kinds = make()
    columns = lambda rows, *names: {n: [x[k] for x in rows] for k, n in enumerate(names)}
    pq.write_table(pa.table(columns(docs, "doc_id", "text", "lang", "source", "n_chars"), schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])), where / "documents.parquet")
    pq.write_table(pa.table(columns(labels, "doc_id", "quality", "toxic"), schema=pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])), where / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1, 2], "text": [ITEM, "never seen words in any document of this folder at all today"]}), where / "benchmark.parquet")
    return str(where), docs, labels, kinds


def shingles(text) -> Counter:
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_classes(docs: list[tuple]) -> dict[int, int]:
    """Least id of each document's component of texts whose shingle multisets overlap by 0.8 (equal texts always)."""
    sets = {d[0]: shingles(d[1]) for d in docs}
    text = {d[0]: d[1] or "" for d in docs}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if text[i] == text[j] or (a and b and sum((a & b).values()) >= 0.8 * sum((a | b).values())):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_op1_classes(spark, planted):
    where, docs, _, kinds = planted
    got = {r.doc_id: r.class_id for r in QUERIES["op1_near_dedup"](spark, where).collect()}
    assert got == brute_classes(docs) and all(got[i] != i for i in kinds["copy"])


def test_op3_pieces(spark, planted):
    from tokenizers import Tokenizer

    where, docs, _, _ = planted
    own = Tokenizer.from_file(tokenizer_path())
    ids = {d[0]: [*own.encode(d[1] or "", add_special_tokens=False).ids, 0] for d in docs}
    pieces = QUERIES["op3_packing"](spark, where).collect()
    for i, want in ids.items():
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        assert [p.start for p in mine] == list(np.cumsum([0, *(p.length for p in mine)]))[:-1] and sum(p.length for p in mine) == len(want)
        assert all(p.ids_crc32 == zlib.crc32(np.array(want[p.start : p.start + p.length], dtype="<u4").tobytes()) and p.doc_tokens == len(want) for p in mine)
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for s, rows in by.items():
        ends = [a + n for a, n in sorted(rows)]
        assert [a for a, _ in sorted(rows)] == [0, *ends[:-1]] and (ends[-1] == 1024 or s == max(by) and ends[-1] <= 1024)


def test_op4_perplexities(spark, planted):
    where, docs, labels, kinds = planted
    got = {r.doc_id: r for r in QUERIES["op4_quality"](spark, where).collect()}
    held = {r.i for r in spark.createDataFrame([(d[0],) for d in docs], "i long").where(F.pmod(F.xxhash64("i"), F.lit(quality.HOLD_OUT)) == 0).collect()}
    text = {d[0]: d[1] or "" for d in docs}
    p = brute_model([text[i] for i, q, _ in labels if q == 1 and i not in held], quality.ORDER)
    for i in [*sorted(kinds["junk"])[:3], *sorted(kinds["clean"])[:3], *sorted(kinds["clean"])[-5:]]:
        assert got[i].n_units == len(text[i]) and abs(got[i].log10_p - brute_score(p, text[i], quality.ORDER)) < 1e-3 * (len(text[i]) + 1)
        assert got[i].keep == (got[i].threshold is None or got[i].perplexity is None or got[i].perplexity <= got[i].threshold)
    assert not any(got[i].keep for i in kinds["junk"]) and sum(got[i].keep for i in kinds["clean"]) >= len(kinds["clean"]) - 3


def test_op6_scores(spark, planted):
    where, docs, _, _ = planted
    want = brute_language_model([(d[0], d[1], crc(d[0], 7) == 2) for d in docs], 3)
    got = sorted(tuple(r) for r in QUERIES["op6_language_model"](spark, where).collect())
    assert len(got) == len(docs)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-3 * a[2]
    held = [r for r in got if r[1] and r[2] > 20]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)  # better than single tokens


def test_op7_payloads(spark, planted):
    where, docs, _, _ = planted
    got = {r.doc_id: r for r in QUERIES["op7_mpeg_audio"](spark, where).collect()}
    for i, text, *_ in docs:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert sum(x.frames for x in got[i].seek_runs) == got[i].frames == len(payload) // 576


def test_op9_scores(spark, planted):
    where, docs, labels, kinds = planted
    got = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, where).collect()}
    assert {i for i, r in got.items() if r.held_out} == {d[0] for d in docs if crc(d[0], 4) == 2}
    net = toxicity.train(table(spark, where, "documents"), table(spark, where, "labels").where(queries.remainder(4) != 2), thresholds=False)
    for i in [*sorted(kinds["toxic"])[:5], *sorted(kinds["clean"])[:5], *sorted(kinds["clean"])[-5:]]:
        assert abs(got[i].score - brute_toxicity(net, docs[i][1] or "")) < 1e-3
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[i].predicted, t) for i, _, t in labels if crc(i, 4) == 2]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_pipeline_stages(spark, planted):
    """Each stage on its own input: what it takes out, what it changes, and what it leaves alone."""
    where, docs, _, kinds = planted
    text = {d[0]: d[1] for d in docs}
    rows = table(spark, where, "documents")
    out = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out[name] = {r.doc_id: r.text for r in stage(spark, rows, where).collect()}
    kept = out["toxicity"]
    assert not kinds["toxic"] & set(kept) and len(kinds["clean"] - set(kept)) <= 2 and all(kept[i] == text[i] for i in kept)
    kept = out["quality classifier"]
    assert not kinds["junk"] & set(kept) and len(kinds["clean"] - set(kept)) <= 3 and all(kept[i] == text[i] for i in kept)
    kept = out["MinHash near-dedup"]
    assert kept == {i: text[i] for i in set(brute_classes(docs).values())}
    kept = out["benchmark decontamination"]
    assert set(kept) == set(text)
    for i in text:
        assert ("question5 about" not in kept[i] and kept[i].split()[0] == text[i].split()[0]) if i in kinds["leak"] else kept[i] == text[i]


def test_pipeline_run(spark, planted):
    """run() is its stages in a row, and its pieces are the ids of what they keep."""
    from tokenizers import Tokenizer

    where, docs, _, kinds = planted
    rows = table(spark, where, "documents")
    for _, stage in corpus_pipeline.STAGES[:4]:
        rows = spark.createDataFrame(stage(spark, rows, where).collect(), rows.schema)
    own = Tokenizer.from_file(tokenizer_path())
    want = {r.doc_id: [*own.encode(r.text or "", add_special_tokens=False).ids, 0] for r in rows.collect()}
    got: dict[int, dict[int, bytes]] = {}
    for p in corpus_pipeline.run(spark, where).collect():
        got.setdefault(p.doc_id, {})[p.start] = bytes(p.ids)
    assert {i: b"".join(x for _, x in sorted(parts.items())) for i, parts in got.items()} == {i: np.array(x, dtype="<u4").tobytes() for i, x in want.items()}
    assert not set(want) & (kinds["toxic"] | kinds["junk"] | kinds["copy"])
    prose = set(range(180)) | {i for i in kinds["clean"] if len(docs[i][1] or "") > 100}
    assert len(prose - set(want)) <= 3
