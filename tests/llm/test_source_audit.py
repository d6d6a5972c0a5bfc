import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F
from telemill.llm import source_audit
from telemill.llm.queries import QUERIES, table
from tests.llm.conftest import SMALL

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
FIELDS = "doc_id long, text string, lang string, source string"


def brute(rows, least=10, top=10):
    """All rows by the stated sums over every kept term, in Python integers."""
    langs: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    docs: dict[str, Counter] = defaultdict(Counter)
    for _, text, lang, source in rows:
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        langs[lang or ""][source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in langs.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)

        def probabilities(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: probabilities(c) for s, c in sources.items()}
        q = probabilities(sum(sources.values(), Counter()))
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


def by_operator(spark, rows, **options):
    df = spark.createDataFrame(rows, FIELDS).withColumns({"item": F.lit("x"), "value": F.lit(1), "n": F.lit(None).cast("long")})
    return sorted(tuple(r) for r in source_audit.divergence(df.repartition(5), **options).collect())


def corpus(seed=1, n=150):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 4))) for _ in range(80)]
    rows = []
    for i in range(n):
        k = r.choice([1, 3, 10, 60])
        text = " ".join(r.choice(words[: r.choice([10, 40, 80])]).upper() if r.random() < 0.1 else r.choice(words) for _ in range(k))
        rows.append((i, text + r.choice(["", "...", "1x2y", "\n\tA_b"]), r.choice(["en", "en", "fr", None]), r.choice(["a", "b", "c", "d", None])))
    rows += [(n, None, "en", "silent"), (n + 1, "", "xx", "one"), (n + 2, "only here", "xx", "two"), (n + 3, "мир " * 30, "en", "a"), (3, "", "en", "b"), (None, "abc abc", "en", "c")]
    return rows + rows[:20] + [(7, "ab " * 30_000, "en", "a")]


@pytest.mark.parametrize("least", [1, 3, 10])
def test_against_brute_force(spark, least):
    rows = corpus()
    assert by_operator(spark, rows, least=least) == brute(rows, least)


def test_small_runs_and_pair_sums(spark, monkeypatch):
    """Runs that spill at once, and corrections given out before a shard ends, add up to the same."""
    monkeypatch.setattr(source_audit, "RUN_BYTES", 1)
    monkeypatch.setattr(source_audit, "_SLICE", 64)
    monkeypatch.setattr(source_audit, "PAIR_ROWS", 2)
    rows = corpus(2)
    assert by_operator(spark, rows, least=2) == brute(rows, 2)


def test_top_and_ties(spark):
    rows = [(i, "same words here", "en", s) for i in range(10) for s in "ab"] + [(i, f"w{chr(97 + k)}z", "en", "c") for i in range(10) for k in range(14)]
    got = by_operator(spark, rows)
    assert got == brute(rows) and sum(r[1:3] == ("c", "term") for r in got) == 10


def test_no_rows_and_one_group(spark):
    assert by_operator(spark, []) == []
    assert by_operator(spark, [(1, "word", "en", "a")]) == []
    assert by_operator(spark, [(1, "word", "en", "a"), (2, None, "en", "b")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_equal_hashes_of_unequal_words(monkeypatch):
    data = np.frombuffer(b"ab cd ab efg cd", dtype=np.uint8)
    real = source_audit.words_of

    def lying(*args):
        words = real(*args)
        words.hashes[:] = 1
        return words

    monkeypatch.setattr(source_audit, "words_of", lying)
    terms, group, n, docs = source_audit.postings(data, np.array([0, 8, 15]), np.array([0, 1]))
    got = {(t, g): (a, b) for t, g, a, b in zip(terms.to_pylist(), group.tolist(), n.tolist(), docs.tolist())}
    assert got == {(b"ab", 0): (2, 1), (b"cd", 0): (1, 1), (b"efg", 1): (1, 1), (b"cd", 1): (1, 1)}


def test_groups_are_not_cut():
    batch = lambda *x: pa.RecordBatch.from_arrays([pa.array(x)], names=["k"])
    got = [b.column(0).to_pylist() for b in source_audit._whole(iter([batch("a"), batch("a"), batch("a", "b"), batch("b"), batch("c"), batch("c", "d", "d")]), "k")]
    assert got == [["a", "a", "a"], ["b", "b"], ["c", "c"], ["d", "d"]]


def test_query_on_small_tables(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_source_audit"](spark, SMALL).collect()) == brute(rows)
