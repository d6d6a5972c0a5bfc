import numpy as np
import pytest

from telemill.llm import quality


def brute_model(texts, order):
    """Interpolated modified Kneser-Ney over tuples of characters; None stands before a text."""
    grams = {k: {} for k in range(1, order + 1)}
    for t in texts:
        s = [None] * (order - 1) + list(t)
        for i in range(order - 1, len(s)):
            g = tuple(s[i - order + 1 : i + 1])
            grams[order][g] = grams[order].get(g, 0) + 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] = grams[k].get(g[1:], 0) + 1
    units = len(grams[1]) + 1

    def discounts(k):
        t = [sum(v == n for v in grams[k].values()) for n in range(5)]
        out = []
        for n in (1, 2, 3):
            if t[n] == 0 or t[1] + 2 * t[2] == 0:
                out.append(min(n, 2) * 0.5)
            else:
                y = t[1] / (t[1] + 2 * t[2])
                out.append(min(n, max(0.1, n - (n + 1) * y * t[n + 1] / t[n])))
        return out

    d = {k: discounts(k) for k in grams}

    def p(w, h):
        if h is None:
            return 1 / units
        k = len(h) + 1
        below = p(w, h[1:] if h else None)
        own = {g: n for g, n in grams[k].items() if g[:-1] == h}
        if not own:
            return below
        cut = lambda n: d[k][min(n, 3) - 1]
        total = sum(own.values())
        n = own.get((*h, w), 0)
        return (max(n - cut(n), 0) if n else 0) / total + sum(min(cut(x), x) for x in own.values()) / total * below

    return p


def brute_score(p, text, order):
    s = [None] * (order - 1) + list(text)
    return sum(np.log10(p(s[i], tuple(s[i - order + 1 : i]))) for i in range(order - 1, len(s)))


TEXTS = ["abc abd. Abc", "bca!! abab", "aaa", "żółw żółty, 東京は東の京 🙂🙂", ""]
ASKED = ["abca. zz", "b", "A!", "", None, "东京 東京は🙂 żółw", "x\x00y", "aaa" * 50]


@pytest.mark.parametrize("order", [1, 3, 5])
@pytest.mark.parametrize("model_rows", [10**6, 0])
def test_scores_equal_brute_force(spark, docs_of, order, model_rows):
    """Both with the model in every task and with blocks that ask for their n-grams."""
    table = quality.model_table(docs_of(*enumerate(TEXTS)), order)
    docs = docs_of(*enumerate(ASKED)).repartition(2)
    got = {r.doc_id: r.v for r in quality.score(docs, table, "v", order, True, model_rows, block_bytes=40).collect()}
    p = brute_model(TEXTS, order)
    assert len(got) == len(ASKED)
    for i, t in enumerate(ASKED):
        t = t or ""
        assert got[i].n_units == len(t) and abs(got[i].log10_p - brute_score(p, t, order)) < 1e-3 * (len(t) + 1)
        want = [10 ** (-brute_score(p, t[:k], order) / k) for k in (2, 4, 8, 16, 32, 64, 128) if k <= len(t)]
        assert np.allclose(got[i].heads, want, rtol=1e-2) and len(got[i].heads) == len(want)


def test_model_without_text_and_with_all_of_a_context(spark, docs_of):
    assert quality.model_table(docs_of().limit(0), 3).count() == 0
    p = brute_model(TEXTS, 3)
    units = {c for t in TEXTS for c in t}
    for h in [(None, None), ("a", "b"), ("q", "q")]:  # what a context gives to all characters and the unknown one is one
        assert abs(sum(p(c, h) for c in [*units, "\u1234"]) - 1) < 1e-9


def test_judge_keeps_clean_and_rejects_junk(spark, docs_of):
    words = "the quick brown fox jumps over a lazy dog and runs home again".split()
    r = np.random.default_rng(0)
    clean = [(i, " ".join(r.choice(words, 40))) for i in range(400)]
    junk = [(1000 + i, " ".join(w.upper() + "!!$%" for w in r.choice(words, 40))) for i in range(20)]
    odd = [(2000, None), (2001, ""), (2002, "x"), (5, clean[5][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)] + [(1000, 0, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs_of(*clean, *junk, *odd), labels).collect()
    kept = {r.doc_id for r in got if r.keep}
    assert not any(i >= 1000 and i < 1100 for i in kept) and {2000, 2001, 2002} <= kept and sum(i < 400 for i in kept) >= 395 and len(got) == 424
    none = quality.judge(docs_of((1, "a")), labels.limit(0)).first()
    assert none.keep and none.threshold is None


def test_every_language_and_length_has_a_threshold(spark, docs_of):
    words = "the quick brown fox jumps over a lazy dog and runs home again".split()
    r = np.random.default_rng(0)
    prose = lambda n: " ".join(r.choice(words, n))
    en = docs_of(*[(i, prose(40)) for i in range(150)], (200, prose(3)), (201, "Q!$ ZZ#|"), (202, prose(4000)), (203, "#Q|$ " * 4000), (204, "y"), (205, None))
    es = docs_of(*[(300 + i, prose(40)) for i in range(5)], (310, prose(40)), (311, "Q!$ ZZ#|" * 20), lang="es")
    other = docs_of((400, prose(40)), (401, "Q!$ ZZ#|" * 20), lang="xx")
    labels = spark.createDataFrame([(i, 1) for i in [*range(150), *range(300, 305)]], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.judge(en.unionByName(es).unionByName(other), labels).collect()}
    assert {i for i, x in got.items() if x.threshold is None} == {204, 205}
    assert {i for i, x in got.items() if not x.keep} >= {201, 203, 311, 401} and all(got[i].keep for i in (200, 202, 204, 205, 310, 400))


def test_other_scripts_are_told_apart(spark, docs_of):
    r = np.random.default_rng(0)
    words = "быстрая лиса прыгает через ленивую собаку и бежит домой снова".split()
    prose = lambda: " ".join(r.choice(words, 40))
    greek = "γρήγορη αλεπού πηδάει πάνω από το σκυλί".split()
    docs = docs_of(*[(i, prose()) for i in range(300)], (900, " ".join(r.choice(greek, 40))), (901, "".join(r.permutation(list(prose())))), lang="ru")
    got = {x.doc_id: x.keep for x in quality.judge(docs, spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")).collect()}
    assert not got[900] and not got[901] and sum(got[i] for i in range(300)) >= 297


def test_clashing_columns_stay(spark, docs_of):
    docs = docs_of(*[(i, "some words of prose here") for i in range(9)]).selectExpr("*", "'mine' AS keep", "doc_id AS perplexity", "1 AS threshold", "0 AS v")
    got = quality.verdicts(docs, spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int"), "__verdict")
    assert got.columns == [*docs.columns, "__verdict"] and all(x.keep == "mine" and x.perplexity == x.doc_id and x["__verdict"].keep for x in got.collect())
