import re

import numpy as np
import pandas as pd
import pyarrow as pa

from telemill.llm import toxicity
from telemill.llm.text import text_buffers


def sample(n=300, seed=0):
    r = np.random.default_rng(seed)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for i in range(n):
        w = list(r.choice(words, 40))
        toxic = i % 2
        if toxic:
            w[int(r.integers(40))] = r.choice(["vileone", "viletwo", "vilethree", "nasty"])
        rows.append((i, " ".join(w), toxic))
    return rows


def test_held_out_accuracy_and_batches(spark, docs_of):
    rows = sample()
    docs = docs_of(*[(i, t) for i, t, _ in rows], (900, None), (901, ""), (902, "vilefour stem unseen"), (903, "word1 " * 200_000 + "nasty"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:200]], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    right = [(got[i] >= 0.3) == bool(y) for i, _, y in rows[200:]]
    assert sum(right) >= 95 and got[900] == got[901] and 0 < got[900] < 0.5 and got[903] > 0.3
    assert 0 < net.thresholds.get("en", 0.3) < 1
    # one text at a time, or many: equal scores
    texts = [rows[0][1], "", "a", rows[1][1]]
    many = net.scores(*text_buffers(pa.array(texts)))
    one = [net.scores(*text_buffers(pa.array([t])))[0] for t in texts]
    assert np.allclose(many, one, atol=1e-6)


def test_without_labels(spark, docs_of):
    docs = docs_of((1, "a"), (2, None))
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    assert {r.score for r in toxicity.score(docs.limit(2), net).collect()} == {toxicity.score(docs, net).first().score}
    assert toxicity.score(docs.limit(0), net).count() == 0


def brute_score(net, text):
    """One text, word by word, filter by filter."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower() if text.isascii() else text.encode())
    rows = [toxicity.features(np.frombuffer(w, dtype=np.uint8), np.array([0, len(w)]))[0][0] for w in words]
    x = [sum(net.tables[k][row[k]].astype(float) for k in range(len(row))) for row in rows]
    total, m = net.bias, 0
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for i in range(len(x)):
                y = float(net.shift[k][f])
                for d in range(width):
                    if i + d < len(x):
                        y += float((x[i + d] * net.filters[k][d][:, f]).sum())
                best = max(best, y)
            total += best * float(net.weight[m])
            m += 1
    return 1 / (1 + np.exp(-total))


def test_scores_equal_brute_force():
    rows = sample(120)
    net = toxicity.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows], dtype=np.float32), 0.5, epochs=2)
    texts = [*(t for _, t, _ in rows[:12]), "", "word1", "Nasty! word2", "vileone viletwo", "été ñandú word3 nasty"]
    got = net.scores(*text_buffers(pa.array(texts)))
    assert np.allclose(got, [brute_score(net, t) for t in texts], atol=1e-4)


def test_long_texts_reach_the_fit(spark, docs_of):
    rows = [(i, "word1 " * 9000 + ("vileone " if y else "calm "), y) for i, y in enumerate([0, 1] * 6)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    net = toxicity.train(docs_of(*[(i, t) for i, t, _ in rows]), labels, thresholds=False)
    a, b = (r.score for r in toxicity.score(docs_of((1, "vileone"), (2, "calm")), net).orderBy("doc_id").collect())
    assert a > b


def test_clashing_columns_stay(spark, docs_of):
    rows = sample(60)
    docs = docs_of(*[(i, t) for i, t, _ in rows]).selectExpr("*", "'mine' AS score", "doc_id AS toxic")
    net = toxicity.train(docs.drop("toxic"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = toxicity.score(docs, net, into="__t")
    assert got.columns == [*docs.columns, "__t"] and all(r.score == "mine" for r in got.collect())


def test_thresholds_are_set_on_every_labelled_row(spark, docs_of, monkeypatch):
    rows = sample(400)
    long = [(1000 + i, t + " word1" * 7000, y) for i, t, y in rows[:20]]
    docs = docs_of(*[(i, t) for i, t, _ in rows[:300]]).unionByName(docs_of(*[(i, t) for i, t, _ in rows[300:350]], lang="de")).unionByName(docs_of(*[(i, t) for i, t, _ in rows[350:360] + long], lang="fr"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:360] + long], "doc_id long, toxic int")
    seen = []
    own = toxicity.thresholds_of
    monkeypatch.setattr(toxicity, "thresholds_of", lambda cells: seen.append(cells) or own(cells))
    net = toxicity.train(docs, labels, rows=60)
    counts = seen[0].groupby("lang")[["no", "yes"]].sum()
    assert counts.loc["en"].tolist() == [150, 150] and counts.loc["de"].tolist() == [25, 25] and counts.loc["fr"].tolist() == [15, 15]
    assert set(net.thresholds) == {"en", "de"} and 0 < net.common < 1


def test_sparse_languages_take_the_threshold_over_all_rows(spark):
    cells = pd.DataFrame({"lang": ["en", "en", "fr", None], "bin": [-200, 300, 310, -190], "no": [90, 0, 0, 5], "yes": [0, 30, 3, 0]})
    each, common = toxicity.thresholds_of(cells)
    edge = lambda b: 1 / (1 + np.exp(-b / toxicity.BINS))
    assert set(each) == {"en"} and edge(-199) < each["en"] < edge(300) and edge(-189) < common < edge(300)
    net = toxicity.Net(None, [], [], None, 0.0, each, common)
    got = spark.createDataFrame([("fr", 0.9), ("fr", common - 1e-6), (None, common)], "lang string, score double")
    assert [r[0] for r in got.select(toxicity.rejected(net)).collect()] == [True, False, True]
    assert toxicity.thresholds_of(cells[cells["lang"] == "fr"]) == ({}, None)
