import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from telemill.llm import decontamination
from telemill.llm.queries import op2_decontamination
from telemill.llm.text import text_buffers, words_of
from tests.llm.conftest import SMALL

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, n=10):
    wins = {}
    for i, t in items:
        w = words(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            wins.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                got = wins.get(tuple(w[k : k + size]))
                if got:
                    hit.update(range(k, k + size))
                    found |= got
        out.append((i, len(w), len(hit), tuple(sorted(x for x in found if x is not None))))
    return sorted(out)


def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_scan_equals_brute_force(spark, docs_of):
    r = random.Random(3)
    items = [(i, " ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(12)] + [(50, None), (51, "..."), (52, items_text := "q r s t u v w x y z one two")]
    docs = [(i, " ".join(r.choice("abcdefghij") for _ in range(r.choice([0, 5, 40, 300])))) for i in range(30)] + [(90, None), (91, ""), (92, "Q, r! " + items_text.upper()), (92, "x")]
    for size in (1 << 20, 40):  # one block of items, and several
        got = decontamination.scan(docs_of(*docs), _items(spark, items), item_bytes=size)
        assert sorted((x.doc_id, x.n_words, x.n_hit, tuple(sorted(x["items"]))) for x in got.collect()) == brute(docs, items)


def test_clean_leaves_no_window_and_other_documents_alone(spark, docs_of):
    item = " ".join(f"k{i}" for i in range(20))
    docs = [(1, "before it. " + item + ". After it " * 30), (2, "nothing here"), (3, item), (4, None), (5, ""), (6, "k0 k1 k2")]
    got = {r.doc_id: r for r in decontamination.clean(docs_of(*docs), _items(spark, [(1, item)])).collect()}
    assert set(got) == {1, 2, 4, 5, 6} and got[2].text == "nothing here" and got[4].text is None
    assert "k3" not in got[1].text and got[1].text.startswith("before it.") and got[1].n_chars == len(got[1].text)


def test_empty_tables(spark, docs_of):
    items = _items(spark, [(1, "a b c")])
    assert decontamination.scan(docs_of((1, "a")).limit(0), items).count() == 0
    assert decontamination.scan(docs_of((1, "a b c")), items.limit(0)).first().n_hit == 0


def test_query_digest(spark):
    row = op2_decontamination(spark, SMALL).where("NOT contaminated").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and row.n_hit == row.n_items == 0


def test_windows_of_one_hash_are_told_apart(spark, docs_of, monkeypatch):
    """With a hash of four values nearly all windows collide; words decide."""
    own = decontamination.window_hashes
    monkeypatch.setattr(decontamination, "window_hashes", lambda h, n: own(h, n) >> np.uint64(62) << np.uint64(62))
    r = random.Random(5)
    items = [(i, " ".join(r.choice("abcd") for _ in range(r.choice([2, 12, 20])))) for i in range(8)]
    docs = [(i, " ".join(r.choice("abcd") for _ in range(60))) for i in range(20)]
    block = decontamination._block(items, 3)
    for i, t in docs:
        data, offsets = text_buffers(pa.array([t]))
        runs, found = decontamination._hits(data, words_of(data, offsets), block, 1)
        hit = {x for a, n, _ in runs for x in range(a, a + n)}
        assert (i, len(words(t)), len(hit), tuple(sorted(block.ids[k] for k in found[0]))) == brute([(i, t)], items, 3)[0]
