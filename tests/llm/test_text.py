import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from telemill.llm.text import ALNUM, NONSPACE, text_buffers, window_hashes, words_of

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKEN = re.compile("[^\x20\x09-\x0d]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB9é -\n\x00", max_size=40)), max_size=8))
def test_words_equal_the_patterns(texts):
    for table, pattern in ((ALNUM, WORD), (NONSPACE, TOKEN)):
        data, offsets = text_buffers(pa.array(texts, pa.string()))
        words = words_of(data, offsets, table)
        names = {}
        for i, t in enumerate(texts):
            want = pattern.findall((t or "").translate(LOWER))
            got = words.hashes[words.bounds[i] : words.bounds[i + 1]].tolist()
            assert len(want) == len(got)
            for w, h in zip(want, got):
                assert names.setdefault(w, h) == h
        assert len(set(names.values())) == len(names)


def test_windows_depend_on_their_words_alone():
    h = np.arange(1, 60, dtype=np.uint64)
    twice = np.concatenate([h, h])
    got = window_hashes(twice, 7)
    assert (got[:40] == got[59:99]).all() and len(np.unique(got[:53])) == 53


def test_nothing():
    data, offsets = text_buffers(pa.array([], pa.string()))
    assert len(words_of(data, offsets).hashes) == 0
