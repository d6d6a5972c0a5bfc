import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telemill.llm import packing
from telemill.llm.queries import tokenizer_path


def test_pieces_hold_every_id_once(spark, docs_of):
    rows = [(1, "Hello world, it's me"), (2, None), (3, ""), (4, "été 123\n\n  x " * 400), (4, "again"), (5, "<|endoftext|> 's''ll\u3000 a")]
    got = packing.pack(docs_of(*rows).repartition(3), tokenizer_path(), length=64).collect()
    t = Tokenizer.from_file(tokenizer_path())
    want = sorted((i, tuple([*t.encode(x or "", add_special_tokens=False).ids, 0])) for i, x in rows)
    own = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.doc_tokens, r.start)):
        ids = np.frombuffer(r.ids, dtype="<u4")
        assert len(ids) == r.length and 0 < r.offset + r.length <= 64
        own.setdefault((r.doc_id, r.doc_tokens), []).extend(ids.tolist())
    assert sorted((i, tuple(x)) for (i, _), x in own.items()) == want
    spots = sorted((r.sequence_id, r.offset, r.length) for r in got)
    total = 0
    for s, o, n in spots:  # gapless
        assert s * 64 + o == total
        total += n
    assert total == sum(len(x) for _, x in want)
    assert all(r.boundary == (r.start + r.length < r.doc_tokens) for r in got)


def test_no_documents(spark, docs_of):
    assert packing.pack(docs_of((1, "x")).limit(0), tokenizer_path()).count() == 0


def test_checksum_is_of_little_endian_ids(spark, docs_of):
    text = "Hello there, été"
    ids = [*Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids, 0]
    got = {r.doc_id: r.c for r in packing.pack(docs_of((1, None), (2, text)), tokenizer_path()).select("doc_id", F.crc32("ids").alias("c")).collect()}
    assert got == {1: zlib.crc32(bytes(4)), 2: zlib.crc32(np.array(ids, dtype="<u4").tobytes())}
