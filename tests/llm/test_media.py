import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from telemill.llm import media


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(data):
    payload = media.padded(data)
    raw = media.to_mpeg(payload)
    got = media.read_mpeg(raw)
    n = len(payload) // media.UNIT
    assert got["payload"] == payload and got["frames"] == n and got["bad"] == got["skipped"] == 0 and got["seconds"] * 48000 == 1152 * n
    assert got["table"]["frames"] == n and len(got["table"]["seek"]) == 100 and got["tags"]["TXXX"].endswith(str(len(payload)))


def test_resynchronises_after_junk_and_finds_damage():
    payload = media.padded(bytes(range(256)) * 20)
    raw = bytearray(media.to_mpeg(payload))
    first = media._tags(bytes(raw))[0]
    at = first + 2 * media._FRAME
    broken = bytes(raw[:at]) + b"\xff\xfbnoise\x00\xff" + bytes(raw[at:]) + b"tail"
    got = media.read_mpeg(broken)
    assert got["payload"] == payload and got["skipped"] == 13
    raw[at + 7] ^= 1  # in the side information, which the checksum covers
    assert media.read_mpeg(bytes(raw))["bad"] == 1
    assert media.read_mpeg(b"")["frames"] == 0 and media.read_mpeg(b"\xff" * 50)["frames"] == 0


def test_headers_of_other_layers():
    h = media.Header.of(bytes([0xFF, 0xFB, 0x90, 0x00]))  # version 1, layer III, 128 kbit/s, 44.1 kHz
    assert (h.size, h.samples, h.channels, h.protected) == (417, 1152, 2, False)
    h = media.Header.of(bytes([0xFF, 0xF3, 0x84, 0xC0]))  # version 2, layer III, 64 kbit/s, 24 kHz, mono
    assert (h.size, h.samples, h.channels) == (192, 576, 1)
    assert media.Header.of(b"\xff\xe8\x00\x00") is None


def test_crc_is_the_bitwise_one():
    row = np.frombuffer(b"123456789", dtype=np.uint8)[None, :]
    crc = 0xFFFF
    for x in b"123456789":
        crc ^= x << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    assert media.crc16(row)[0] == crc


def test_columns(spark, docs_of):
    rows = [(1, "é" * 700), (2, None), (3, ""), (3, "x")]
    got = sorted(media.read_media(media.encode_media(docs_of(*rows))).collect(), key=lambda r: (r.doc_id, r.n_bytes))
    for (_, text), r in zip(rows, got):
        payload = media.padded((text or "").encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[1].feature == got[2].feature and got[1].media_sha256 == got[2].media_sha256


def test_seek_runs_name_every_frame():
    payload = media.padded(bytes(range(256)) * 30)
    raw = media.to_mpeg(payload)
    first = media._tags(raw)[0]
    broken = raw[: first + 5 * media._FRAME] + b"junk" + raw[first + 5 * media._FRAME :]
    got = media.read_mpeg(broken)
    every = [a + k * z for a, z, n in got["runs"] for k in range(n)]
    assert every == got["offsets"].tolist() and len(got["runs"]) == 2 and len(every) == got["frames"] == len(payload) // media.UNIT
    assert all(broken[a] == 0xFF and media.Header.of(broken[a : a + 4]) for a in every)


def _tag(version, frames, flags=0, extra=b""):
    body = extra + b"".join(frames)
    return b"ID3" + bytes([version, 0, flags]) + media._synchsafe(len(body)) + body


def test_tags_of_all_versions():
    long = b"\x00" + b"a" * 200
    v4 = _tag(4, [b"TIT2" + media._synchsafe(len(long)) + b"\x00\x00" + long, b"TPE1" + media._synchsafe(5) + b"\x00\x00" + b"\x03" + "né".encode() + b"\x00"])
    assert media._tags(v4)[2] == {"TIT2": "a" * 200, "TPE1": "né"}
    v2 = _tag(2, [b"TT2" + (4).to_bytes(3, "big") + b"\x00abc"])
    assert media._tags(v2)[2] == {"TT2": "abc"}
    wide = b"\x01" + "été".encode("utf-16")
    v3 = _tag(3, [b"TIT2" + len(wide).to_bytes(4, "big") + b"\x00\x00" + wide], 0x40, (6).to_bytes(4, "big") + bytes(6))
    assert media._tags(v3)[2] == {"TIT2": "été"} and media._tags(v3 + media.to_mpeg(media.padded(b"x")))[0] > len(v3)


def test_other_tables_and_layers():
    head = bytes([0xFF, 0xFB, 0x90, 0xC4])  # layer III, 128 kbit/s, 44.1 kHz, mono, no checksum
    size = media.Header.of(head).size
    frame = head + bytes(size - 4)
    table = bytearray(frame)
    table[36:54] = b"VBRI" + bytes(6) + (4 * size).to_bytes(4, "big") + (3).to_bytes(4, "big")
    got = media.read_mpeg(bytes(table) + frame * 3)
    assert got["table"]["kind"] == "VBRI" and got["stated"] and got["frames"] == 3 and not media.read_mpeg(bytes(table) + frame * 2)["stated"]
    one = bytes([0xFF, 0xFE, 0x44, 0xC4])  # layer I, protected, 128 kbit/s, 48 kHz, mono
    body = bytearray(media.Header.of(one).size)
    body[:4] = one
    body[6:22] = bytes(range(16))
    check = int(media.crc16(np.frombuffer(bytes(body[2:4] + body[6:22]), dtype=np.uint8)[None, :])[0])
    body[4:6] = check.to_bytes(2, "big")
    good = media.read_mpeg(bytes(body) * 2)
    body[9] ^= 1
    assert (good["checked"], good["bad"]) == (2, 0) and media.read_mpeg(bytes(body) * 2)["bad"] == 2


def test_query_reads_stored_files(spark, monkeypatch):
    """The query's features come from a table that was written, whose files are those of the texts."""
    from telemill.llm import queries
    from telemill.llm.store import written

    tables = []
    monkeypatch.setattr(queries, "written", lambda df, name: tables.append(written(df, name)) or tables[-1])
    got = {r.doc_id: r for r in queries.op7_mpeg_audio(spark, "/root/testdata/sf0.001").collect()}
    stored = {r.doc_id: bytes(r.media) for r in tables[0].collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert set(stored) == set(texts) == set(got)
    for i, text in texts.items():
        padded = text + b"\xff" * (-len(text) % 576 or (576 if not text else 0))
        assert got[i].payload_sha256 == hashlib.sha256(padded).hexdigest() and got[i].media_sha256 == hashlib.sha256(stored[i]).hexdigest() and got[i].payload_bytes == len(padded)
