"""MPEG audio columns: write payloads as Layer III files, read any such file's frames and tags.

A file is an ID3v2 tag, a frame with a variable-bitrate table (frame count,
byte count, 100 seek points) and data frames: 48 kHz, mono, 224 kbit/s, with a
checksum.  Their granules are silent; 576 bytes of the ancillary part of each
frame carry payload, so a player skips it and a reader gets it back unchanged.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.text import text_buffers

UNIT = 576
_OUT = 8 << 20  # bytes of media in a batch

# Fixed values of the format: kbit/s by (version 1?, layer), Hz by version, slots and samples by layer.
_KBIT = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, (out << 1) ^ 0x8005, out << 1) & 0xFFFF
    return out


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The frames' checksum (polynomial 0x8005, start 0xFFFF) of each row of bytes."""
    out = np.full(len(rows), 0xFFFF, dtype=np.uint32)
    for k in range(rows.shape[1]):
        out = ((out << 8) & 0xFF00) ^ _CRC[(out >> 8) ^ rows[:, k]]
    return out


class Header:
    """What a four-byte frame header says; ``of`` gives None where it is none."""

    __slots__ = ("channels", "hz", "kbit", "layer", "protected", "samples", "size", "version")

    @classmethod
    def of(cls, raw: bytes) -> Header | None:
        if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
            return None
        version, layer = {0: 2.5, 2: 2, 3: 1}.get(raw[1] >> 3 & 3), 4 - (raw[1] >> 1 & 3)
        rate, hz = raw[2] >> 4, raw[2] >> 2 & 3
        if version is None or layer == 4 or rate in (0, 15) or hz == 3:
            return None
        h = cls()
        h.version, h.layer, h.protected = version, layer, not raw[1] & 1
        h.kbit, h.hz, h.channels = _KBIT[version == 1, layer][rate], _HZ[version][hz], 1 if raw[3] >> 6 == 3 else 2
        pad = raw[2] >> 1 & 1
        h.samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
        h.size = (12000 * h.kbit // h.hz + pad) * 4 if layer == 1 else h.samples // 8 * 1000 * h.kbit // h.hz + pad
        return h

    def side(self) -> int:
        """Bytes of side information of a Layer III frame."""
        return (17 if self.channels == 1 else 32) if self.version == 1 else (9 if self.channels == 1 else 17)


    def allocation(self, mode: int) -> int:
        """Bytes of bit allocation of a Layer I frame; joint stereo shares it above a bound that the mode tells."""
        bound = 4 * (mode >> 4 & 3) + 4 if mode >> 6 == 1 else 32
        return 16 if self.channels == 1 else (bound * 8 + (32 - bound) * 4) // 8


_HEAD = bytes([0xFF, 0xFA, 0xC4, 0xC4])  # version 1, layer III, protected, 224 kbit/s, 48 kHz, mono
_FRAME = Header.of(_HEAD).size
_AT = 4 + 2 + Header.of(_HEAD).side()  # where the payload starts in a frame


def _empty_frame() -> np.ndarray:
    frame = np.zeros(_FRAME, dtype=np.uint8)
    frame[:4] = list(_HEAD)
    check = int(crc16(np.concatenate([frame[2:4], frame[6:_AT]])[None, :])[0])
    frame[4:6] = check >> 8, check & 0xFF
    return frame


_EMPTY = _empty_frame()


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def padded(data: bytes) -> bytes:
    """``data`` with bytes 255 up to a positive multiple of the unit."""
    return data + b"\xff" * (UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def to_mpeg(payload: bytes) -> bytes:
    """An MPEG audio file that carries ``payload``, whose size is a multiple of the unit."""
    n = len(payload) // UNIT
    frames = np.tile(_EMPTY, (n + 1, 1))
    frames[1:, _AT : _AT + UNIT] = np.frombuffer(payload, dtype=np.uint8).reshape(n, UNIT)
    total = (n + 1) * _FRAME
    points = [(_FRAME + n * i // 100 * _FRAME) * 256 // total for i in range(100)]
    table = b"Xing" + struct.pack(">III", 7, n, total) + bytes(min(255, x) for x in points)
    frames[0, _AT : _AT + len(table)] = np.frombuffer(table, dtype=np.uint8)
    value = b"\x00payload\x00" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">I", len(value)) + b"\x00\x00" + value
    return b"ID3\x03\x00\x00" + _synchsafe(len(tag)) + tag + frames.tobytes()


def _synced(raw: bytes) -> int:
    """Seven bits of each byte."""
    n = 0
    for x in raw:
        n = n << 7 | x & 0x7F
    return n


def _text(raw: bytes) -> str:
    """A text field: its first byte names the encoding."""
    kind = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(kind, "replace").removesuffix("\x00")


def _tags(raw: bytes) -> tuple[int, int, dict[str, str]]:
    """(start of the audio, its end, text tags) from ID3v2.2, 2.3 and 2.4 tags at the start and an ID3v1 tag at the end."""
    at, end, tags = 0, len(raw), {}
    while raw[at : at + 3] == b"ID3" and at + 10 <= end:
        version, flags = raw[at + 3], raw[at + 5]
        stop, k = min(end, at + 10 + _synced(raw[at + 6 : at + 10])), at + 10
        if flags & 0x40 and version > 2:  # an extended header, whose size counts itself from 2.4 on
            k += _synced(raw[k : k + 4]) if version > 3 else 4 + int.from_bytes(raw[k : k + 4], "big")
        name, head = (3, 6) if version == 2 else (4, 10)
        while k + head <= stop and raw[k : k + 1].isalnum():
            size = raw[k + name : k + 2 * name]
            n = _synced(size) if version > 3 else int.from_bytes(size, "big")
            if raw[k : k + 1] == b"T" and n:
                tags[raw[k : k + name].decode("latin-1")] = _text(raw[k + head : min(stop, k + head + n)])
            k += head + n
        at = stop + (10 if flags & 0x10 and version > 3 else 0)
    if end - at >= 128 and raw[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags["TAG"] = raw[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1")
    return at, end, tags


def _frames(raw: bytes, at: int, end: int) -> tuple[np.ndarray, list[Header], np.ndarray, int]:
    """(offset of each frame, kinds of header, kind of each frame, bytes that were skipped to find them)."""
    data = np.frombuffer(raw, dtype=np.uint8)
    kinds: dict[bytes, int] = {}
    headers: list[Header] = []
    where, what, skipped, synced = [], [], 0, False
    while at + 4 <= end:
        h = Header.of(raw[at : at + 4])
        # right after a frame a header counts if its frame fits; found by search, another or the end has to follow it
        if h is None or at + h.size > end or (not synced and at + h.size != end and Header.of(raw[at + h.size : at + h.size + 4]) is None):
            synced = False
            nxt = raw.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            skipped += nxt - at
            at = nxt
            continue
        n = (end - at) // h.size
        same = np.lib.stride_tricks.as_strided(data[at:], (n, 4), (h.size, 1))
        differs = np.flatnonzero((same != same[0]).any(axis=1))
        n = int(differs[0]) if len(differs) else n
        synced = True
        k = kinds.setdefault(raw[at : at + 4], len(kinds))
        if k == len(headers):
            headers.append(h)
        where.append(at + np.arange(n) * h.size)
        what.append(np.full(n, k))
        at += n * h.size
    skipped += max(0, end - at)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(where) if where else none), headers, (np.concatenate(what) if what else none), skipped


def read_mpeg(raw: bytes) -> dict:
    """What the file holds: payload, frames, exact duration, seek offsets, checks and tags.

    Bytes that belong to no frame are skipped and counted.  A file without any
    frame gives zero frames, no duration and an empty payload.
    """
    start, end, tags = _tags(raw)
    where, headers, what, skipped = _frames(raw, start, end)
    data = np.frombuffer(raw, dtype=np.uint8)
    checked = bad = 0
    for k, h in enumerate(headers):
        at = where[what == k]
        if h.protected and h.layer != 2 and len(at):
            side = h.side() if h.layer == 3 else h.allocation(int(data[at[0] + 3]))
            rows = data[at[:, None] + np.concatenate([[2, 3], np.arange(6, 6 + side)])]
            stored = data[at + 4].astype(np.uint32) << 8 | data[at + 5]
            checked += len(at)
            bad += int((crc16(rows) != stored).sum())
    table = None
    if len(where):
        h, at = headers[what[0]], int(where[0])
        x = at + 4 + 2 * h.protected + (h.side() if h.layer == 3 else 0)
        if raw[x : x + 4] in (b"Xing", b"Info"):
            flags, k, table = int.from_bytes(raw[x + 4 : x + 8], "big"), x + 8, {"kind": raw[x : x + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    table[name] = int.from_bytes(raw[k : k + 4], "big")
                    k += 4
            if flags & 4:
                table["seek"] = raw[k : k + 100]
            where, what = where[1:], what[1:]
        elif raw[at + 36 : at + 40] == b"VBRI":
            table = {"kind": "VBRI", "bytes": int.from_bytes(raw[at + 46 : at + 50], "big"), "frames": int.from_bytes(raw[at + 50 : at + 54], "big")}
            where, what = where[1:], what[1:]
    seconds = sum((Fraction(int((what == k).sum()) * h.samples, h.hz) for k, h in enumerate(headers)), Fraction(0))
    rows = [data[where[what == k][:, None] + np.arange(_AT, _AT + UNIT)] for k, h in enumerate(headers) if h.size >= _AT + UNIT]
    first = where[0] - headers[what[0]].size if table and len(where) else 0
    stated = not table or all(table.get(k, v) == v for k, v in (("frames", len(where)), ("bytes", int(where[-1] + headers[what[-1]].size - first) if len(where) else 0)))
    return {
        "payload": rows[0].tobytes() if len(rows) == 1 else b"".join(data[a + _AT : a + _AT + UNIT].tobytes() for a, k in zip(where.tolist(), what.tolist()) if headers[k].size >= _AT + UNIT),
        "frames": len(where),
        "seconds": seconds,
        "offsets": where,
        "runs": runs_of(where, np.array([h.size for h in headers], dtype=np.int64)[what] if len(where) else where),
        "stated": stated,
        "kbit": sorted({headers[k].kbit for k in np.unique(what).tolist()}),
        "checked": checked,
        "bad": bad,
        "skipped": skipped,
        "table": table,
        "tags": tags,
    }


def runs_of(offsets: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """Seek offsets of all frames as runs (first offset, frame size, number of frames) of frames of one size that follow each other."""
    if not len(offsets):
        return []
    new = np.concatenate([[True], (np.diff(offsets) != sizes[:-1]) | (sizes[1:] != sizes[:-1])])
    at = np.flatnonzero(new)
    return list(zip(offsets[at].tolist(), sizes[at].tolist(), np.diff(np.append(at, len(offsets))).tolist()))


_MEDIA = "doc_id long, n_bytes long, media binary"
_READ = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "frames long, duration_num long, duration_den long, bad_checksums long, skipped_bytes long, seek_runs array<struct<start:long,size:long,frames:long>>"
)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text (null: empty) as UTF-8, padded, in an MPEG audio file.

    Rows with the same doc_id (a number) are files of their own; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            i = 0
            while i < batch.num_rows:
                j, size, media = i, 0, []
                while j < batch.num_rows and size < _OUT:
                    media.append(to_mpeg(padded(data[offsets[j] : offsets[j + 1]].tobytes())))
                    size += len(media[-1])
                    j += 1
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(offsets[i : j + 1])), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                i = j

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _MEDIA)


def read_media(media: DataFrame) -> DataFrame:
    """Digests, exact duration (a fraction of seconds), checks and the seek offsets of all frames, as runs of equal frames, of each ``media``.

    media: doc_id, n_bytes, media.  A null file counts as an empty one; bytes
    that are no frames are skipped.  Files of any length are read whole, one at
    a time.  Layer II checksums cover a part whose size the frame's content
    tells and are not verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n_bytes, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media"))):
                raw = raw or b""
                x = read_mpeg(raw)
                payload, table = x["payload"], x["table"] or {}
                tail = zlib.crc32(payload[-32:])
                feature = f"frames={x['frames']};seconds={x['seconds']};kbit={','.join(map(str, x['kbit']))};table={table.get('kind', '-')}:{'ok' if table and x['stated'] else 'no'};checked={x['checked']};bad={x['bad']};skipped={x['skipped']}"
                rows.append(
                    (doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), tail, len(raw), hashlib.sha256(raw).hexdigest(), feature)
                    + (x["frames"], x["seconds"].numerator, x["seconds"].denominator, x["bad"], x["skipped"], [{"start": a, "size": z, "frames": m} for a, z, m in x["runs"]])
                )
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2 + [pa.int64()] * 5 + [pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64()), ("frames", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=[x.split()[0] for x in _READ.split(", ")])

    return media.mapInArrow(run, _READ)
