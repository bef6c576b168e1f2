import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plenum.llm import mpeg_audio as mp


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=4000))
def test_any_bytes_round_trip(data):
    payload = mp.padded(data)
    media = mp.encode(payload)
    info = mp.probe(media)
    assert mp.read_back(media, info) == payload and info["skipped"] == 0
    assert all(f[5] for f in info["frames"]) and info["table"]["frames"] == len(info["frames"])


def frame(kbps_index, version_bits=3, layer_bits=1, rate=0, pad=0, mode=0, protected=False):
    four = bytes([0xFF, 0xE0 | version_bits << 3 | layer_bits << 1 | (not protected), kbps_index << 4 | rate << 2 | pad << 1, mode << 6])
    length, *_, side = mp.header(four)
    crc = mp.crc16(four[2:4] + bytes(side)).to_bytes(2, "big") if protected else b""
    return (four + crc).ljust(length, b"\0")


def test_header_sizes_of_known_streams():
    assert mp.header(b"\xff\xfb\x90\x00")[:4] == (417, 1152, 44100, 128)  # MPEG-1 layer III, 128 kbit/s
    assert mp.header(b"\xff\xfb\x92\x00")[0] == 418
    assert mp.header(b"\xff\xf3\x80\x00")[:4] == (208, 576, 22050, 64)  # MPEG-2 layer III
    assert mp.header(b"\xff\xff\x40\x00")[:4] == (12 * 128000 // 44100 * 4, 384, 44100, 128)  # layer I
    assert mp.header(b"\xff\xfd\x84\x00")[:4] == (384, 1152, 48000, 128)  # layer II
    for bad in (b"\xff\xfb\x00\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"\xfe\xfb\x90\x00", b"\xff"):
        assert mp.header(bad) is None


def test_checksum_known_value():
    assert mp.crc16(b"123456789") == 0xAEE7  # CRC-16 with this polynomial and start, not reflected


def test_resynchronisation_after_foreign_bytes():
    good = frame(9) * 3
    data = b"\xff\xfb junk " + good + b"\xff\xff\xff\xfb\x90garbage" + good + good[:100]
    info = mp.probe(data)
    assert [f[0] for f in info["frames"]] == [8 + 417 * i for i in range(3)] + [8 + 1251 + 12 + 417 * i for i in range(3)]
    assert info["skipped"] == 8 + 12 + 100


def test_damaged_checksum_is_reported():
    media = bytearray(mp.encode(mp.padded(b"x" * 2000)))
    at = mp.probe(bytes(media))["frames"][1][0]
    media[at + 10] ^= 1
    assert [f[5] for f in mp.probe(bytes(media))["frames"]].count(False) == 1


def test_vbri_table_and_tags():
    first = bytearray(frame(9))
    first[36:40] = b"VBRI"
    first[46:50], first[50:54] = (834).to_bytes(4, "big"), (2).to_bytes(4, "big")
    first[54:62] = b"\0\2\0\1\0\2\0\1"
    first[62:66] = b"\1\xa1\1\xa1"
    info = mp.probe(bytes(first) + frame(9) * 2 + b"TAG" + b"Song".ljust(125, b"\0"))
    assert info["table"]["frames"] == 2 and info["table"]["toc"] == [417, 417] and len(info["frames"]) == 2
    assert info["tags"]["v1_title"] == "Song"


@pytest.mark.parametrize("data", [b"", b"\xff", b"ID3\x03\0\0\0\0\0\x7f", b"TAG".ljust(128, b"\0"), b"plain text"])
def test_streams_without_frames(data):
    assert mp.probe(data)["frames"] == []


def test_query_matches_plain_values(make_docs, store, spark):
    random.seed(1)
    rows = [(1, None), (2, ""), (3, "é" * 96), (4, "é" * 97), (5, "x" * 192), (5, "x" * 192), (None, "y"), (8, "".join(random.choices("ab \n", k=300_000)))]
    got = mp.query(spark, store(make_docs(rows))).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_bytes): r for r in got}
    for d, t in rows:
        raw = (t or "").encode()
        want = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = by[d, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert r.crc_bad == r.skipped_bytes == 0 and r.samples == 1152 * r.frames and abs(r.duration_s - r.samples / 48000) < 1e-9
        assert r.media_sha256 == hashlib.sha256(mp.encode(want, f"{len(raw)} bytes")).hexdigest() and len(r.frame_offsets) == r.frames
    assert mp.query(spark, store(make_docs([]))).count() == 0
