import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm import media, registry


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=3000))
def test_round_trip(payload):
    got = media.media_to_bytes(media.bytes_to_media(payload))
    assert len(got) % 576 == 0 and len(got) >= 576 and got[: len(payload)] == payload
    assert set(got[len(payload) :]) <= {255} and len(got) - len(payload) <= 576


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(1, 12), st.integers(1, 12), st.integers(0, 2**31))
def test_area_resize_equals_supersampling(h, w, oh, ow, seed):
    pixels = np.random.default_rng(seed).integers(0, 256, (h, w)).astype(np.uint8)
    big = np.repeat(np.repeat(pixels.astype(float), oh, 0), ow, 1)
    want = big.reshape(oh, h, ow, w).mean((1, 3))
    assert np.allclose(media.area_resize(pixels, oh, ow), want)


def test_formats():
    rgb = np.random.default_rng(1).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    assert (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert (media.decode(media.encode_netpbm(rgb)) == rgb).all()
    assert media.decode(b"P2 # c\n2 1\n255\n7 9\n").tolist() == [[7, 9]]
    assert media.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    for bad in (b"", b"GIF89a", b"P5\n9 9\n255\nx", b"BM"):
        assert media._features(bad)["error"]
    tile = np.load(io.BytesIO(media.npy_tile(rgb, 4)))
    assert tile.shape == (4, 4, 3)
    ramp = np.tile(np.arange(90, dtype=np.uint8), (8, 1))
    assert media.difference_hash(ramp) == "ff" * 8 and media.difference_hash(ramp[:, ::-1]) == "00" * 8


def brute(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = registry.QUERIES["op3_media"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == brute(docs[r.doc_id])
        stored = media.bytes_to_media((docs[r.doc_id] or "").encode())
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_edge_rows(spark):
    rows = [(1, None, "w"), (2, "", "x"), (2, "", "x"), (None, "é" * 70000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, width string")
    got = registry.media_digest(media.media_features(media.text_to_media(df))).collect()
    assert len(got) == 4 and len({r.feature for r in got if r.n_bytes == 0}) == 1
    assert {(r.n_bytes, r.payload_bytes) for r in got} == {(0, 576), (140000, 140544)}
    nulls = media.media_features(spark.createDataFrame([(None,), (bytearray(b"zz"),)], "media binary")).collect()
    assert all(r.error and r.dhash is None for r in nulls)
    assert media.media_features(media.text_to_media(df.limit(0))).count() == 0


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_palette_bmp(bits):
    import struct

    palette = bytes([10, 20, 30, 0, 40, 50, 60, 0]) + bytes(4 * ((1 << bits) - 2))
    row = {1: b"\x40\0\0\0", 4: b"\x01\0\0\0", 8: b"\x00\x01\0\0"}[bits]
    start = 54 + len(palette)
    data = struct.pack("<2sIHHI", b"BM", start + 4, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, bits, 0, 4, 0, 0, 0, 0) + palette + row
    assert media.decode(data).tolist() == [[[30, 20, 10], [60, 50, 40]]]


def test_resizing_in_strips_is_the_same(monkeypatch):
    pixels = np.random.default_rng(5).integers(0, 256, (301, 17, 3), dtype=np.uint8)
    want = media.npy_tile(pixels), media.difference_hash(pixels)
    for strip in (1, 100, 5000):
        monkeypatch.setattr(media, "STRIP", strip)
        assert (media.npy_tile(pixels), media.difference_hash(pixels)) == want


def test_any_column_names(spark):
    df = spark.createDataFrame([(1, bytearray(media.bytes_to_media(b"x")), 7, "b")], "id int, media binary, Width int, `a.b` string")
    out = media.media_features(df)
    assert [c.lower() for c in out.columns].count("width") == 1 and out.first()["a.b"] == "b" and out.first()["payload_bytes"] == 576
