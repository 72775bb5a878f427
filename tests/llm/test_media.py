import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strikeloom.llm import media


def brute_tile(grey, height, width):
    """Area means by splitting every sample into height x width equal parts."""
    big = np.repeat(np.repeat(grey, height, axis=0), width, axis=1)
    h, w = grey.shape
    return big.reshape(height, h, width, w).mean(axis=(1, 3))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 13), st.integers(1, 17), st.integers(1, 9), st.integers(1, 9), st.integers(0, 99))
def test_area_means(h, w, height, width, seed):
    grey = np.random.default_rng(seed).integers(0, 256, (h, w))
    assert np.allclose(media.tile(grey, height, width), brute_tile(grey, height, width))


@pytest.mark.parametrize("kind,shape", [("P5", (7, 5)), ("P6", (7, 5, 3)), ("BMP", (7, 5, 3)), ("BMP", (1, 4, 3))])
def test_round_trip(kind, shape):
    samples = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (media.decode(media.encode(samples, kind)) == samples).all()


def test_other_forms():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n010").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 255 7 9").tolist() == [[7, 9]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    palette = np.array([[1, 2, 3, 0], [4, 5, 6, 0]], np.uint8)
    head = b"BM" + np.array([54 + 8 + 4, 0, 54 + 8, 40], "<u4").tobytes() + np.array([2, -1], "<i4").tobytes() + np.array([1, 8], "<u2").tobytes() + bytes(24)
    assert media.decode(head + palette.tobytes() + bytes([1, 0, 0, 0])).tolist() == [[[6, 5, 4], [3, 2, 1]]]
    for bad in (b"", b"GIF", b"P6 9 9 255\n12", b"BM" + bytes(60)):
        with pytest.raises((ValueError, IndexError, TypeError)):
            media.decode(bad)


def test_texts_survive(odd, empty):
    stored = media.store_texts(odd)
    out = {(r["doc_id"], r["n_bytes"], r["payload_sha256"]): r for r in media.describe(stored).collect()}
    for d in odd.collect():
        raw = (d["text"] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = out[d["doc_id"], len(raw), hashlib.sha256(payload).hexdigest()]
        assert r["payload_bytes"] == len(payload) and r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["error"] is None
        assert np.load(io.BytesIO(r["tile"])).shape == media.TILE
        grey = np.frombuffer(payload, np.uint8).reshape(-1, 64, 3).sum(axis=2)
        small = brute_tile(grey, 8, 9)
        assert r["feature"] == np.packbits(small[:, :-1] + 1e-6 < small[:, 1:]).tobytes().hex()
    for r in stored.collect():
        key = [o for o in out.values() if o["media_sha256"] == hashlib.sha256(bytes(r["media"])).hexdigest()]
        assert key and key[0]["media_bytes"] == len(r["media"])
    assert media.describe(media.store_texts(empty)).count() == 0


def test_damaged_media_has_an_error(spark):
    df = spark.createDataFrame([(1, 3, bytearray(b"P6 9 9 255\n12")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert all(r["error"] and r["feature"] is None for r in media.describe(df).collect())
