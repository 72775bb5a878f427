"""Media columns: Netpbm and BMP in numpy, area resizing by integral images, NPY tiles, difference hashes.

``decode`` reads P1 to P6 and uncompressed BMP (8-bit palette, 24 and 32 bit) into
``uint8`` arrays (16-bit Netpbm samples into ``uint16``), ``encode`` writes P5, P6 and 24-bit BMP. ``tile``
averages the source area below every target sample exactly, by differences of an
integral image at fractional edges. ``difference_hash`` compares neighbours of a 9 x 8
grey tile. ``store_texts`` keeps a text as the samples of a PPM, ``describe`` reads the
stored bytes back.

Defined cases: a null or empty text is one row of padding; null ids stay null; equal
texts get equal values; a damaged or null media value gets null features and an
``error``; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strikeloom.llm.common import passes

#: A row of 64 RGB samples; payloads are padded with spaces to whole rows.
ROW_BYTES, PAD = 192, 32
TILE = (16, 16)


def encode(samples: np.ndarray, kind: str) -> bytes:
    """Samples (height x width, or height x width x 3) as ``P5``, ``P6`` or ``BMP``."""
    height, width = samples.shape[:2]
    if kind in ("P5", "P6"):
        return b"%s\n%d %d\n255\n" % (kind.encode(), width, height) + np.ascontiguousarray(samples, np.uint8).tobytes()
    stride = -(-width * 3 // 4) * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, : width * 3] = samples[::-1, :, ::-1].reshape(height, width * 3)
    head = np.array([54 + body.size, 0, 54, 40], "<u4").tobytes() + np.array([width, height], "<i4").tobytes() + np.array([1, 24], "<u2").tobytes()
    return b"BM" + head + np.array([0, body.size, 2835, 2835, 0, 0], "<u4").tobytes() + body.tobytes()


_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def _netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[:2], 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        numbers.append(int(m[1]))
        at = m.end()
    width, height, most = (*numbers, 1)[:3]
    planes = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * planes
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        flat = np.array(re.findall(rb"[01]", body) if kind == b"P1" else body.split(), dtype=np.int64)
    elif kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, -(-width // 8) * height, at + 1).reshape(height, -1), axis=1)
        flat = bits[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, count, at + 1)
    if flat.size < count:
        raise ValueError("samples are missing")
    flat = flat[:count].astype(np.uint16 if most > 255 else np.uint8)
    if kind in (b"P1", b"P4"):
        flat = (1 - flat) * np.uint8(255)
    return flat.reshape((height, width, 3) if planes == 3 else (height, width))


def _bmp(data: bytes) -> np.ndarray:
    start, header = (int(x) for x in np.frombuffer(data, "<u4", 2, 10))
    width, height = (int(x) for x in np.frombuffer(data, "<i4", 2, 18))
    bits, packed = int(np.frombuffer(data, "<u2", 1, 28)[0]), int(np.frombuffer(data, "<u4", 1, 30)[0])
    if packed or bits not in (8, 24, 32):
        raise ValueError(f"BMP with {bits} bits and compression {packed}")
    stride = -(-width * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        palette = np.frombuffer(data, np.uint8, start - 14 - header, 14 + header).reshape(-1, 4)
        return palette[rows][:, :, 2::-1].copy()
    return rows.reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    if data[:2] in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        return _netpbm(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def integral(grey: np.ndarray) -> np.ndarray:
    out = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1), np.int64)
    np.cumsum(grey, axis=0, out=out[1:, 1:])
    np.cumsum(out[1:, 1:], axis=1, out=out[1:, 1:])
    return out


def tile(grey: np.ndarray, height: int, width: int, table: np.ndarray | None = None) -> np.ndarray:
    """Mean of the area of ``grey`` below each of height x width target samples."""
    table = integral(grey) if table is None else table

    def edges(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(parts + 1) * n
        whole = np.minimum(at // parts, n - 1)
        return whole, (at - whole * parts) / parts

    y, fy = edges(grey.shape[0], height)
    x, fx = edges(grey.shape[1], width)
    rows = table[y] * (1 - fy)[:, None] + table[y + 1] * fy[:, None]
    corner = rows[:, x] * (1 - fx) + rows[:, x + 1] * fx
    area = np.diff(np.diff(corner, axis=0), axis=1)
    return area * (height * width) / (grey.shape[0] * grey.shape[1])


def grey(samples: np.ndarray) -> np.ndarray:
    return samples.sum(axis=2, dtype=np.int64) if samples.ndim == 3 else samples.astype(np.int64)


def difference_hash(small: np.ndarray) -> str:
    """16 hex digits: which samples of an 8 x 9 tile are smaller than their right neighbour."""
    return np.packbits(small[:, :-1] + 1e-6 < small[:, 1:]).tobytes().hex()


def npy(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, samples, allow_pickle=False)
    return out.getvalue()


def features(data: bytes, size: tuple[int, int] = TILE) -> tuple[np.ndarray, str, bytes]:
    """Decoded samples, difference hash and NPY tile of one media value."""
    samples = decode(data)
    flat = grey(samples)
    table = integral(flat)
    planes = 3 if samples.ndim == 3 else 1
    small = np.clip(np.rint(tile(flat, *size, table) / planes), 0, np.iinfo(samples.dtype).max).astype(samples.dtype)
    return samples, difference_hash(tile(flat, 8, 9, table)), npy(small)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text, padded to whole rows, as a 64-pixel-wide PPM."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            sizes, media = [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                payload = raw.ljust(max(1, -(-len(raw) // ROW_BYTES)) * ROW_BYTES, bytes([PAD]))
                sizes.append(len(raw))
                media.append(encode(np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES // 3, 3), "P6"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=kinds)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def describe(media: DataFrame, size: tuple[int, int] = TILE) -> DataFrame:
    """Reads the stored bytes: digests of samples and media, difference hash, NPY tile."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary()), ("error", pa.string())]
    kinds = pa.schema(fields)

    def one(data: bytes | None) -> tuple:
        try:
            samples, code, small = features(data or b"", size)
        except (ValueError, IndexError, TypeError) as wrong:
            return None, None, None, len(data or b""), hashlib.sha256(data or b"").hexdigest(), None, None, str(wrong)
        payload = samples.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), code, small, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, "media"):
            found = list(zip(*map(one, batch.column(2).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(found, kinds.types[2:]))], schema=kinds)

    text = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, error string"
    return media.selectExpr("cast(doc_id as long) as doc_id", "n_bytes", "media").mapInArrow(run, text)
