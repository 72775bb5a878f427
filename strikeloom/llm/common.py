"""Helpers shared by the text operators: reading, shared tables, byte-level words in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strikeloom.session import scratch_dir

#: Bytes of text that one numpy pass works on at most, unless a single text is longer.
PASS_BYTES = 1 << 20

#: Bytes of an arrow batch between Spark and a task's Python.
ARROW_BYTES = 4 << 20

#: Columns of a count table that travel in one row.
CHUNK = 1 << 12

#: Odd multipliers of a 64-bit finaliser (fixed values, public-domain splitmix64).
MIX_A, MIX_B, MIX_C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an arrow batch: rows of text vary too much for a bound by rows. A setting of the user's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(ARROW_BYTES))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the cluster's shared folder and read it back.

    The table outlives lost executors and is removed with the application.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def passes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut arrow batches so that the named column holds about ``limit`` bytes in each; empty ones are left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def tidy(run: Callable) -> Callable:
    """The task function ``run``, giving freed memory back to the machine at its end: Spark keeps idle Python processes for later tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return task


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column end to end, and the offsets of its values; null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    size = int(offsets[-1] - offsets[0])
    values = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return values, offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def words(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than space and \\x09-\\x0D) of all texts.

    Returns the start and end byte of every word and, for each text, the index of
    its first word, with the total appended.
    """
    if not values.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(offsets.size, np.int64)
    ink = ~_SPACE[values]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    start = ink.copy()
    start[1:] &= ~ink[:-1]
    start[begins] = ink[begins]
    end = ink.copy()
    end[:-1] &= ~ink[1:]
    end[begins[1:] - 1] = ink[begins[1:] - 1]
    end[-1] = ink[-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_B)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_C)
    return x ^ (x >> np.uint64(31))


def word_names(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit fingerprint of every word: equal bytes, equal name, in whichever task."""
    if not starts.size:
        return np.zeros(0, np.uint64)
    letter = mix(np.arange(256, dtype=np.uint64) + np.uint64((seed * MIX_A) % 2**64))
    lengths = ends - starts
    places = mix(np.arange(int(lengths.max()) + 1, dtype=np.uint64) * np.uint64(MIX_A) + np.uint64(seed))
    out = np.empty(starts.size, np.uint64)
    # In slices of about PASS_BYTES letters: the arrays below hold eight bytes for each.
    total = np.cumsum(lengths)
    at = 0
    while at < starts.size:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PASS_BYTES, "right")))
        size, first = lengths[at:end], total[at:end] - lengths[at:end]
        first -= first[0]
        flat = np.arange(int(size.sum())) - np.repeat(first, size)
        # Letter and place are mixed before they are added: products with powers would collide for known pairs of words.
        inked = letter[values[flat + np.repeat(starts[at:end], size)]] ^ places[flat]
        inked *= np.uint64(MIX_B)
        inked ^= inked >> np.uint64(29)
        inked *= np.uint64(MIX_C)
        inked ^= inked >> np.uint64(32)
        out[at:end] = np.add.reduceat(inked, first)
        at = end
    return mix(out ^ lengths.astype(np.uint64))


def combine(*parts: np.ndarray) -> np.ndarray:
    """Name of a sequence of names, order kept."""
    out = np.full(parts[0].shape, MIX_A, np.uint64)
    for part in parts:
        out = mix(out * np.uint64(MIX_C) + part)
    return out


def blobs(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A table of counts in chunks of its columns; chunks without counts are left out."""
    rows = [(i // CHUNK, np.ascontiguousarray(total[:, i:i + CHUNK]).tobytes()) for i in range(0, total.shape[1], CHUNK) if total[:, i:i + CHUNK].any()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "counts"])


def summed(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the tasks' tables. Spark adds chunk by chunk; the driver receives one table of fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                numbers = np.frombuffer(counts.as_buffer(), np.int64)
                if chunk in total:
                    total[chunk] += numbers
                else:
                    total[chunk] = numbers.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    # A task holds a few chunks at most, however many partial tables there are.
    out = np.zeros(shape, np.int64)
    for row in parts.repartition("chunk").mapInArrow(tidy(add), "chunk int, counts binary").toLocalIterator():
        out[:, row["chunk"] * CHUNK:(row["chunk"] + 1) * CHUNK] += np.frombuffer(row["counts"], np.int64).reshape(shape[0], -1)
    return out
