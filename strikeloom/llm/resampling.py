"""Quality selection by importance resampling.

Two generative models over hashed words and word pairs are counted: the target's on
labelled good documents (a bounded sample), the raw one's on all documents. A document's
log weight is the mean log ratio of its n-grams times their number, of which at most ``effective``
count; with None it is the plain ratio, the sum of all. The plain ratio multiplies the small
error that the target's small sample leaves in every n-gram by the length of the text, which
drops long good texts for short bad ones (figures in the README). Adding
Gumbel noise seeded by the document's id and taking the k greatest keys draws k documents
without replacement with probabilities proportional to the weights.

The k-th key is found exactly: rounds of counts by equal key intervals narrow down the
interval that holds it, and each round sends at most ``STEPS`` counts to the driver.

Defined cases: a null or empty text has the log weight ``EMPTY``; a null id draws like the
text ``null``; rows equal in id and key share one decision, so repeats of the k-th document
are all taken; k above the number of rows takes all; without labelled good
documents all log weights are 0; no rows give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeloom.llm.common import blobs, combine, passes, shared, summed, utf8, word_names, words

#: Labelled rows of the target model at most.
TRAIN_ROWS = 20_000
BITS = 16
ADD = 1.0
EMPTY = -50.0
#: N-grams that count in a text at most.
EFFECTIVE = 100
STEPS, FEW = 4096, 4096
SEED = 11


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and word pairs, and the text of each."""
    values, offsets = utf8(column)
    starts, ends, bounds = words(values, offsets)
    names = word_names(values, starts, ends)
    owner = np.repeat(np.arange(offsets.size - 1), np.diff(bounds))
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    both = np.concatenate([names, combine(names[pair], names[pair + 1])])
    return (both >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate([owner, owner[pair]])


def log_ratios(docs: DataFrame, good: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray:
    """ln p_target - ln p_raw of every bucket; ``good`` (doc_id) names target documents."""
    size = 1 << BITS
    sample = good.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("good", F.lit(True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size), np.int64)
        for batch in passes(batches):
            bucket, owner = ngrams(batch.column(0))
            total[0] += np.bincount(bucket, minlength=size)
            mine = np.array([bool(x) for x in batch.column(1).to_pylist()])[owner]
            total[1] += np.bincount(bucket[mine], minlength=size)
        yield from blobs(total)

    marked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left").select("text", "good")
    raw, target = summed(marked.mapInArrow(run, "chunk int, counts binary"), (2, size))
    if not target.sum():
        return np.zeros(size)

    def logs(counts: np.ndarray) -> np.ndarray:
        # Each model backs off to the other's pool: a bucket's prior is its share of all n-grams.
        prior = (raw + ADD) / (raw.sum() + ADD * size)
        return np.log(counts + ADD * size * prior) - np.log(counts.sum() + ADD * size)

    return logs(target) - logs(raw)


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = SEED, effective: int | None = EFFECTIVE) -> DataFrame:
    """doc_id, log_weight, key (log weight plus Gumbel noise)."""
    shipped = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in passes(batches):
            bucket, owner = ngrams(batch.column(1))
            n = np.bincount(owner, minlength=batch.num_rows)
            weight = np.bincount(owner, table[bucket], batch.num_rows)
            if effective is not None:
                weight = weight * (np.minimum(n, effective) / np.maximum(n, 1))
            weight = np.where(n > 0, weight, EMPTY).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight)], ["doc_id", "log_weight"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, log_weight double")
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 11)
    uniform = (bits.cast("double") + 0.5) / float(2**53)
    return scored.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def kth(keys: DataFrame, k: int) -> tuple[float, int | None] | None:
    """Key and id of the k-th row by falling key, then rising id; None if there are fewer rows."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("*")).first()
    if k >= n or k < 1:
        return None
    left, part = k, keys
    while n > FEW and high > low:
        width = (high - low) / STEPS
        step = F.least(F.lit(STEPS - 1), F.floor((F.col("key") - low) / width)).cast("int")
        rows = part.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for r in sorted(rows, key=lambda r: -r["step"]):
            if left <= r["n"]:
                break
            left -= r["n"]
        if r["low"] == low and r["high"] == high:
            break
        low, high, n = r["low"], r["high"], r["n"]
        part = keys.where(F.col("key").between(low, high))
    # What is left is few rows, or rows that share one key.
    at = part.groupBy("key", "doc_id").count().orderBy(F.desc("key"), F.col("doc_id").asc_nulls_last())
    if high > low:
        for r in at.collect():
            left -= r["count"]
            if left <= 0:
                return r["key"], r["doc_id"]
    rank = at.limit(left).agg(F.max_by("doc_id", F.coalesce("doc_id", F.lit(2**63 - 1)))).first()
    return low, rank[0]


def resample(docs: DataFrame, good: DataFrame, k: int, seed: int = SEED, effective: int | None = EFFECTIVE) -> DataFrame:
    """The k sampled documents: doc_id, log_weight, key."""
    keys = shared(weigh(docs, log_ratios(docs, good), seed, effective), "keys")
    edge = kth(keys, k)
    if edge is None:
        return keys if k > 0 else keys.limit(0)
    key, doc_id = edge
    same = F.lit(True) if doc_id is None else F.col("doc_id") <= doc_id
    return keys.where((F.col("key") > key) | (F.col("key") == key) & same)
