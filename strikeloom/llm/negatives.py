"""Hard negatives by Fagin's threshold algorithm.

An anchor's positives are its best rows of the same label; each positive opens a window of
scores, and the best rows of other labels inside the window are its hard negatives.

Vectors are dealt into blocks and anchors into blocks; each pair of blocks is one group.
Inside a group every dimension is a list of the vectors sorted by component. For an anchor
every list is read from the end that its sign favours (lists of a zero component are not
read), some places of all lists at a time. Each vector met for the first time is scored
at once by random access, as an integer inner product. The sum of the last contributions
read bounds every vector not met yet: the threshold. Reading stops when the threshold is
strictly below the k-th best score of every window (or below the window's lower end, while
the window holds fewer), so ties are all met. Results of groups hold k rows per window and
are merged by one window function.

Spark makes two searches: positives (lists of one label at a time, one window without
ends), then negatives (lists of the whole block, a window per positive). Equal rows are
counted before, so that copies of one vector do not fill a block.

Defined cases: rows with a null label, null id, null vector, or a null or non-finite
component take no part; missing trailing components count as 0; rows that share an id are
separate candidates, but never for an anchor of that id, which is asked once, with its
greatest vector and then label; ties go to the smaller id. Extra columns are ignored. Scores are
exact: 64-bit integers while no sum can pass 2^62, else Python integers; a score outside
64 bits is shown as the nearest long.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.llm.common import shared

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Vectors and anchors of a group, on average.
BLOCK_ROWS, ANCHOR_ROWS = 8192, 1024
#: Places of every list read before the threshold is looked at: at first, and at most.
FIRST_STEP, LAST_STEP = 16, 256


def participants(df: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, label, v, copies) of the rows that take part, equal rows counted; ``v`` = floor(scale * component)."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    rows = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))
    return rows.groupBy("vec_id", "label", "v").agg(F.count(F.lit(1)).alias("copies"))


def relabelled(df: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The label of each row whose id is divisible by ``every`` moved on by one."""
    moved = (F.col("label") + 1) % labels
    return df.withColumn("label", F.when(F.col("vec_id") % every == 0, moved).otherwise(F.col("label")))


class Lists:
    """The vectors of one group, sorted by every component."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray, copies: np.ndarray):
        self.x, self.ids, self.labels, self.copies = x, ids, labels, copies
        self.by = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        self.read = 0

    def search(self, q: np.ndarray, ok: np.ndarray, windows: list[tuple], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every window (low, high) of scores its k best allowed rows, ties by id: (rows, scores). ``ok`` masks the allowed rows."""
        n = len(self.x)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        met = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, self.x.dtype)
        depth, step = 0, FIRST_STEP
        if not up.size and not down.size:  # no list to read: every score is 0
            depth, met[:], rows, scores = n, True, np.flatnonzero(ok), np.zeros(int(ok.sum()), self.x.dtype)
        while depth < n:
            end = min(n, depth + step)
            new = met.copy()
            new[self.by[n - end:n - depth, up]] = True
            new[self.by[depth:end, down]] = True
            self.read += (end - depth) * (up.size + down.size)
            fresh = np.flatnonzero(new & ~met & ok)
            met, depth, step = new, end, min(2 * step, LAST_STEP)
            rows, scores = np.concatenate([rows, fresh]), np.concatenate([scores, self.x[fresh] @ q])
            if met.all():
                break
            last = np.concatenate([self.x[self.by[n - depth, up], up] * q[up], self.x[self.by[depth - 1, down], down] * q[down]]).sum()
            if all(last < self.least(scores, low, high, k) for low, high in windows):
                break
        out = []
        for low, high in windows:
            inside = np.flatnonzero(within(scores, low, high))
            best = inside[np.lexsort((self.ids[rows[inside]], -scores[inside]))][:k]
            out.append((rows[best], scores[best]))
        return out

    def least(self, scores: np.ndarray, low, high, k: int):
        """What a vector not met must reach to matter: the k-th best score of the window, else its lower end."""
        inside = scores[within(scores, low, high)]
        if len(inside) >= k:
            return np.partition(inside, len(inside) - k)[len(inside) - k] if inside.dtype != object else sorted(inside)[-k]
        return -np.inf if low is None else low


def within(scores: np.ndarray, low, high) -> np.ndarray:
    ok = np.ones(len(scores), bool)
    if low is not None:
        ok &= (scores >= low).astype(bool)
    if high is not None:
        ok &= (scores <= high).astype(bool)
    return ok


def dense(column: pa.Array, width: int) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


FOUND = "anchor_id long, place int, vec_id long, score decimal(38,0)"
SCHEMA = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.decimal128(38, 0))])
_MOST = 10**38 - 1


def _group(k: int, same: bool):
    """Searches of one group; ``same`` looks for rows of the anchor's label, else for rows of others in the anchor's windows."""

    def run(table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy().astype(bool)
        ids, labels, copies = (table.column(c).to_numpy() for c in ("vec_id", "label", "copies"))
        lists = table.column("v").combine_chunks()
        values = dense(lists, int(np.diff(lists.offsets.to_numpy()).max(initial=0)))
        most = float(np.abs(values.astype(float)).max(initial=0)) ** 2 * max(values.shape[1], 1)
        if most >= 2.0**62:
            values = values.astype(object)
        if same:
            windows = [[(None, None)]] * len(ids)
        else:
            windows = [[(-(-LOW * int(s) // 100), HIGH * int(s) // 100) for s in found or []] for found in table.column("found").to_pylist()]
        out: list[tuple] = []
        for label in np.unique(labels[asked]).tolist() if same else [None]:
            mine = ~asked if label is None else ~asked & (labels == label)
            if not mine.any():
                continue
            held = Lists(values[mine], ids[mine], labels[mine], copies[mine])
            for i in np.flatnonzero(asked if label is None else asked & (labels == label)).tolist():
                ok = (held.ids != ids[i]) & ((held.labels == labels[i]) == same)
                for place, (rows, scores) in enumerate(held.search(values[i], ok, windows[i], k)):
                    left = k
                    for row, score in zip(rows.tolist(), scores.tolist()):
                        again = min(left, int(held.copies[row]))  # equal rows count each for itself
                        out += [(int(ids[i]), place, int(held.ids[row]), max(-_MOST, min(_MOST, int(score))))] * again
                        left -= again
                        if not left:
                            break
        columns = list(zip(*out)) or [[]] * 4
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                         pa.array([Decimal(s) for s in columns[3]], pa.decimal128(38, 0))], schema=SCHEMA)

    return run


def _search(vectors: DataFrame, anchors: DataFrame, blocks: int, parts: int, k: int, same: bool) -> DataFrame:
    """anchor_id, place (of the window), vec_id, score, rank: the k best of every window."""

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    none = F.lit(None).cast("array<decimal(38,0)>").alias("found")
    candidates = vectors.select(
        F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), F.lit(False).alias("asked"),
        "vec_id", "label", "v", "copies", none)
    wanted = anchors.select(
        every(blocks).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("asked"),
        "vec_id", "label", "v", F.lit(1).cast("long").alias("copies"), none if same else F.col("found"))
    found = candidates.unionByName(wanted).groupBy("block", "part").applyInArrow(_group(k, same), FOUND)
    best = Window.partitionBy("anchor_id", "place").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, block_rows: int = BLOCK_ROWS,
         anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.

    ``vectors`` is made by ``participants``; ``anchors`` are some of its rows.
    """
    held = shared(vectors, "vectors")
    blocks = max(1, -(-held.count() // block_rows))
    asked = shared(anchors.groupBy("vec_id").agg(F.max(F.struct("v", "label")).alias("top")).select("vec_id", "top.label", "top.v"), "anchors")
    parts = max(1, -(-asked.count() // anchor_rows))
    near = shared(_search(held, asked, blocks, parts, positives, True).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), "rank"), "positives")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))), lambda p: p["positive_score"])
    windows = near.groupBy("anchor_id").agg(scores.alias("found")).withColumnRenamed("anchor_id", "vec_id")
    far = _search(held, asked.join(windows, "vec_id"), blocks, parts, negatives, False)
    windowed = near.withColumnRenamed("rank", "positive_rank")
    pairs = far.withColumn("positive_rank", F.col("place") + 1).join(windowed, ["anchor_id", "positive_rank"])

    def long(c: str):
        return F.greatest(F.least(F.col(c), F.lit(2**63 - 1).cast("decimal(38,0)")), F.lit(-(2**63)).cast("decimal(38,0)")).cast("long").alias(c)

    return pairs.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), long("positive_score"), long("score").alias("negative_score"), "positive_rank")
