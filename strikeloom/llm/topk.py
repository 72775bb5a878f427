"""Exact top-k by inner product with no random access to the vectors' scores (NRA).

Vectors are dealt into blocks and queries into blocks; each pair of blocks is one
group. Inside a group every dimension is a list sorted by component. For a query the
lists are read in parallel from their favourable end, some places of all lists at a time.
Queries read together: an entry is touched once for a few hundred of them, and their bounds
are two matrix products over what has been read. That gives each vector a lower and an
upper bound:

* known part: the sum over the lists in which it has been seen;
* upper bound: for every other list, the last contribution read from it;
* lower bound: for every other list, that list's smallest contribution.

A vector whose upper bound is below the k-th best lower bound is out. A query stops reading when
only a few vectors are left; their final scores are then resolved. Lists of a zero component are
not read. Group results hold k rows a query and are merged by one window.

Defined cases: null vectors, vectors with a null or non-finite component and null ids
take no part; missing trailing components count as 0; rows that share an id are
separate candidates, but never for a query of that id; of queries that share an id the
greatest vector is asked; ties go to the smaller id. Extra columns are ignored.
Components are integers; bounds and products are 64-bit floats while all sums stay
exact (below 2^52), else Python integers; a score outside 64 bits is the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries of a group, on average.
BLOCK_ROWS, QUERY_ROWS = 4096, 1024
#: The lists are read in so many steps.
READS = 8
#: Reading stops early when so many vectors per wanted result are left.
LEFT_PER_K = 16
#: Bounds that a task holds at once: so many queries share a reading.
BOUNDS = 1 << 20


def integer_vectors(df: DataFrame, scale: float = 1024.0) -> DataFrame:
    """(vec_id, v) with ``v`` = floor(scale * component), for the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"))


class Lists:
    """Vectors of a group and, for every component, their rows and values from either end."""

    def __init__(self, x: np.ndarray):
        self.x, self.read = x, 0  # entries read so far
        rising = np.argsort(x, axis=0, kind="stable").astype(np.int32)
        values = np.take_along_axis(x, rising, axis=0)
        # The falling lists stand before the rising ones.
        self.rows, self.values = np.hstack([rising[::-1], rising]), np.hstack([values[::-1], values])

    def nra(self, q: np.ndarray, k: int, left_out: np.ndarray) -> np.ndarray:
        """Rows that can be among the k best for ``q``; ``left_out`` masks rows that are no candidates."""
        return self.nra_of_all(q[None, :], [k], [np.flatnonzero(~left_out)])[0]

    def nra_of_all(self, qs: np.ndarray, ks: list[int], allowed: list[np.ndarray]) -> list[np.ndarray]:
        """The same for several queries, which share what is read: of their candidates ``allowed``, those left.

        A list is read from an end for as long as a query that is not done needs it from there.
        """
        n = len(self.x)
        allowed, zero = list(allowed), self.x.dtype.type(0) if self.x.dtype != object else 0
        # A query takes part with its positive components in the falling lists, with its negative ones in the rising lists.
        weights = np.hstack([np.where(qs > 0, qs, zero), np.where(qs < 0, qs, zero)])
        live = np.array([i for i, q in enumerate(qs) if len(allowed[i]) > LEFT_PER_K * ks[i] and q.any()], np.int64)
        if not live.size:
            return allowed
        least = np.repeat(self.values[-1:], n, axis=0)  # what has been read; for the rest, the list's end
        unread = np.ones(least.shape, bool)
        for step in range(1, READS):
            begin, end = n * (step - 1) // READS, n * step // READS
            if begin == end:
                continue
            lists = np.flatnonzero((weights[live] != 0).any(axis=0))
            rows = self.rows[begin:end, lists]
            least[rows, lists], unread[rows, lists] = self.values[begin:end, lists], False
            self.read += rows.size
            # Of each list: the last entry read bounds the others from above, the last of all from below.
            asked = weights[live][:, lists]
            lower = asked @ least[:, lists].T
            upper = asked @ np.where(unread[:, lists], self.values[end - 1, lists], least[:, lists]).T
            for at, i in enumerate(live):
                low, k = lower[at, allowed[i]], ks[i]
                lowest = np.sort(low)[-k] if low.dtype == object else np.partition(low, len(low) - k)[len(low) - k]
                allowed[i] = allowed[i][(upper[at, allowed[i]] >= lowest).astype(bool)]
            live = live[[len(allowed[i]) > LEFT_PER_K * ks[i] for i in live]]
            if not live.size:
                break
        return allowed


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        asked = table.column("asked").to_numpy().astype(bool)
        ids = table.column("vec_id").to_numpy()
        lists = table.column("v").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy()
        width = int(lengths.max(initial=0))
        dense = np.zeros((len(ids), width), np.int64)
        dense[np.repeat(np.arange(len(ids)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        x, xid, q, qid = dense[~asked], ids[~asked], dense[asked], ids[asked]
        order = np.argsort(xid, kind="stable")
        x, xid = x[order], xid[order]
        most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(width, 1)
        kind = np.float64 if most < 2.0**52 else object
        xs, qs = x.astype(kind), q.astype(kind)
        out_q, out_v, out_s = [], [], []
        lists_of = Lists(xs) if len(x) else None
        together = max(1, BOUNDS // max(len(x), 1))
        for first in range(0, len(q) if len(x) else 0, together):
            some = [np.flatnonzero(xid != i) for i in qid[first:first + together]]
            left = lists_of.nra_of_all(qs[first:first + together], [min(k, len(s)) for s in some], some)
            for i, rows in enumerate(left, first):
                score = xs[rows] @ qs[i]
                best = sorted(range(len(rows)), key=lambda r: (-score[r], xid[rows[r]]))[:k] if len(rows) <= 4 * k or kind is object else np.lexsort((xid[rows], -score))[:k]
                out_q += [qid[i]] * len(best)
                out_v += [xid[rows[r]] for r in best]
                out_s += [max(-(2**63), min(2**63 - 1, int(score[r]))) for r in best]
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.int64())})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best candidates of every query: query_id, rank, vec_id, score.

    ``vectors`` and ``queries`` have ``vec_id`` and integer components ``v``.
    """
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    asked = queries.groupBy("vec_id").agg(F.max("v").alias("v"))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    candidates = vectors.select(
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"), every(parts).alias("part"), F.lit(False).alias("asked"), "vec_id", "v")
    wanted = asked.select(
        every(blocks).alias("block"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("asked"), "vec_id", "v")
    found = candidates.unionByName(wanted).groupBy("block", "part").applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
