"""Ordered and ranked computations that do not depend on one group fitting one task.

Window functions over a whole key put that key in a single task. The helpers
below split a key into chunks, solve each chunk on its own and add what the
earlier chunks contribute. The per-chunk summaries are small.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.functions.scalar import col

_BLOCK = 300.0  # decay exponent held by one block; e^300 leaves room for inputs to 1e177
_BACK = 4  # e^(-300 * 5) times the largest double is below the smallest one


def order_prefix(value) -> Column:
    """Integer that grows with the value, about 64 steps per power of two.

    Used to cut a group into ordered buckets that depend on the value alone, so a
    retried or repeated stage cuts it in the same place.
    """
    v = col(value).cast("double")
    a = F.abs(v)
    e = F.floor(F.log2(a)).cast("double")
    step = F.floor(a / F.pow(F.lit(2.0), e) * 64).cast("bigint") - 64
    code = (e.cast("bigint") + 1100) * 64 + step
    return F.when(v > 0, code).when(v < 0, -code).when(v == 0, F.lit(0).cast("bigint"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence, values: dict[str, Column],
                chunk: Column) -> DataFrame:
    """Running sums per key in ``order``; ``chunk`` must not decrease along that order."""
    keys = list(keys)
    src = df.withColumn("_chunk", chunk)
    for name, value in values.items():
        src = src.withColumn(f"_v_{name}", value)
    totals = src.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *keys, "_chunk",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in values],
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = src.join(carry, [*keys, "_chunk"])
    for name in values:
        out = out.withColumn(name, F.sum(f"_v_{name}").over(inside) + F.col(f"_c_{name}"))
    return out.drop("_chunk", *[f"_v_{n}" for n in values], *[f"_c_{n}" for n in values])


def ranked(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str] = (),
           descending: bool = False, out: str = "rank", tie_chunk: Column | None = None,
           count_out: str | None = None) -> DataFrame:
    """Exact row numbers of whole groups, split by ordered value buckets.

    ``tie_chunk`` is an ordered split of equal values (a prefix of the first tie
    column) for counts and other values of few levels, where one value may hold
    most rows; each level is then its own bucket.
    """
    keys = list(keys)
    bucket = order_prefix(F.col(value)) if tie_chunk is None else F.col(value)
    bucket = -bucket if descending else bucket
    extra = tie_chunk if tie_chunk is not None else F.lit(0)
    src = df.withColumn("_b", bucket).withColumn("_tb", extra)
    sizes = src.groupBy(*keys, "_b", "_tb").agg(F.count(F.lit(1)).alias("_size"))
    order = Window.partitionBy(*keys).orderBy("_b", "_tb")
    sizes = sizes.withColumn(
        "_before", F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    if count_out:
        whole = Window.partitionBy(*keys)
        sizes = sizes.withColumn(count_out, F.sum("_size").over(whole))
    first = F.col(value).desc() if descending else F.col(value).asc()
    inside = Window.partitionBy(*keys, "_b", "_tb").orderBy(first, *[col(t) for t in ties])
    return (
        src.join(sizes, [*keys, "_b", "_tb"])
        .withColumn(out, F.row_number().over(inside) + F.col("_before"))
        .drop("_b", "_tb", "_size", "_before")
    )


def average_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Ranks with ties sharing their mean rank, exact for groups of any size.

    Counting per distinct value first makes equal values one row.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_b", order_prefix(F.col(value)))
    sizes = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        counts.join(sizes, [*keys, "_b"])
        .withColumn("_lo", F.coalesce(F.sum("_c").over(inside), F.lit(0)) + F.col("_before"))
        .select(*keys, value, (F.col("_lo") + (F.col("_c") + 1) / 2).alias(out))
    )
    return df.join(ranks, [*keys, value])


def ewma_scan(df: DataFrame, keys: Sequence[str], order: str, values: dict[str, str], decay: str, start: str) -> DataFrame:
    """y = e^-d * y_prev + (1 - e^-d) * x along ``order``; rows with ``start`` set y = x.

    ``values`` maps each output to its input, ``decay`` and ``start`` are SQL
    expressions; all outputs share the decay and the restarts. Closed form over
    windows, cut into blocks of decay exponent so that no power overflows (inputs
    below 1e177). The sums of the ``_BACK`` blocks before a row's own are carried;
    anything older is below the smallest double whatever its size, also in the
    recursion.
    """
    key, b = ", ".join(keys), _BLOCK
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    xs = {f"_x{i}": f"CAST({x} AS DOUBLE)" for i, x in enumerate(values.values())}
    src = df.selectExpr("*", f"{start} AS _start", f"CASE WHEN {start} THEN 0D ELSE {decay} END AS _d")
    src = src.selectExpr("*", f"sum(CAST(_start AS INT)) OVER (PARTITION BY {key} ORDER BY {order} {run}) AS _seg")
    src = src.selectExpr("*", f"sum(_d) OVER (PARTITION BY {key}, _seg ORDER BY {order} {run}) AS _cum")
    gain = f"(CASE WHEN _start THEN 1D ELSE -expm1(-_d) END) * exp(_cum - floor(_cum / {b}D) * {b}D)"
    src = src.selectExpr("*", f"floor(_cum / {b}D) AS _blk", *[f"{x} * {gain} AS {name}" for name, x in xs.items()])

    def carried(x):
        parts = [f"sum({x}) OVER (PARTITION BY {key}, _seg, _blk ORDER BY {order} {run})"]
        for back in range(1, _BACK + 1):
            frame = f"RANGE BETWEEN {back} PRECEDING AND {back} PRECEDING"
            half = f"{math.exp(-b * back / 2)!r}D"  # the whole factor would underflow before it meets a large sum
            parts.append(f"coalesce(sum({x}) OVER (PARTITION BY {key}, _seg ORDER BY _blk {frame}), 0D) * {half} * {half}")
        return " + ".join(parts)

    helpers = ", ".join(["_start", "_seg", "_d", "_cum", "_blk", *xs])
    return src.selectExpr(f"* EXCEPT ({helpers})", *[
        f"exp(_blk * {b}D - _cum) * ({carried(x)}) AS {out}" for out, x in zip(values, xs)])
