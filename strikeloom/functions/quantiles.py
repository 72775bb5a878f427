"""Exact quantiles under four index rules, for groups of any size.

``upper``    s[floor(p*n)], so the median is the upper one
``nearest``  s[round(p*(n-1))], half to even
``lower``    s[floor(p*(n-1))]
``linear``   interpolation between the two neighbours
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.functions.ordered import order_prefix

RULES = ("upper", "nearest", "lower", "linear")


def index_of(n: Column, p: float, rule: str) -> Column:
    """Zero-based position (fractional for ``linear``) of quantile p among n values."""
    top = (n - 1).cast("double")
    if rule == "upper":
        pos = F.floor(n * F.lit(p)).cast("double")
    elif rule == "nearest":
        pos = F.bround(F.lit(p) * top, 0)
    elif rule == "lower":
        pos = F.floor(F.lit(p) * top).cast("double")
    elif rule == "linear":
        pos = F.lit(p) * top
    else:
        raise ValueError(rule)
    return F.greatest(F.least(pos, top), F.lit(0.0))


def array_quantile(values: Column, p: float, rule: str) -> Column:
    """Quantile of a small array, for groups whose size is bounded by their meaning."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    pos = index_of(n, p, rule)
    lo = F.floor(pos)
    at = lambda i: F.try_element_at(ordered, (i + 1).cast("int"))
    if rule != "linear":
        picked = at(lo)
    else:
        picked = at(lo) + (pos - lo) * (F.coalesce(at(lo + 1), at(lo)) - at(lo))
    return F.when(n > 0, picked)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    picks: dict[str, tuple[float, str]]) -> DataFrame:
    """One row per group with the named quantiles and ``n``.

    Values are counted first, groups are then cut into ordered buckets and only
    the buckets that hold a wanted position are sorted.
    """
    keys = list(keys)
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_b", order_prefix(F.col("_v")))
    )
    # Stated here so that both uses below plan the same exchange and share it.
    for c in (*keys, "_b"):
        counts = counts.where(F.col(c).isNotNull())
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    whole = Window.partitionBy(*keys)
    run = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    buckets = (
        buckets.withColumn("_end", F.sum("_n").over(run))
        .withColumn("n", F.sum("_n").over(whole))
        .withColumn("_begin", F.col("_end") - F.col("_n"))
    )
    wanted = []
    for name, (p, rule) in picks.items():
        pos = index_of(F.col("n"), p, rule)
        lo = F.floor(pos)
        wanted.append(F.struct(F.lit(f"{name}.lo").alias("w"), lo.alias("i"), (pos - lo).alias("f")))
        if rule == "linear":
            hi = F.least(lo + 1, F.col("n") - 1)
            wanted.append(F.struct(F.lit(f"{name}.hi").alias("w"), hi.alias("i"), (pos - lo).alias("f")))
    targets = (
        buckets.withColumn("_t", F.explode(F.array(*wanted)))
        .where((F.col("_t.i") >= F.col("_begin")) & (F.col("_t.i") < F.col("_end")))
        .groupBy(*keys, "_b", "_begin", "n")
        .agg(F.collect_list("_t").alias("_ts"))
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        counts.join(targets, [*keys, "_b"])
        .withColumn("_hi", F.sum("_c").over(inside) + F.col("_begin"))
        .withColumn("_t", F.explode("_ts"))
        .where((F.col("_t.i") < F.col("_hi")) & (F.col("_t.i") >= F.col("_hi") - F.col("_c")))
    )
    if keys:
        out = picked.groupBy(*keys)
    else:
        out = picked.groupBy()
    cols = [F.max("n").alias("n")]
    for name, (p, rule) in picks.items():
        lo = F.max(F.when(F.col("_t.w") == f"{name}.lo", F.col("_v")))
        if rule == "linear":
            hi = F.max(F.when(F.col("_t.w") == f"{name}.hi", F.col("_v")))
            frac = F.max(F.when(F.col("_t.w") == f"{name}.lo", F.col("_t.f")))
            cols.append((lo + frac * (hi - lo)).alias(name))
        else:
            cols.append(lo.alias(name))
    return out.agg(*cols)
