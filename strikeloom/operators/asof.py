"""Nearest as-of join, aligned-day statistics and snapshot cadence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.functions.quantiles import exact_quantiles


def nearest_asof(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
                 tolerance_s: float | None = None, chunk_s: int = 3600) -> DataFrame:
    """Attach to each left row the nearest right time of its key, either side.

    Equal distances take the earlier time. Beyond the tolerance ``match_ts`` is
    null and ``dist_s`` still tells how far the nearest one was.

    Time is cut into chunks, so a busy key is spread over many tasks; what a
    chunk needs from outside is the last right time before it and the first one
    after it, taken from one summary row per chunk.
    """
    keys = list(keys)

    def chunk(ts):
        return F.floor(F.unix_micros(ts) / F.lit(chunk_s * 1_000_000))

    times = right.select(*keys, F.col(right_ts).alias("_r")).distinct()
    rows = left.withColumns({"_t": F.unix_micros(left_ts), "_c": chunk(F.col(left_ts))})
    marks = times.withColumns({"_t": F.unix_micros("_r"), "_c": chunk(F.col("_r"))})
    both = rows.unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("_is_left", F.col("_r").isNull())

    spans = rows.select(*keys, "_c", F.lit(None).cast("timestamp").alias("_r")).unionByName(
        marks.select(*keys, "_c", "_r")
    ).groupBy(*keys, "_c").agg(F.max("_r").alias("_hi"), F.min("_r").alias("_lo"))
    by_chunk = Window.partitionBy(*keys).orderBy("_c")
    # What follows is read in falling order: a frame that reaches to the end is walked anew for every row.
    back = Window.partitionBy(*keys).orderBy(F.col("_c").desc())
    spans = spans.select(
        *keys, "_c",
        F.last("_hi", ignorenulls=True).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_lo", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    inside = Window.partitionBy(*keys, "_c").orderBy("_t")
    falling = Window.partitionBy(*keys, "_c").orderBy(F.col("_t").desc())
    both = both.withColumns({
        "_p": F.last("_r", ignorenulls=True).over(inside.rangeBetween(Window.unboundedPreceding, 0)),
        "_n": F.last("_r", ignorenulls=True).over(falling.rangeBetween(Window.unboundedPreceding, 0)),
    }).where("_is_left").join(spans, [*keys, "_c"])
    prev, nxt = F.coalesce("_p", "_before"), F.coalesce("_n", "_after")
    dp = F.col("_t") - F.unix_micros(prev)
    dn = F.unix_micros(nxt) - F.col("_t")
    take_prev = dn.isNull() | (dp <= dn)
    near = F.when(dp.isNotNull() & take_prev, prev).otherwise(nxt)
    dist = F.least(dp, dn) / F.lit(1e6)
    inside_tol = F.lit(True) if tolerance_s is None else dist <= tolerance_s
    out = both.withColumns({"match_ts": F.when(inside_tol, near), "dist_s": dist})
    return out.drop("_t", "_c", "_r", "_is_left", "_p", "_n", "_before", "_after")


def last_before(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str,
                payload: Sequence[str], out: str, chunk_s: int = 3600) -> DataFrame:
    """Attach the payload of the last right row at or before each left time, as a struct.

    Chunked in time like the nearest join: a chunk gets the last right row of the
    chunks before it.
    """
    keys = list(keys)

    def chunk(ts):
        return F.floor(F.unix_micros(ts) / F.lit(chunk_s * 1_000_000))

    rows = left.withColumns({"_t": F.unix_micros(left_ts), "_c": chunk(F.col(left_ts)), "_side": F.lit(1)})
    marks = right.select(*keys, F.unix_micros(right_ts).alias("_t"), chunk(F.col(right_ts)).alias("_c"), F.lit(0).alias("_side"),
                         F.struct(*payload).alias("_r"))
    spans = rows.select(*keys, "_c").distinct().join(
        marks.groupBy(*keys, "_c").agg(F.max_by("_r", "_t").alias("_hi")), [*keys, "_c"], "full")
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, "_c", F.last("_hi", ignorenulls=True).over(before).alias("_before"))
    both = rows.unionByName(marks, allowMissingColumns=True)
    seen = Window.partitionBy(*keys, "_c").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_in", F.last("_r", ignorenulls=True).over(seen)).where("_side = 1")
    return both.join(spans, [*keys, "_c"]).withColumn(out, F.coalesce("_in", "_before")).drop("_t", "_c", "_side", "_r", "_in", "_before")


def aligned_days(aligned: DataFrame, day: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Per day: instants, aligned pairs, upper-median and largest offset, usable flag."""
    rows = aligned.withColumn("_day", day).withColumn("_d", F.when(F.col("match_ts").isNotNull(), F.col("dist_s")))
    keys = [*keys, "_day"]
    base = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_instants"), F.count("_d").alias("n_aligned"), F.max("_d").alias("dist_max"))
    q = exact_quantiles(rows, keys, "_d", {"dist_median": (0.5, "upper"), "dist_p90": (0.9, "upper")}).drop("n")
    out = base.join(q, keys, "left").withColumn("usable", F.col("n_aligned") > 0)
    return out.withColumnRenamed("_day", "day")


def cadence(rows: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Distinct snapshot times per key and the min, upper-median and max gap between them.

    Times are cut by day: the first of a day takes the last one before it from a
    table of one row per key and day, so no key has to fit one task.
    """
    keys = list(keys)
    day = F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).alias("_day")
    times = rows.select(*keys, ts, day).distinct()
    ends = times.groupBy(*keys, "_day").agg(F.max(ts).alias("_last"))
    ends = ends.select(*keys, "_day", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_day")).alias("_before"))
    inside = Window.partitionBy(*keys, "_day").orderBy(ts)
    previous = F.coalesce(F.lag(ts).over(inside), F.col("_before"))
    gaps = times.join(ends, [*keys, "_day"]).withColumn("gap_s", (F.unix_micros(ts) - F.unix_micros(previous)) / F.lit(1e6))
    base = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_snapshots"), F.min("gap_s").alias("gap_min"), F.max("gap_s").alias("gap_max"))
    med = exact_quantiles(gaps, keys, "gap_s", {"gap_median": (0.5, "upper")}).drop("n")
    return base.join(med, keys, "left")


def zero_filled(target: DataFrame, model: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Model values on the target's grid; a target point the model lacks counts 0."""
    keys = list(keys)
    return target.join(model.select(*keys, F.col(value).alias("_v")), keys, "left").withColumn(
        value, F.coalesce("_v", F.lit(0.0))).drop("_v")


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per key on both sides; a key missing from either side shows 0 there."""
    keys = list(keys)
    left = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_left"))
    right = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_right"))
    out = left.join(right, keys, "full").fillna(0, ["n_left", "n_right"])
    return out.withColumn("agrees", F.col("n_left") == F.col("n_right"))


def leave_one_out(rows: DataFrame, fold: str, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Sums over all other folds next to the fold's own sums.

    Train sums are total minus own, so no row is copied once per fold.
    """
    keys = list(keys)
    own = rows.groupBy(*keys, fold).agg(*[F.sum(c).alias(f"test_{n}") for n, c in sums.items()])
    whole = Window.partitionBy(*keys)
    return own.withColumns({
        f"train_{n}": F.sum(f"test_{n}").over(whole) - F.col(f"test_{n}") for n in sums
    })


def bucketize(rows: DataFrame, keys: Sequence[str], value: str, edges: Sequence[float]) -> DataFrame:
    """Count and share per bucket of ascending upper edges, the last being the overflow."""
    keys = list(keys)
    label = F.lit(f">{edges[-1]}")
    for edge in reversed(edges):
        label = F.when(F.col(value) <= edge, f"<={edge}").otherwise(label)
    counts = rows.groupBy(*keys, label.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("frac", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def coverage(rows: DataFrame, keys: Sequence[str], ts: str, open_s: int = 48600, close_s: int = 72000) -> DataFrame:
    """Rows of the full day and of the session, distinct snapshots, first and last time."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    in_session = (second >= open_s) & (second < close_s)
    per_time = rows.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    return per_time.groupBy(*keys).agg(
        F.sum("_n").alias("rows_day"),
        F.sum(F.when(in_session, F.col("_n")).otherwise(0)).alias("rows_session"),
        F.count(F.lit(1)).alias("n_snapshots"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
    )


def completeness(rows: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows held against the expected count per key; ``complete`` is false for any difference."""
    keys = list(keys)
    held = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("held"))
    out = expected.join(held, keys, "full").fillna(0, ["held", "expected"])
    return out.withColumn("complete", F.col("held") == F.col("expected"))


def assert_complete(audit: DataFrame) -> None:
    bad = audit.where(~F.col("complete")).limit(5).collect()
    if bad:
        raise ValueError(f"row counts differ from the expected ones, for example {bad}")
