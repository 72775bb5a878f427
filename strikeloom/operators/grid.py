"""Chain rows to cells, columns, weights, nodes and the selected nodes.

The chain is aggregated to cells first (map-side combine takes the raw volume);
every later step works on the grid, whose size is strikes x expiries per batch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.constants import (
    BATCH_INTERVAL_S, FEATURES, LAMBDA_BATCH, MAG_GAMMA, SHAPE_P, THETA,
)
from strikeloom.functions.ordered import ewma_scan
from strikeloom.functions.scalar import num, ratio_or, seconds_between, shape

BATCH = ("ticker", "ts")
COLUMN = ("ticker", "ts", "expiry")


def net_gex() -> Column:
    return F.col("call_gex") - F.col("put_gex")


def cell_flow() -> Column:
    return (F.col("call_oi") - F.col("call_prev_oi")) + (F.col("put_oi") - F.col("put_prev_oi"))


def normalize(rows: DataFrame, numbers: Sequence[str], interval_s: float = BATCH_INTERVAL_S) -> DataFrame:
    """Typed rows with a ``keep`` flag.

    A row is dropped when it was fetched too far from its batch time, or has no
    usable strike or no expiry. Rows without a readable fetch time are kept.
    """
    off = F.abs(seconds_between("fetched_at", "ts")) > interval_s
    typed = rows.withColumn("strike", F.col("strike").try_cast("double"))
    for name in numbers:
        typed = typed.withColumn(name, num(name))
    bad = F.coalesce(off, F.lit(False)) | F.col("strike").isNull() | F.col("expiry").isNull()
    return typed.withColumn("keep", ~bad)


def batch_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(*BATCH).agg(
        F.count_if("keep").alias("n_rows"), F.count_if(~F.col("keep")).alias("n_dropped")
    )


def upper_median_spot(rows: DataFrame) -> DataFrame:
    """Upper median of the row spots per batch; 0 reads as missing.

    Prices are counted first, so a batch costs as many rows as it has price ticks.
    """
    counts = rows.where(F.col("spot_price").isNotNull()).groupBy(*BATCH, "spot_price").agg(
        F.count(F.lit(1)).alias("_c")
    )
    run = Window.partitionBy(*BATCH).orderBy("spot_price").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*BATCH)
    return (
        counts.withColumn("_end", F.sum("_c").over(run))
        .withColumn("_n", F.sum("_c").over(whole))
        .where(F.floor(F.col("_n") / 2) < F.col("_end"))
        .where(F.floor(F.col("_n") / 2) >= F.col("_end") - F.col("_c"))
        .select(*BATCH, F.when(F.col("spot_price") != 0, F.col("spot_price")).alias("spot"))
    )


def cells(chain: DataFrame) -> DataFrame:
    """One row per (batch, strike, expiry); ``abs_rows`` keeps the raw-row sum of abs(g)."""
    sums = [
        "call_gex", "put_gex", "call_oi", "put_oi", "call_prev_oi", "put_prev_oi", "call_volume",
        "put_volume", "call_ask_vol", "call_bid_vol", "put_ask_vol", "put_bid_vol",
    ]
    aggs = [f"sum({c}) AS {c}" for c in sums if c in chain.columns]
    aggs += ["sum(call_gex - put_gex) AS g", "sum(abs(call_gex - put_gex)) AS abs_rows", "count(1) AS n_rows"]
    extra = {"iv": "avg(iv) AS iv", "row_key": "min(row_key) AS row_key", "spot": "max(spot) AS spot"}
    aggs += [text for name, text in extra.items() if name in chain.columns]
    return chain.groupBy("ticker", "ts", "strike", "expiry").agg(*[F.expr(x) for x in aggs])


def with_first_spot(cells: DataFrame) -> DataFrame:
    """Batch spot: the strike of the first row of the batch in key order (see the chain adapter), of equal keys the least strike."""
    first = "min(CASE WHEN row_key IS NOT NULL THEN struct(row_key, strike IS NULL AS bare, strike) END) OVER (PARTITION BY ticker, ts)"
    return cells.selectExpr("* EXCEPT (row_key)", f"CAST(({first}).strike AS DOUBLE) AS spot")


def columns(cells: DataFrame) -> DataFrame:
    """Per-expiry sums of one batch."""
    return cells.groupBy(*COLUMN).agg(
        F.expr("sum(abs_rows) AS gmag"),
        F.expr("sum(g) AS net_col"),
        F.expr("sum(abs_rows * strike) AS com_num"),
        F.expr("sum(call_ask_vol + put_ask_vol) AS ask"),
        F.expr("sum(call_bid_vol + put_bid_vol) AS bid"),
        F.expr("sum((call_oi - call_prev_oi) + (put_oi - put_prev_oi)) AS doi"),
        F.expr("max(spot) AS spot"),
    )


def features(cols: DataFrame) -> DataFrame:
    """The seven column features, names as in ``constants.FEATURES``."""
    def signed(x):
        return f"CASE WHEN {x} < 0 THEN -ln(1 - {x}) ELSE ln(1 + {x}) END"

    return cols.selectExpr(
        "*",
        "ln(greatest(CAST(datediff(expiry, to_date(ts)) AS DOUBLE), 0.25D)) AS log_dte",
        "ln(gmag + 1) AS log_gmag",
        f"{signed('net_col')} AS net_col_sign_log",
        "(ask - bid) / (ask + bid + 1) AS askbid_imbalance",
        f"{signed('doi')} AS doi_migration",
        "CASE WHEN gmag > 0 AND spot > 0 THEN abs(com_num / gmag - spot) / spot ELSE 0D END AS com_dist_rel",
        "(hour(ts) * 60 + minute(ts)) / 1440D AS tod_frac",
    )


def psi(feats: DataFrame, gamma: float = MAG_GAMMA, theta: Sequence[float] = THETA) -> DataFrame:
    """Instant column weight; an all-zero column weighs 0, a zero net counts as positive."""
    dot = " + ".join([f"{theta[0]!r}D", *[f"({w!r}D) * {name}" for w, name in zip(theta[1:], FEATURES)]])
    sign = "CASE WHEN net_col >= 0 THEN 1D ELSE -1D END"
    return feats.selectExpr("*", f"CASE WHEN gmag = 0 THEN 0D ELSE {sign} * exp({gamma!r}D * ({dot})) END AS psi")


def batches(cols: DataFrame) -> DataFrame:
    """Batch list of each ticker with the previous batch time and the spot."""
    one = cols.groupBy(*BATCH).agg(F.expr("max(spot) AS spot"))
    return one.selectExpr("*", "lag(ts) OVER (PARTITION BY ticker ORDER BY ts) AS prev_ts",
                          "row_number() OVER (PARTITION BY ticker ORDER BY ts) AS seq")


def smoothed_weights(psi_cols: DataFrame, gap_s: float = BATCH_INTERVAL_S, lam: float = LAMBDA_BATCH) -> DataFrame:
    """Weights ``a`` smoothed over batches.

    The smoothing restarts at the first sight of an expiry, after a gap between
    batches, when the expiry was missing from the previous batch, and at an
    all-zero column (which sets 0).
    """
    info = batches(psi_cols).select("ticker", "ts", "prev_ts")
    joined = psi_cols.join(info, ["ticker", "ts"]).selectExpr("*", "lag(ts) OVER (PARTITION BY ticker, expiry ORDER BY ts) AS _last")
    gap = "(unix_micros(ts) - unix_micros(prev_ts)) / 1e6D"
    start = f"coalesce(_last IS NULL OR _last <> prev_ts OR {gap} > {float(gap_s)!r}D OR gmag = 0, true)"
    flagged = joined.selectExpr("* EXCEPT (_last)", f"{start} AS fresh_start")
    return ewma_scan(flagged, ["ticker", "expiry"], "ts", {"a": "psi"}, f"{-math.log(lam)!r}D", "fresh_start")


def fold_weights(psi_cols: DataFrame, gap_s: float = BATCH_INTERVAL_S, lam: float = LAMBDA_BATCH) -> DataFrame:
    """The same recursion as an array fold; for short histories and as a cross-check."""
    info = batches(psi_cols).select("ticker", "ts", "prev_ts")
    rows = psi_cols.join(info, ["ticker", "ts"]).groupBy("ticker", "expiry").agg(
        F.array_sort(F.collect_list(F.struct("ts", "prev_ts", "psi", "gmag"))).alias("rows")
    )
    empty = F.array().cast("array<struct<ts:timestamp,a:double>>")

    def step(acc, r):
        last = F.try_element_at(acc, F.lit(-1))
        keep = (last["ts"] == r["prev_ts"]) & (seconds_between(r["ts"], r["prev_ts"]) <= gap_s) & (r["gmag"] != 0)
        a = F.when(keep, F.lit(lam) * last["a"] + F.lit(1 - lam) * r["psi"]).otherwise(r["psi"])
        return F.concat(acc, F.array(F.struct(r["ts"].alias("ts"), a.alias("a"))))

    out = rows.select("ticker", "expiry", F.explode(F.aggregate("rows", empty, step)).alias("x"))
    return out.select("ticker", "x.ts", "expiry", "x.a")


def shaped(cells: DataFrame, p: float = SHAPE_P) -> DataFrame:
    """Within-column power basis ``h`` of the deduplicated cells."""
    rows = cells.selectExpr("*", "max(abs(g)) OVER (PARTITION BY ticker, ts, expiry) AS col_max")
    return rows.withColumn("h", shape("g", "col_max", p))


def cell_values(shaped_cells: DataFrame, weights: DataFrame) -> DataFrame:
    """C = a * h; a cell whose expiry has no weight counts 0."""
    w = weights.select(*COLUMN, "a")
    return shaped_cells.join(w, list(COLUMN), "left").withColumn(
        "c", F.coalesce("a", F.lit(0.0)) * F.col("h")
    )


def node_values(valued: DataFrame, value: str = "c") -> DataFrame:
    return valued.groupBy("ticker", "ts", "strike").agg(F.sum(value).alias("v"), F.max("spot").alias("spot"))


def display_weights(weights: DataFrame) -> DataFrame:
    mean = F.avg(F.abs("a")).over(Window.partitionBy(*BATCH))
    return weights.withColumn("w", F.when(mean == 0, 0.0).otherwise(ratio_or("a", mean, 0.0)))


def top_nodes(nodes: DataFrame, k: int = 6) -> DataFrame:
    """Ranks 1..k by size of the node value; equal sizes go to the smaller strike."""
    order = Window.partitionBy(*BATCH).orderBy(F.abs("v").desc(), F.col("strike").asc())
    return nodes.withColumn("node_rank", F.row_number().over(order)).where(F.col("node_rank") <= k)


def kings(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy(*BATCH).agg(
        F.max_by("strike", F.struct(F.abs("v"), -F.col("strike"))).alias("king"),
        F.max(F.abs("v")).alias("king_abs"),
    )


def stars(valued: DataFrame) -> DataFrame:
    """Largest cell of each expiry and of the whole batch (``global_star``)."""
    best = valued.groupBy(*COLUMN).agg(
        F.max_by("strike", F.struct(F.abs("c"), -F.col("strike"))).alias("star"),
        F.max_by("c", F.struct(F.abs("c"), -F.col("strike"))).alias("star_value"),
    )
    order = Window.partitionBy(*BATCH).orderBy(F.abs("star_value").desc(), "star", "expiry")
    return best.withColumn("global_star", F.row_number().over(order) == 1)
