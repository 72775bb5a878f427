"""Volatility and price-profile analytics over daily series and bars."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.functions.scalar import percentile_of_history, ratio

_UPTO = (Window.unboundedPreceding, 0)


def _own():
    return Window.partitionBy("ticker").orderBy("day")


def realised_volatility(bars: DataFrame, days: int = 20) -> DataFrame:
    """Annualised deviation of log returns and implied minus realised, once the window is full."""
    w = _own()
    ret = F.ln(F.col("close") / F.lag("close").over(w))
    rows = bars.withColumn("ret", ret)
    frame = w.rowsBetween(-(days - 1), 0)
    full = F.count("ret").over(frame) == days
    rows = rows.withColumn("rv", F.when(full, F.stddev("ret").over(frame) * math.sqrt(252.0)))
    return rows.withColumn("iv_minus_rv", F.col("iv") - F.col("rv"))


def iv_rank(bars: DataFrame, days: int = 252) -> DataFrame:
    """Position in the trailing min-max range and percentile among prior values."""
    w = _own()
    span = w.rowsBetween(-(days - 1), 0)
    lo, hi = F.min("iv").over(span), F.max("iv").over(span)
    rows = bars.withColumns({"iv_rank": ratio(F.col("iv") - lo, hi - lo), "_h": F.collect_list("iv").over(w.rowsBetween(-(days - 1), -1))})
    return rows.withColumn("iv_pctile", percentile_of_history("iv", "_h")).drop("_h")


def constant_tenors(rows: DataFrame, keys: list[str], tenors: dict[str, int]) -> DataFrame:
    """Volatility at fixed days to expiry, per key, from one row per expiry (``dte`` days, ``iv``).

    The expiries that bracket a tenor give total variances, which are interpolated in time; beyond the nearest or the
    farthest expiry its own volatility holds. Expiries that are over, or have no volatility, take no part.
    """
    live = rows.where((F.col("dte") > 0) & F.col("iv").isNotNull())
    point = F.struct("dte", "iv")
    sides = {}
    for name, t in tenors.items():
        sides[f"_lo_{name}"] = F.max(F.when(F.col("dte") <= t, point))
        sides[f"_hi_{name}"] = F.min(F.when(F.col("dte") >= t, point))
    out = live.groupBy(*keys).agg(*[c.alias(n) for n, c in sides.items()])
    for name, t in tenors.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        w_lo, w_hi = lo["iv"] ** 2 * lo["dte"], hi["iv"] ** 2 * hi["dte"]
        between = w_lo + (w_hi - w_lo) * (t - lo["dte"]) / (hi["dte"] - lo["dte"])
        out = out.withColumn(name, F.when(lo.isNull(), hi["iv"]).when(hi.isNull() | (lo["dte"] == hi["dte"]), lo["iv"]).otherwise(F.sqrt(between / t)))
    return out.drop(*sides)


def term_slope(near: Column, far: Column, flat: float = 0.0) -> tuple[Column, Column]:
    slope = near - far
    state = F.when(slope > flat, "backwardation").when(slope < -flat, "contango").otherwise("flat")
    return slope, state


def sigma_move(bars: DataFrame) -> DataFrame:
    """Today's move in units of the one-day move priced at the prior close."""
    w = _own()
    prev, vol = F.lag("close").over(w), F.lag("iv").over(w)
    return bars.withColumn("sigma", ratio(F.col("close") - prev, prev * vol / math.sqrt(252.0)))


def streaks(bars: DataFrame, value: str = "close", n: int = 5) -> DataFrame:
    """Signed length of the current run of rises or falls, and the change over n sessions."""
    w = _own()
    rows = bars.withColumn("_s", F.signum(F.col(value) - F.lag(value).over(w)))
    rows = rows.withColumn("_new", F.when(F.col("_s") == F.lag("_s").over(w), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(*_UPTO)))
    run = Window.partitionBy("ticker", "_run").orderBy("day")
    return rows.withColumns({
        "streak": F.coalesce(F.col("_s") * F.row_number().over(run), F.lit(0.0)), f"chg_{n}": ratio(F.col(value) - F.lag(value, n).over(w), F.abs(F.lag(value, n).over(w)))
    }).drop("_s", "_new", "_run")


def expected_move(spot: Column, iv: Column, days: dict[str, float], year: float = 365.0) -> dict[str, Column]:
    out = {}
    for name, k in days.items():
        half = spot * iv * math.sqrt(k / year)
        out[f"{name}_lo"], out[f"{name}_hi"] = spot - half, spot + half
    return out


def risk_reversal(quotes: DataFrame, target: float = 0.25) -> DataFrame:
    """25-delta call minus put volatility and the butterfly, from the strikes nearest that delta."""
    def nearest(iv, gap):
        return F.min_by(iv, F.struct(gap, F.col("strike"), F.col("seq")))

    out = quotes.groupBy("ticker", "expiry", "day").agg(
        nearest("call_iv", F.abs(F.col("call_delta") - target)).alias("call_iv"), nearest("put_iv", F.abs(F.col("put_delta") + target)).alias("put_iv"),
        nearest("call_iv", F.abs(F.col("call_delta") - 0.5)).alias("atm_iv"))
    return out.withColumns({"risk_reversal": F.col("call_iv") - F.col("put_iv"), "butterfly": (F.col("call_iv") + F.col("put_iv")) / 2 - F.col("atm_iv")})


def history_percentile(rows: DataFrame, keys: list[str], value: str, days: int = 252) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(-days, -1)
    return rows.withColumn("_h", F.collect_list(value).over(w)).withColumn(f"{value}_pctile", percentile_of_history(value, "_h")).drop("_h")


def anchored_vwap(prints: DataFrame, anchor: list[str], width: str = "minute", bands: float = 2.0) -> DataFrame:
    """VWAP from the anchor with deviation bands, and cumulative ask minus bid volume.

    Prints are summed per minute first, so the running sums see one row per minute.
    """
    p, v = F.col("price"), F.col("size")
    signed = F.when(F.col("side") == "ask", v).when(F.col("side") == "bid", -v).otherwise(0)
    bars = prints.groupBy(*anchor, F.date_trunc(width, "ts").alias("at")).agg(
        F.sum(v).alias("_v"), F.sum(p * v).alias("_pv"), F.sum(p * p * v).alias("_ppv"), F.sum(signed).alias("_s"))
    run = Window.partitionBy(*anchor).orderBy("at").rowsBetween(*_UPTO)
    bars = bars.withColumns({f"_c{c}": F.sum(c).over(run) for c in ("_v", "_pv", "_ppv")} | {"cum_side_volume": F.sum("_s").over(run)})
    mean = ratio("_c_pv", "_c_v")
    bars = bars.withColumn("vwap", mean)
    dev = F.sqrt(F.greatest(ratio("_c_ppv", "_c_v") - F.col("vwap") * F.col("vwap"), F.lit(0.0)))
    return bars.withColumns({"upper": F.col("vwap") + bands * dev, "lower": F.col("vwap") - bands * dev}).select(*anchor, "at", "vwap", "upper", "lower", "cum_side_volume")


def volume_profile(prints: DataFrame, keys: list[str], bin_width: float) -> DataFrame:
    """Volume per price bin with the point of control (largest bin, lower price on ties)."""
    bins = prints.groupBy(*keys, (F.floor(F.col("price") / bin_width) * bin_width).alias("bin")).agg(F.sum("size").alias("volume"))
    order = Window.partitionBy(*keys).orderBy(F.col("volume").desc(), "bin")
    return bins.withColumn("is_poc", F.row_number().over(order) == 1)
