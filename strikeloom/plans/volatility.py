"""Volatility, skew and price-profile analytics."""

from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.operators import volatility as vol
from strikeloom.plans.common import d, n, r, t
from strikeloom.plans.registry import query, view


@query("vol_1_realised_volatility", """
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, round(rv, 6) AS rv, round(iv - rv, 6) + 0.0 AS iv_minus_rv FROM (
  SELECT *, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w * sqrt(252.0::DOUBLE) END AS rv FROM (
    SELECT *, ln("close" / lag("close") OVER (PARTITION BY ticker ORDER BY day)) AS ret FROM bars) WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""")
def realised(spark, sf):
    return vol.realised_volatility(adapters.daily_bars(spark, sf)).select("ticker", d("day").alias("day"), r("rv").alias("rv"), r("iv_minus_rv").alias("iv_minus_rv"))


@query("vol_2_iv_rank", """
SELECT a.ticker, strftime(a.day, '%Y-%m-%d') AS day, round(any_value(a.rk), 6) AS iv_rank, round((count(*) FILTER (b.iv < a.iv) + 0.5::DOUBLE * count(*) FILTER (b.iv = a.iv)) / nullif(count(b.ticker), 0), 6) AS iv_pctile
FROM (SELECT *, (iv - min(iv) OVER w) / nullif(max(iv) OVER w - min(iv) OVER w, 0) AS rk FROM bars_n WINDOW w AS (PARTITION BY ticker ORDER BY day ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)) a
LEFT JOIN bars_n b ON a.ticker = b.ticker AND b.rn < a.rn AND a.rn - b.rn <= 251 GROUP BY a.ticker, a.day""")
def iv_rank(spark, sf):
    return vol.iv_rank(adapters.daily_bars(spark, sf)).select("ticker", d("day").alias("day"), r("iv_rank").alias("iv_rank"), r("iv_pctile").alias("iv_pctile"))


view("bars_n", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day) AS rn FROM bars")


def _tenor(name, t):
    """SQL of the volatility at ``t`` days from the bracketing expiries."""
    return f"""CASE WHEN lo_{name} IS NULL THEN hi_{name}.iv WHEN hi_{name} IS NULL OR lo_{name}.dte = hi_{name}.dte THEN lo_{name}.iv
      ELSE sqrt((pow(lo_{name}.iv, 2) * lo_{name}.dte + (pow(hi_{name}.iv, 2) * hi_{name}.dte - pow(lo_{name}.iv, 2) * lo_{name}.dte) * ({t} - lo_{name}.dte) / (hi_{name}.dte - lo_{name}.dte)::DOUBLE) / {t}) END AS {name}"""


TENORS = {"near": 9, "far": 30}
view("expiry_iv", """
SELECT ticker, CAST(ts AS DATE) AS day, date_diff('day', CAST(ts AS DATE), expiry) AS dte, avg(call_iv) AS iv FROM snapshots GROUP BY ALL""")


@query("vol_3_term_slope", f"""
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, round(near, 6) AS near, round(far, 6) AS far, round(near - far, 6) + 0.0 AS slope,
  CASE WHEN near - far > 0.005 THEN 'backwardation' WHEN near - far < -0.005 THEN 'contango' ELSE 'flat' END AS state FROM (
  SELECT ticker, day, {", ".join(_tenor(*x) for x in TENORS.items())} FROM (
    SELECT ticker, day, {", ".join(f"max(CASE WHEN dte <= {t} THEN {{'dte': dte, 'iv': iv}} END) AS lo_{x}, min(CASE WHEN dte >= {t} THEN {{'dte': dte, 'iv': iv}} END) AS hi_{x}" for x, t in TENORS.items())}
    FROM expiry_iv WHERE dte > 0 AND iv IS NOT NULL GROUP BY ticker, day))""")
def term_slope(spark, sf):
    rows = adapters.snapshots(spark, sf).groupBy("ticker", F.to_date("ts").alias("day"), "expiry").agg(F.avg("call_iv").alias("iv"))
    rows = rows.withColumn("dte", F.datediff("expiry", "day"))
    s = vol.constant_tenors(rows, ["ticker", "day"], TENORS)
    slope, state = vol.term_slope(F.col("near"), F.col("far"), 0.005)
    return s.select("ticker", d("day").alias("day"), r("near").alias("near"), r("far").alias("far"), r(slope).alias("slope"), state.alias("state"))


@query("vol_4_sigma_move", """
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, round(("close" - pc) / nullif(pc * pv / sqrt(252.0::DOUBLE), 0), 5) + 0.0 AS sigma FROM (
  SELECT *, lag("close") OVER w AS pc, lag(iv) OVER w AS pv FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day))""")
def sigma(spark, sf):
    return vol.sigma_move(adapters.daily_bars(spark, sf)).select("ticker", d("day").alias("day"), r("sigma", 5).alias("sigma"))


@query("vol_5_streaks", """
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, CAST(coalesce(s * row_number() OVER (PARTITION BY ticker, run ORDER BY day), 0) AS BIGINT) AS streak, round(chg, 6) + 0.0 AS chg_5 FROM (
  SELECT *, sum(CASE WHEN s = ps THEN 0 ELSE 1 END) OVER (PARTITION BY ticker ORDER BY day) AS run FROM (
    SELECT *, lag(s) OVER w AS ps FROM (SELECT *, sign("close" - lag("close") OVER w) AS s, ("close" - lag("close", 5) OVER w) / nullif(abs(lag("close", 5) OVER w), 0) AS chg FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY day))
    WINDOW w AS (PARTITION BY ticker ORDER BY day)))""")
def streaks(spark, sf):
    return vol.streaks(adapters.daily_bars(spark, sf)).select("ticker", d("day").alias("day"), n("streak").alias("streak"), r("chg_5").alias("chg_5"))


@query("vol_6_expected_move", """
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, round("close" - "close" * iv * sqrt(1 / 365.0::DOUBLE), 4) AS day_lo, round("close" + "close" * iv * sqrt(1 / 365.0::DOUBLE), 4) AS day_hi,
  round("close" - "close" * iv * sqrt(7 / 365.0::DOUBLE), 4) AS week_lo, round("close" + "close" * iv * sqrt(7 / 365.0::DOUBLE), 4) AS week_hi, round("close" + "close" * iv * sqrt(30 / 365.0::DOUBLE), 4) AS month_hi FROM bars""")
def expected_move(spark, sf):
    b = adapters.daily_bars(spark, sf)
    b = b.withColumns(vol.expected_move(F.col("close"), F.col("iv"), {"day": 1, "week": 7, "month": 30}))
    return b.select("ticker", d("day").alias("day"), *[r(c, 4).alias(c) for c in ("day_lo", "day_hi", "week_lo", "week_hi", "month_hi")])


view("skew", """
SELECT ticker, expiry, day, civ - piv AS risk_reversal, (civ + piv) / 2 - aiv AS butterfly FROM (
  SELECT ticker, expiry, CAST(ts AS DATE) AS day, arg_min(call_iv, row(abs(call_delta - 0.25), strike, seq)) AS civ, arg_min(put_iv, row(abs(put_delta + 0.25), strike, seq)) AS piv, arg_min(call_iv, row(abs(call_delta - 0.5), strike, seq)) AS aiv FROM snapshots GROUP BY ALL)""")


@query("vol_7_risk_reversal", """
SELECT a.ticker, strftime(a.expiry, '%Y-%m-%d') AS expiry, strftime(a.day, '%Y-%m-%d') AS day, round(any_value(a.risk_reversal), 6) + 0.0 AS risk_reversal, round(any_value(a.butterfly), 6) + 0.0 AS butterfly,
  round((count(*) FILTER (round(b.risk_reversal, 9) < round(a.risk_reversal, 9)) + 0.5::DOUBLE * count(*) FILTER (round(b.risk_reversal, 9) = round(a.risk_reversal, 9))) / nullif(count(b.ticker), 0), 6) AS pctile
FROM skew a LEFT JOIN skew b ON a.ticker = b.ticker AND a.expiry = b.expiry AND b.day < a.day GROUP BY a.ticker, a.expiry, a.day""")
def skew(spark, sf):
    s = adapters.snapshots(spark, sf).withColumn("day", F.to_date("ts"))
    rr = vol.risk_reversal(s).withColumn("risk_reversal", F.round("risk_reversal", 9))
    p = vol.history_percentile(rr, ["ticker", "expiry"], "risk_reversal")
    return p.select("ticker", d("expiry").alias("expiry"), d("day").alias("day"), r("risk_reversal").alias("risk_reversal"), r("butterfly").alias("butterfly"), r("risk_reversal_pctile").alias("pctile"))


@query("vol_8_anchored_vwap", """
SELECT ticker, strftime(mn, '%Y-%m-%d %H:%M:%S') AS minute, round(vwap, 5) AS vwap, round(vwap + 2 * sqrt(greatest(m2 - vwap * vwap, 0)), 3) AS upper, cum_side_volume FROM (
  SELECT ticker, mn, sum(pv) OVER w / nullif(sum(v) OVER w, 0) AS vwap, sum(ppv) OVER w / nullif(sum(v) OVER w, 0) AS m2, CAST(sum(s) OVER w AS BIGINT) AS cum_side_volume FROM (
    SELECT ticker, day, date_trunc('minute', ts) AS mn, sum(size) AS v, sum(price * size) AS pv, sum(price * price * size) AS ppv, sum(CASE side WHEN 'ask' THEN size WHEN 'bid' THEN -size ELSE 0 END) AS s FROM prints GROUP BY ALL)
  WINDOW w AS (PARTITION BY ticker, day ORDER BY mn))""")
def vwap(spark, sf):
    v = vol.anchored_vwap(adapters.prints(spark, sf), ["ticker", "day"])
    return v.select("ticker", t("at").alias("minute"), r("vwap", 5).alias("vwap"), r("upper", 3).alias("upper"), n("cum_side_volume").alias("cum_side_volume"))


@query("vol_8_volume_profile", """
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, bin, volume, row_number() OVER (PARTITION BY ticker, day ORDER BY volume DESC, bin) = 1 AS is_poc FROM (
  SELECT ticker, day, floor(price / 2.5::DOUBLE) * 2.5::DOUBLE AS bin, CAST(sum(size) AS BIGINT) AS volume FROM prints GROUP BY ALL)""")
def profile(spark, sf):
    return vol.volume_profile(adapters.prints(spark, sf), ["ticker", "day"], 2.5).select("ticker", d("day").alias("day"), "bin", n("volume").alias("volume"), "is_poc")
