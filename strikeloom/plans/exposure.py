"""Exposure display analytics."""

from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.operators import exposure, grid, state
from strikeloom.plans.common import d, d_cells, m_cells, n, r
from strikeloom.plans.registry import query, view
from strikeloom.plans.states import _counts
from strikeloom.session import materialize


def m_nodes(spark, sf):
    return m_cells(spark, sf).groupBy("ticker", "ts", "strike").agg(F.sum("g").alias("v"), F.max("spot").alias("spot"))


view("gnodes", "SELECT ticker, ts, strike, sum(g) AS v, max(spot) AS spot FROM cells_m GROUP BY ALL")


@query("exp_1_greek_exposure", """
SELECT ticker, strftime(expiry, '%Y-%m-%d') AS expiry, round(sum(call_gamma * call_oi * 100 * spot * spot * 0.01 - put_gamma * put_oi * 100 * spot * spot * 0.01) / 1e6, 6) + 0.0 AS gamma_percent,
  round(sum(call_gamma * call_oi * 100 * spot - put_gamma * put_oi * 100 * spot) / 1e6, 6) + 0.0 AS gamma_point, round(sum(call_iv * call_oi * 100 * spot - put_iv * put_oi * 100 * spot) / 1e6, 6) + 0.0 AS vanna
FROM snapshots GROUP BY ticker, expiry""")
def greek_exposure(spark, sf):
    s = adapters.snapshots(spark, sf)

    def net(scaling, form, cg, pg):
        return r(F.sum(exposure.greek_exposure(F.col(cg), F.col("call_oi"), F.col("spot"), scaling, form)
                       - exposure.greek_exposure(F.col(pg), F.col("put_oi"), F.col("spot"), scaling, form)) / 1e6)

    return s.groupBy("ticker", d("expiry").alias("expiry")).agg(
        net("per_percent", "gamma", "call_gamma", "put_gamma").alias("gamma_percent"), net("per_point", "gamma", "call_gamma", "put_gamma").alias("gamma_point"),
        net("per_percent", "vanna", "call_iv", "put_iv").alias("vanna"))


view("kingpct", "SELECT *, coalesce(v / nullif(max(abs(v)) OVER (PARTITION BY ticker, ts), 0), 0) AS pct_king FROM gnodes")


@query("exp_2_percent_of_king", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, round(pct_king, 6) + 0.0 AS pct_king,
  round(CASE WHEN pct_king >= 0 THEN 0.41 + 0.59 * pow(pct_king, 1.5) ELSE 0.41 - 0.41 * pow(abs(pct_king), 0.85) END, 6) AS colour FROM kingpct""")
def percent_of_king(spark, sf):
    p = exposure.percent_of_king(m_nodes(spark, sf))
    return p.select("ticker", d("ts").alias("ts"), "strike", r("pct_king").alias("pct_king"), r(exposure.colour(F.col("pct_king"))).alias("colour"))


@query("top_12_node_tiers", "SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, rk AS rank, node_type AS tier FROM mtier")
def node_tiers(spark, sf):
    return exposure.tiers(m_nodes(spark, sf)).select("ticker", d("ts").alias("ts"), "strike", n("rank").alias("rank"), "tier")


view("deltas", """
SELECT *, delta / nullif(abs(pg), 0) AS pct, CASE WHEN max(abs(delta)) OVER (PARTITION BY ticker, ts) > 0 THEN delta / max(abs(delta)) OVER (PARTITION BY ticker, ts) END AS velocity FROM (
  SELECT ticker, ts, strike, expiry, g, g - lag(g) OVER w AS delta, lag(g) OVER w AS pg FROM cells_m WINDOW w AS (PARTITION BY ticker, strike, expiry ORDER BY ts))""")


@query("win_17_velocity", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, strftime(expiry, '%Y-%m-%d') AS expiry, round(delta, 4) + 0.0 AS delta, round(velocity, 6) + 0.0 AS velocity FROM deltas""")
def velocity(spark, sf):
    v = exposure.velocity(m_cells(spark, sf))
    return v.select("ticker", d("ts").alias("ts"), "strike", d("expiry").alias("expiry"), r("delta", 4).alias("delta"), r("velocity").alias("velocity"))


@query("win_17_change_over_windows", """
SELECT a.ticker, strftime(a.ts, '%Y-%m-%d') AS ts, a.strike, round((a.v - b.v) / nullif(abs(b.v), 0), 4) + 0.0 AS chg_1d, round((a.v - c.v) / nullif(abs(c.v), 0), 4) + 0.0 AS chg_7d
FROM (SELECT *, ts - INTERVAL 1 DAY AS t1, ts - INTERVAL 7 DAY AS t7 FROM dnodes) a ASOF LEFT JOIN dnodes b ON a.ticker = b.ticker AND a.strike = b.strike AND a.t1 >= b.ts ASOF LEFT JOIN dnodes c ON a.ticker = c.ticker AND a.strike = c.strike AND a.t7 >= c.ts""")
def change_over(spark, sf):
    nodes = d_cells(spark, sf).groupBy("ticker", "ts", "strike").agg(F.sum("g").alias("v"))
    c = exposure.change_over(nodes, {"1d": 86400, "7d": 7 * 86400})
    return c.select("ticker", d("ts").alias("ts"), "strike", r("chg_1d", 4).alias("chg_1d"), r("chg_7d", 4).alias("chg_7d"))


@query("exp_3_retest_ordinal", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, CAST(sum(s) OVER (PARTITION BY ticker, strike ORDER BY ts) AS BIGINT) AS retest FROM (
  SELECT *, CASE WHEN now AND NOT coalesce(lag(now) OVER (PARTITION BY ticker, strike ORDER BY ts), false) THEN 1 ELSE 0 END AS s FROM touch_d) QUALIFY now""")
def retest(spark, sf):
    from pyspark.sql import Window
    counts = _counts(materialize(d_cells(spark, sf), "cells"))
    w = Window.partitionBy("ticker", "strike").orderBy("ts")
    touches = counts.withColumn("touch", F.col("n_tch") > F.coalesce(F.lag("n_tch").over(w), F.lit(0)))
    return exposure.retests(touches).where("touch").select("ticker", d("ts").alias("ts"), "strike", n("retest").alias("retest"))


view("levels", """
SELECT *, sign(ceiling - lag(ceiling) OVER w) AS ceiling_move, sign(flo - lag(flo) OVER w) AS floor_move FROM (
  SELECT ticker, ts, arg_max(strike, row(abs(v), -strike)) FILTER (strike > spot) AS ceiling, arg_max(strike, row(abs(v), -strike)) FILTER (strike < spot) AS flo FROM gnodes GROUP BY ticker, ts) WINDOW w AS (PARTITION BY ticker ORDER BY ts)""")


@query("exp_4_rolling_levels", "SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, ceiling, flo AS floor, ceiling_move::DOUBLE AS ceiling_move, floor_move::DOUBLE AS floor_move FROM levels")
def rolling_levels(spark, sf):
    return exposure.rolling_levels(m_nodes(spark, sf)).select("ticker", d("ts").alias("ts"), "ceiling", "floor", "ceiling_move", "floor_move")


@query("exp_5_index_agreement", """
SELECT strftime(ts, '%Y-%m-%d') AS ts, n_up, n_down, greatest(n_up, n_down) AS agreement, CASE WHEN n_up >= 2 AND n_up > n_down THEN 'up' WHEN n_down >= 2 AND n_down > n_up THEN 'down' ELSE 'none' END AS signal FROM (
  SELECT ts, count(*) FILTER (net > 0) AS n_up, count(*) FILTER (net < 0) AS n_down FROM (SELECT ticker, ts, sum(g) AS net FROM cells_m WHERE ticker IN ('A', 'N', 'R') GROUP BY ALL) GROUP BY ts)""")
def agreement(spark, sf):
    dirs = m_cells(spark, sf).groupBy("ticker", "ts").agg(F.signum(F.sum("g")).alias("direction"))
    a = exposure.index_agreement(dirs, ["A", "N", "R"])
    return a.select(d("ts").alias("ts"), n("n_up").alias("n_up"), n("n_down").alias("n_down"), n("agreement").alias("agreement"), "signal")


@query("exp_6_presets_and_range", """
SELECT 'front' AS preset, ticker, count(*) AS n FROM (SELECT *, dense_rank() OVER (PARTITION BY ticker, ts ORDER BY expiry) AS k FROM cells_m) WHERE k <= 3 AND abs(strike - spot) <= spot * 0.5 GROUP BY ticker
UNION ALL SELECT 'monthly', ticker, count(*) FROM (SELECT *, CAST(ts AS DATE) + CAST((12 - isodow(CAST(ts AS DATE))) % 7 + 14 AS INTEGER) AS third FROM shifted) WHERE expiry <= third AND abs(strike - spot) <= spot * 0.5 GROUP BY ticker
UNION ALL SELECT 'friday', ticker, count(*) FROM shifted WHERE expiry <= CAST(ts AS DATE) + CAST((12 - isodow(CAST(ts AS DATE))) % 7 AS INTEGER) AND abs(strike - spot) <= spot * 0.5 GROUP BY ticker""")
def presets(spark, sf):
    cells = materialize(m_cells(spark, sf).select("ticker", "ts", "strike", "expiry", "spot"), "cells")
    near = cells.withColumn("expiry", F.date_add(F.to_date("ts"), F.month("expiry") * 3))
    out = None
    for name, src in (("front", cells), ("monthly", near), ("friday", near)):
        one = exposure.strike_range(exposure.preset(src, name), 0.5).groupBy("ticker").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("preset"), "ticker", "n")
        out = one if out is None else out.unionByName(one)
    return out


view("shifted", "SELECT ticker, ts, strike, spot, CAST(CAST(ts AS DATE) + CAST(3 * month(expiry) AS INTEGER) AS DATE) AS expiry FROM cells_m")


@query("exp_7_movement_filter", """
SELECT x.ticker, strftime(x.ts, '%Y-%m-%d') AS ts, count(*) AS n, count(*) FILTER (abs(k.pct_king) >= 0.25) AS n_marked FROM deltas x JOIN kingpct k USING (ticker, ts, strike) WHERE delta > 0 GROUP BY x.ticker, x.ts""")
def movement(spark, sf):
    cells = materialize(m_cells(spark, sf), "cells")
    nodes = cells.groupBy("ticker", "ts", "strike").agg(F.sum("g").alias("v"))
    m = exposure.movement(exposure.velocity(cells), "increasing", exposure.percent_of_king(nodes), 0.25)
    return m.groupBy("ticker", d("ts").alias("ts")).agg(F.count(F.lit(1)).alias("n"), F.count_if("marked").alias("n_marked"))
