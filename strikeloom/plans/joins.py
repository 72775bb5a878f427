"""As-of, snapshot, grid and parameter joins."""

from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.operators import asof, grid
from strikeloom.plans.common import d, d_cells, m_cells, m_psi, n, r, t
from strikeloom.plans.registry import query, view
from strikeloom.session import materialize

view("snaps", "SELECT DISTINCT ticker, date_trunc('hour', ts) + INTERVAL 30 MINUTE AS sts FROM prints")
view("nearest", """
SELECT p.ticker, p.seq, p.ts, CASE WHEN f.sts IS NULL OR epoch_us(p.ts) - epoch_us(b.sts) <= epoch_us(f.sts) - epoch_us(p.ts) THEN coalesce(b.sts, f.sts) ELSE f.sts END AS near,
  least(epoch_us(p.ts) - epoch_us(b.sts), epoch_us(f.sts) - epoch_us(p.ts)) / 1e6::DOUBLE AS dist_s
FROM prints p ASOF LEFT JOIN snaps b ON p.ticker = b.ticker AND p.ts >= b.sts ASOF LEFT JOIN snaps f ON p.ticker = f.ticker AND p.ts <= f.sts""")
view("aligned", "SELECT *, CASE WHEN dist_s <= 900 THEN near END AS match_ts FROM nearest")


def snaps(spark, sf):
    p = adapters.prints(spark, sf)
    half = F.timestamp_seconds(F.unix_timestamp(F.date_trunc("hour", "ts")) + 1800)
    return p.select("ticker", half.alias("sts")).distinct()


def aligned(spark, sf, tol=900.0):
    p = adapters.prints(spark, sf).select("ticker", "seq", "ts")
    return asof.nearest_asof(p, snaps(spark, sf), ["ticker"], "ts", "sts", tol)


@query("jn_1_nearest_asof", """
SELECT seq, ticker, strftime(match_ts, '%Y-%m-%d %H:%M:%S') AS match_ts, round(dist_s, 5) AS dist_s FROM aligned""")
def nearest(spark, sf):
    return aligned(spark, sf).select("seq", "ticker", t("match_ts").alias("match_ts"), r("dist_s", 5).alias("dist_s"))


@query("jn_2_snapshot_join", """
SELECT c.ticker, strftime(c.ts, '%Y-%m-%d') AS ts, count(*) AS n_cells, b.seq, round(sum(c.g), 4) + 0.0 AS net FROM cells_m c
JOIN batches_m b ON c.ticker = b.ticker AND c.ts = b.ts GROUP BY c.ticker, c.ts, b.seq""")
def snapshot_join(spark, sf):
    cells = materialize(m_cells(spark, sf), "cells")
    b = grid.batches(grid.columns(cells)).select("ticker", "ts", "seq")
    return cells.join(b, ["ticker", "ts"]).groupBy("ticker", d("ts").alias("ts"), n("seq").alias("seq")).agg(
        F.count(F.lit(1)).alias("n_cells"), r(F.sum("g"), 4).alias("net"))


view("dnodes", "SELECT ticker, ts, strike, sum(g) AS v FROM cells_d GROUP BY ALL")


def day_nodes(spark, sf):
    return d_cells(spark, sf).groupBy("ticker", "ts", "strike").agg(F.sum("g").alias("v"))


@query("jn_3_zero_filled_grid", """
SELECT t.ticker, strftime(t.ts + INTERVAL 1 DAY, '%Y-%m-%d') AS ts, t.strike, round(t.v, 4) + 0.0 AS target, round(coalesce(m.v, 0), 4) + 0.0 AS model
FROM dnodes t LEFT JOIN dnodes m ON t.ticker = m.ticker AND t.ts + INTERVAL 1 DAY = m.ts AND t.strike = m.strike""")
def zero_filled(spark, sf):
    nodes = materialize(day_nodes(spark, sf), "nodes")
    target = nodes.select("ticker", F.timestamp_seconds(F.unix_timestamp("ts") + 86400).alias("ts"), "strike", F.col("v").alias("target"))
    return asof.zero_filled(target, nodes, ["ticker", "ts", "strike"], "v").select(
        "ticker", d("ts").alias("ts"), "strike", r("target", 4).alias("target"), r("v", 4).alias("model"))


@query("jn_4_cell_match", """
SELECT a.ticker, strftime(a.ts, '%Y-%m-%d') AS ts, count(*) AS n_shared, round(sum(a.g * b.g) / 1e6, 4) + 0.0 AS dot FROM cells_m a
JOIN cells_m b ON a.ticker = b.ticker AND a.strike = b.strike AND a.expiry = b.expiry AND b.ts = a.ts + INTERVAL 1 MONTH GROUP BY a.ticker, a.ts""")
def cell_match(spark, sf):
    cells = materialize(m_cells(spark, sf).select("ticker", "ts", "strike", "expiry", "g"), "cells")
    nxt = cells.select("ticker", F.add_months("ts", -1).cast("timestamp").alias("ts"), "strike", "expiry", F.col("g").alias("g2"))
    return cells.join(nxt, ["ticker", "ts", "strike", "expiry"]).groupBy("ticker", d("ts").alias("ts")).agg(
        F.count(F.lit(1)).alias("n_shared"), r(F.sum(F.col("g") * F.col("g2")) / 1e6, 4).alias("dot"))


@query("jn_5_reconcile_counts", """
SELECT coalesce(a.ticker, b.ticker) AS ticker, strftime(coalesce(a.day, b.day), '%Y-%m-%d') AS day, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right,
  coalesce(a.n, 0) = coalesce(b.n, 0) AS agrees
FROM (SELECT ticker, day, count(*) AS n FROM prints WHERE side = 'ask' GROUP BY ALL) a
FULL JOIN (SELECT ticker, day, count(*) AS n FROM prints WHERE is_sweep GROUP BY ALL) b ON a.ticker = b.ticker AND a.day = b.day""")
def reconcile(spark, sf):
    p = adapters.prints(spark, sf)
    return asof.reconcile(p.where("side = 'ask'"), p.where("is_sweep"), ["ticker", "day"]).select(
        "ticker", d("day").alias("day"), "n_left", "n_right", "agrees")


GAMMAS = (0.0, 0.25, 0.5, 0.7, 1.0)
view("gamma_grid", "SELECT * FROM (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE), (1.0::DOUBLE)) v(gamma)")
view("grid_nodes", """
SELECT c.ticker, c.ts, gamma, c.strike, sum(sign(psi) * pow(abs(psi), gamma / 0.7::DOUBLE) * g) AS v
FROM cells_m c JOIN psi_m p USING (ticker, ts, expiry) CROSS JOIN gamma_grid GROUP BY ALL""")


@query("jn_7_parameter_grid", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, gamma, strike AS king FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, ts, gamma ORDER BY abs(v) DESC, strike) AS rn FROM grid_nodes) WHERE rn = 1""")
def parameter_grid(spark, sf):
    from strikeloom.operators import fits
    cells = materialize(m_cells(spark, sf), "cells")
    nodes = fits.grid_nodes(cells, grid.psi(grid.features(grid.columns(cells))), GAMMAS)
    return nodes.groupBy("ticker", d("ts").alias("ts"), "gamma").agg(
        F.max_by("strike", F.struct(F.abs("v"), -F.col("strike"))).alias("king"))


@query("jn_9_leave_one_out", """
SELECT ticker, yr AS fold, test_n, round(test_g, 3) + 0.0 AS test_g, CAST(sum(test_n) OVER w AS BIGINT) - test_n AS train_n, round(sum(test_g) OVER w - test_g, 3) + 0.0 AS train_g
FROM (SELECT ticker, year(ts) AS yr, count(*) AS test_n, sum(g) AS test_g FROM cells_m GROUP BY ALL) WINDOW w AS (PARTITION BY ticker)""")
def leave_one_out(spark, sf):
    rows = m_cells(spark, sf).withColumn("fold", F.year("ts").cast("bigint"))
    out = asof.leave_one_out(rows, "fold", ["ticker"], {"n": F.lit(1), "g": F.col("g")})
    return out.select("ticker", "fold", "test_n", r("test_g", 3).alias("test_g"), "train_n", r("train_g", 3).alias("train_g"))


@query("jn_10_nearest_record", """
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, arg_min(seq, row(abs(epoch_us(ts) - epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 14 HOUR)), ts, seq)) AS seq,
  round(min(abs(epoch_us(ts) - epoch_us(CAST(day AS TIMESTAMP) + INTERVAL 14 HOUR))) / 1e6::DOUBLE, 5) AS dist_s
FROM prints GROUP BY ticker, day""")
def nearest_record(spark, sf):
    p = adapters.prints(spark, sf)
    start = F.unix_micros(F.col("day").cast("timestamp")) + 14 * 3600 * 1000000
    dist = F.abs(F.unix_micros("ts") - start)
    # Distance, then the earlier side, then the sequence, as one number.
    later = F.when(F.unix_micros("ts") > start, 1).otherwise(0)
    order = F.expr("CAST(_near AS DECIMAL(38,0)) * 10000000000000000000BD + seq")
    return p.withColumn("_near", dist * 2 + later).groupBy("ticker", "day").agg(
        F.min_by("seq", order).alias("seq"), F.min(dist).alias("dist")).select(
        "ticker", d("day").alias("day"), "seq", r(F.col("dist") / 1e6, 5).alias("dist_s"))
