"""State carried between batches: cell averages, session ranges, node interactions."""

from pyspark.sql import functions as F

from strikeloom.constants import STATE_BETA
from strikeloom.operators import grid, state
from strikeloom.operators.state import CELL_FEATURES
from strikeloom.plans.common import DAY_GAP_S, DAY_S, d, d_cells, m_cells, n, r
from strikeloom.plans.registry import query, view
from strikeloom.session import materialize

view("qstep_d", """
SELECT c.*, call_oi - call_prev_oi + put_oi - put_prev_oi AS f, b.prev_ts,
  row_number() OVER (PARTITION BY c.ticker, c.strike, c.expiry ORDER BY c.ts) - 1 AS k,
  coalesce(greatest(date_diff('second', b.prev_ts, c.ts), 1), 86400) / 86400.0::DOUBLE * ln(0.99::DOUBLE) AS lnl
FROM cells_d c JOIN batches_d b USING (ticker, ts)""")
view("qcum_d", """
SELECT *, sum(CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE lnl END) OVER (PARTITION BY ticker, strike, expiry ORDER BY ts) AS cum FROM qstep_d""")
view("qstate_d", """
SELECT s.ticker, s.ts, s.strike, s.expiry, any_value(s.g) AS g, any_value(s.f) AS f,
  sum(q.g * CASE WHEN q.k = 0 THEN 1 ELSE 1 - exp(q.lnl) END * exp(s.cum - q.cum)) AS q_g,
  sum(q.f * CASE WHEN q.k = 0 THEN 1 ELSE 1 - exp(q.lnl) END * exp(s.cum - q.cum)) AS q_f
FROM qcum_d s JOIN qcum_d q ON s.ticker = q.ticker AND s.strike = q.strike AND s.expiry = q.expiry AND q.k <= s.k
GROUP BY s.ticker, s.ts, s.strike, s.expiry""")


def _state(spark, sf):
    cells = materialize(d_cells(spark, sf), "cells")
    return state.cell_state(cells, grid.batches(grid.columns(cells)), cadence_s=DAY_S)


@query("win_2_cell_ewma", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, strftime(expiry, '%Y-%m-%d') AS expiry, round(q_g, 2) + 0.0 AS q_g,
  round(q_f, 2) + 0.0 AS q_f FROM qstate_d""")
def cell_ewma(spark, sf):
    return _state(spark, sf).select("ticker", d("ts").alias("ts"), "strike", d("expiry").alias("expiry"),
                                    r("q_g", 2).alias("q_g"), r("q_f", 2).alias("q_f"))


view("range_d", """
SELECT *, (gmag - flo) / (ceil - flo + 1) AS rho FROM (
  SELECT *, max(gmag) OVER w AS ceil, min(gmag) OVER w AS flo FROM cols_d
  WINDOW w AS (PARTITION BY ticker, expiry, date_trunc('month', ts) ORDER BY ts))""")


def _ranges(cols):
    return state.session_range(cols, F.date_trunc("month", "ts"))


@query("win_3_session_range", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, round(ceil, 4) AS ceil, round(flo, 4) AS floor,
  round(rho, 6) AS rho FROM range_d""")
def session_range(spark, sf):
    return _ranges(grid.columns(d_cells(spark, sf))).select(
        "ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), r("ceil", 4).alias("ceil"),
        r("floor", 4).alias("floor"), r("rho").alias("rho"))


view("bands_d", """
SELECT *, coalesce(least(strike - lag(strike) OVER w, lead(strike) OVER w - strike) / 2, 2.5) AS band
FROM (SELECT DISTINCT ticker, ts, strike FROM cells_d) WINDOW w AS (PARTITION BY ticker, ts ORDER BY strike)""")


@query("win_4_strike_bands", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, band::DOUBLE AS band FROM bands_d""")
def bands(spark, sf):
    nodes = d_cells(spark, sf).select("ticker", "ts", "strike").distinct()
    return state.strike_bands(nodes).select("ticker", d("ts").alias("ts"), "strike", "band")


view("touch_d", """
SELECT *, CAST(sum(now::INT) OVER w AS BIGINT) AS n_tch, CAST(sum(crossed::INT) OVER w AS BIGINT) AS n_del,
  CAST(sum((bef AND NOT now AND NOT crossed)::INT) OVER w AS BIGINT) AS n_rej FROM (
  SELECT b.ticker, b.ts, b.strike, b.band, coalesce(abs(p.spot - strike) <= band AND p.ps IS NOT NULL, false) AS now,
    coalesce(abs(p.ps - strike) <= band, false) AS bef, coalesce((p.ps - strike) * (p.spot - strike) < 0, false) AS crossed
  FROM bands_d b JOIN (SELECT ticker, ts, spot, lag(spot) OVER (PARTITION BY ticker ORDER BY ts) AS ps FROM batches_d) p USING (ticker, ts))
WINDOW w AS (PARTITION BY ticker, strike ORDER BY ts)""")


def _counts(cells):
    return state.interactions(cells, grid.batches(grid.columns(cells)))


@query("win_5_interactions", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, n_tch, n_del, n_rej FROM touch_d""")
def interactions(spark, sf):
    return _counts(materialize(d_cells(spark, sf), "cells")).select("ticker", d("ts").alias("ts"), "strike", "n_tch", "n_del", "n_rej")


view("scores_d", """
SELECT *, n_del / (n_tch + 1.0::DOUBLE) AS s_del, n_rej / (n_tch + 1.0::DOUBLE) AS s_rej, ln(1.0::DOUBLE + n_tch) AS s_tch FROM touch_d""")


@query("win_6_node_scores", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, round(s_del, 6) AS s_del, round(s_rej, 6) AS s_rej, round(s_tch, 6) AS s_tch
FROM scores_d""")
def node_scores(spark, sf):
    return state.scores(_counts(materialize(d_cells(spark, sf), "cells"))).select(
        "ticker", d("ts").alias("ts"), "strike", r("s_del").alias("s_del"), r("s_rej").alias("s_rej"),
        r("s_tch").alias("s_tch"))


view("sdesign_d", """
SELECT c.ticker, c.ts, c.strike, sum(a * g) AS x1, sum(a * q_g) AS x2, sum(a * f) AS x3, sum(a * q_f) AS x4, sum(a * g * rho) AS x5,
  any_value(s_del) AS x6, any_value(s_rej) AS x7, any_value(s_tch) AS x8
FROM qstate_d c JOIN (SELECT ticker, ts, expiry, a FROM weights_d) w USING (ticker, ts, expiry)
JOIN (SELECT ticker, ts, expiry, rho FROM range_d) r USING (ticker, ts, expiry)
JOIN scores_d s USING (ticker, ts, strike) GROUP BY c.ticker, c.ts, c.strike""")

def _beta_sql(*terms):
    return " + ".join(f"({beta!r}::DOUBLE) * {x}" for beta, x in zip(STATE_BETA, terms))


_BETA_SQL = _beta_sql(*[f"x{i}" for i in range(1, 9)])
_CELL_SQL = f"""
  SELECT c.ticker, c.ts, c.strike, c.expiry, a * ({_beta_sql("g", "q_g", "f", "q_f", "g * rho")}) + ({" + ".join(f"({beta!r}::DOUBLE) * {x}" for beta, x in zip(STATE_BETA[5:], ("s_del", "s_rej", "s_tch")))}) / e.n AS c
  FROM qstate_d c JOIN (SELECT ticker, ts, expiry, a FROM weights_d) w USING (ticker, ts, expiry)
  JOIN (SELECT ticker, ts, expiry, rho FROM range_d) r USING (ticker, ts, expiry)
  JOIN scores_d s USING (ticker, ts, strike)
  JOIN (SELECT ticker, ts, count(DISTINCT expiry) AS n FROM qstate_d GROUP BY ticker, ts) e USING (ticker, ts)"""


def _state_rows(spark, sf):
    cells = materialize(d_cells(spark, sf), "cells")
    cols = grid.columns(cells)
    w = grid.smoothed_weights(grid.psi(grid.features(cols)), DAY_GAP_S)
    rows = state.state_cells(state.cell_state(cells, grid.batches(cols), cadence_s=DAY_S), w, _ranges(cols))
    return rows, state.scores(_counts(cells))


@query("agg_8_state_design", f"""
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, round(sign(x1) * ln(1 + abs(x1)), 5) + 0.0 AS x1,
  round(sign(x2) * ln(1 + abs(x2)), 5) + 0.0 AS x2, round(sign(x3) * ln(1 + abs(x3)), 5) + 0.0 AS x3,
  round(sign(x4) * ln(1 + abs(x4)), 5) + 0.0 AS x4, round(sign(x5) * ln(1 + abs(x5)), 5) + 0.0 AS x5, round(x6, 6) AS x6, round(x7, 6) AS x7, round(x8, 6) AS x8,
  round(sign({_BETA_SQL}) * ln(1 + abs({_BETA_SQL})), 4) + 0.0 AS value FROM sdesign_d""")
def design(spark, sf):
    from strikeloom.functions.scalar import signed_log
    rows, scores = _state_rows(spark, sf)
    x = state.node_design(rows, scores)
    return x.select("ticker", d("ts").alias("ts"), "strike", *[r(signed_log(c), 5).alias(c) for c in ("x1", "x2", "x3", "x4", "x5")],
                    *[r(c).alias(c) for c in ("x6", "x7", "x8")], r(signed_log(state.linear_value()), 4).alias("value"))


@query("agg_8_state_cells", f"""
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, count(*) AS n, round(ln(1 + sum(abs(c))), 4) AS log_sum FROM ({_CELL_SQL}) GROUP BY ticker, ts""")
def state_cells(spark, sf):
    rows, scores = _state_rows(spark, sf)
    return state.state_cell_values(rows, scores).groupBy("ticker", d("ts").alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), r(F.log1p(F.sum(F.abs("c"))), 4).alias("log_sum"))


@query("agg_8_state_cell_values", f"""
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, strftime(expiry, '%Y-%m-%d') AS expiry, round(sign(c) * ln(1 + abs(c)), 4) + 0.0 AS log_c FROM ({_CELL_SQL})""")
def state_cell_values(spark, sf):
    """Every cell's share of the node value."""
    from strikeloom.functions.scalar import signed_log
    return state.state_cell_values(*_state_rows(spark, sf)).select("ticker", d("ts").alias("ts"), "strike", d("expiry").alias("expiry"), r(signed_log("c"), 4).alias("log_c"))


view("acc_k", """
SELECT *, (call_ask_vol - call_bid_vol) - (put_ask_vol - put_bid_vol) AS imb, call_volume - put_volume AS net_volume,
  (call_oi - call_prev_oi) - (put_oi - put_prev_oi) AS doi_net,
  row_number() OVER (PARTITION BY ticker, strike, expiry ORDER BY ts) - 1 AS k FROM cells_m""")
view("acc_m", """
SELECT *, coalesce(g - lag(ewma_g_slow) OVER w, 0) AS g_dev_slow, coalesce(g - lag(ewma_g_fast) OVER w, 0) AS g_dev_fast FROM (
  SELECT s.ticker, s.ts, s.strike, s.expiry, any_value(s.g) AS g,
    sum(q.g * CASE WHEN q.k = 0 THEN pow(0.9::DOUBLE, s.k) ELSE 0.1::DOUBLE * pow(0.9::DOUBLE, s.k - q.k) END) AS ewma_g_slow,
    sum(q.g * CASE WHEN q.k = 0 THEN pow(0.5::DOUBLE, s.k) ELSE 0.5::DOUBLE * pow(0.5::DOUBLE, s.k - q.k) END) AS ewma_g_fast,
    sum(q.net_volume) AS cum_net_volume, sum(q.imb) AS cum_imb, sum(q.doi_net) AS cum_doi_net, count(*)::DOUBLE AS n_batches
  FROM acc_k s JOIN acc_k q ON s.ticker = q.ticker AND s.strike = q.strike AND s.expiry = q.expiry AND q.k <= s.k
  GROUP BY s.ticker, s.ts, s.strike, s.expiry)
WINDOW w AS (PARTITION BY ticker, strike, expiry ORDER BY ts)""")

_ACC = ("cum_net_volume", "cum_imb", "cum_doi_net", "n_batches", "ewma_g_slow", "g_dev_slow", "ewma_g_fast", "g_dev_fast")


@query("win_13_accumulators", f"""
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, strftime(expiry, '%Y-%m-%d') AS expiry,
  {', '.join(f'round({c}, 2) + 0.0 AS {c}' for c in _ACC)} FROM acc_m""")
def accumulators(spark, sf):
    return state.accumulators(m_cells(spark, sf)).select(
        "ticker", d("ts").alias("ts"), "strike", d("expiry").alias("expiry"), *[r(c, 2).alias(c) for c in _ACC])


@query("fit_16_column_stats", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, round(sum(abs(g)), 4) AS g_abs_sum,
  round(avg(g), 5) + 0.0 AS g_mean, round(stddev_pop(g), 5) AS g_std FROM cells_m GROUP BY ALL""")
def col_stats(spark, sf):
    return state.column_stats(m_cells(spark, sf)).select(
        "ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), r("g_abs_sum", 4).alias("g_abs_sum"),
        r("g_mean", 5).alias("g_mean"), r("g_std", 5).alias("g_std"))


view("feat41", """
SELECT *, x * x AS x2, abs(x) AS ax, sign(x) AS sgx, g * x AS g_x, g * sign(x) AS g_sgx, abs_gex * expd AS abs_g_expd, g * expd AS g_expd,
  net_oi * expd AS net_oi_expd, net_oi * x AS net_oi_x FROM (
  SELECT *, exp(-abs(x) / 0.02::DOUBLE) AS expd FROM (
    SELECT c.ticker, c.ts, c.strike, c.expiry, c.g, call_gex, put_gex, call_gex - put_gex AS gex_value, abs_rows AS abs_gex,
      call_volume * c.strike - put_volume * c.strike AS dex_value, call_volume * c.strike + put_volume * c.strike AS net_dex,
      call_volume * c.strike AS call_dex, -put_volume * c.strike AS put_dex, call_oi - put_oi AS net_oi, call_oi + put_oi AS tot_oi,
      call_oi + put_oi AS abs_oi, (call_oi - call_prev_oi) - (put_oi - put_prev_oi) AS doi_net,
      abs(call_oi - call_prev_oi) + abs(put_oi - put_prev_oi) AS doi_gross, call_volume - put_volume AS net_volume,
      call_volume + put_volume AS tot_volume, call_ask_vol - call_bid_vol AS cab, put_ask_vol - put_bid_vol AS pab,
      (call_ask_vol - call_bid_vol) - (put_ask_vol - put_bid_vol) AS imb, iv, (c.strike - spot) / spot AS x,
      c.g / (sum(abs(c.g)) OVER w + 1e-30) AS g_colnorm, (c.g - avg(c.g) OVER w) / (stddev_pop(c.g) OVER w + 1e-30) AS g_z,
      cum_net_volume, cum_imb, cum_doi_net, ewma_g_slow, g_dev_slow, ewma_g_fast, g_dev_fast, n_batches
    FROM cells_m c JOIN acc_m a ON c.ticker = a.ticker AND c.ts = a.ts AND c.strike = a.strike AND c.expiry = a.expiry
    WINDOW w AS (PARTITION BY c.ticker, c.ts, c.expiry)))""")

_STABLE = [c for c in state.CELL_FEATURES if c != "g_z"]


def m_features(spark, sf):
    cells = materialize(m_cells(spark, sf), "cells")
    cells = cells.withColumn("call_dex", F.col("call_volume") * F.col("strike")).withColumn(
        "put_dex", -F.col("put_volume") * F.col("strike"))
    return state.cell_features(cells)


@query("prj_15_cell_features", f"""
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, count(*) AS n, {', '.join(f'round(avg({c}), 4) + 0.0 AS {c}' for c in _STABLE)},
  round(avg(abs(CASE WHEN abs(g_z) < 1e6 THEN g_z ELSE 0 END)), 4) AS g_z
FROM feat41 GROUP BY ticker, ts""")
def cell_features(spark, sf):
    f = m_features(spark, sf)
    return f.groupBy("ticker", d("ts").alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), *[r(F.avg(c), 4).alias(c) for c in _STABLE], r(F.avg(F.abs("g_z")), 4).alias("g_z"))


def _signed(c):
    return f"round(sign({c}) * ln(1 + abs({c})), 4) + 0.0 AS {c}"


@query("prj_15_feature_cells", f"""
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, strftime(expiry, '%Y-%m-%d') AS expiry, {", ".join(_signed(c) for c in CELL_FEATURES)} FROM (
  SELECT f.* REPLACE (CASE WHEN s.lo = s.hi THEN 0 ELSE f.g_z END AS g_z) FROM feat41 f
  JOIN (SELECT ticker, ts, expiry, min(g) AS lo, max(g) AS hi FROM cells_m GROUP BY ALL) s ON f.ticker = s.ticker AND f.ts = s.ts AND f.expiry = s.expiry)""")
def feature_cells(spark, sf):
    """All 41 inputs of every cell."""
    from strikeloom.functions.scalar import signed_log
    return m_features(spark, sf).select("ticker", d("ts").alias("ts"), "strike", d("expiry").alias("expiry"), *[r(signed_log(c), 4).alias(c) for c in CELL_FEATURES])
