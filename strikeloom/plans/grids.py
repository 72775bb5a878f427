"""Cells, columns, weights, nodes and selection."""

from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.operators import grid
from strikeloom.plans.common import (
    DAY_GAP_S, MONTH_GAP_S, d, d_psi, m_cells, m_psi, n, r, t, valued,
)
from strikeloom.plans.registry import query
from strikeloom.session import materialize


@query("prj_3_net_gex", """
SELECT ticker, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, count(*) AS n, round(sum(call_gex - put_gex), 4) + 0.0 AS net_gex
FROM chain_m GROUP BY ticker, ts""")
def net_gex(spark, sf):
    return adapters.chain(spark, sf).groupBy("ticker", t("ts").alias("ts")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(grid.net_gex()), 4).alias("net_gex"))


@query("prj_4_cell_flow", """
SELECT ticker, strftime(expiry, '%Y-%m-%d') AS expiry, strike, CAST(sum(call_oi - call_prev_oi + put_oi - put_prev_oi) AS BIGINT) AS flow
FROM chain_m GROUP BY ALL""")
def cell_flow(spark, sf):
    return adapters.chain(spark, sf).groupBy("ticker", d("expiry").alias("expiry"), "strike").agg(
        n(F.sum(grid.cell_flow())).alias("flow"))


@query("agg_1_column_sums", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, round(gmag, 4) AS gmag,
       round(net_col, 4) + 0.0 AS net_col, round(com_num, 4) AS com_num, CAST(ask AS BIGINT) AS ask,
       CAST(bid AS BIGINT) AS bid, CAST(doi AS BIGINT) AS doi FROM cols_m""")
def column_sums(spark, sf):
    return grid.columns(m_cells(spark, sf)).select(
        "ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), r("gmag", 4).alias("gmag"),
        r("net_col", 4).alias("net_col"), r("com_num", 4).alias("com_num"), n("ask").alias("ask"),
        n("bid").alias("bid"), n("doi").alias("doi"))


@query("agg_2_features", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, round(log_dte, 6) AS log_dte,
       round(log_gmag, 6) AS log_gmag, round(net_col_sign_log, 6) + 0.0 AS net_col_sign_log,
       round(askbid_imbalance, 6) + 0.0 AS askbid_imbalance, round(doi_migration, 6) + 0.0 AS doi_migration,
       round(com_dist_rel, 6) AS com_dist_rel, round(tod_frac, 6) AS tod_frac FROM feats_m""")
def features(spark, sf):
    from strikeloom.constants import FEATURES
    return grid.features(grid.columns(m_cells(spark, sf))).select(
        "ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), *[r(f).alias(f) for f in FEATURES])


@query("agg_3_psi", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry,
       CAST(sign(psi) AS BIGINT) AS psi_sign, CASE WHEN psi <> 0 THEN round(ln(abs(psi)), 6) + 0.0 END AS log_psi FROM psi_m""")
def psi(spark, sf):
    return m_psi(spark, sf).select(
        "ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), n(F.signum("psi")).alias("psi_sign"),
        F.when(F.col("psi") != 0, r(F.ln(F.abs("psi")))).alias("log_psi"))


@query("prj_17_shape", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, round(max(col_max), 4) AS col_max,
       round(sum(h), 4) + 0.0 AS sum_h, round(sum(abs(h)), 4) AS abs_h FROM shaped_m GROUP BY ALL""")
def shape(spark, sf):
    return grid.shaped(m_cells(spark, sf)).groupBy(
        "ticker", d("ts").alias("ts"), d("expiry").alias("expiry")).agg(
        r(F.max("col_max"), 4).alias("col_max"), r(F.sum("h"), 4).alias("sum_h"),
        r(F.sum(F.abs("h")), 4).alias("abs_h"))


@query("agg_4_cell_basis", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, strike, round(g, 4) + 0.0 AS g,
       round(h, 4) + 0.0 AS h FROM shaped_m""")
def cell_basis(spark, sf):
    return grid.shaped(m_cells(spark, sf)).select(
        "ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), "strike", r("g", 4).alias("g"), r("h", 4).alias("h"))


@query("win_1_gap_reset_ewma", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, CAST(st AS BIGINT) AS restart,
       CAST(sign(trunc(a * 1000)) AS BIGINT) AS a_sign, round(ln(abs(a) + 1), 6) AS log_a FROM weights_d""")
def gap_reset(spark, sf):
    w = grid.smoothed_weights(materialize(d_psi(spark, sf), "psi"), DAY_GAP_S)
    return w.select("ticker", d("ts").alias("ts"), d("expiry").alias("expiry"),
                    n(F.col("fresh_start").cast("int")).alias("restart"), n(F.signum((F.col("a") * 1000).cast("bigint"))).alias("a_sign"),
                    r(F.ln(F.abs("a") + 1)).alias("log_a"))


@query("win_1_fold_form", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry,
       CAST(sign(trunc(a * 1000)) AS BIGINT) AS a_sign, round(ln(abs(a) + 1), 6) AS log_a FROM weights_m""")
def fold_form(spark, sf):
    return grid.fold_weights(materialize(m_psi(spark, sf), "psi"), MONTH_GAP_S).select(
        "ticker", d("ts").alias("ts"), d("expiry").alias("expiry"),
        n(F.signum((F.col("a") * 1000).cast("bigint"))).alias("a_sign"), r(F.ln(F.abs("a") + 1)).alias("log_a"))


@query("agg_7_display_weights", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry,
       CASE WHEN avg(abs(a)) OVER w = 0 THEN 0.0 ELSE round(a / avg(abs(a)) OVER w, 6) + 0.0 END AS w
FROM weights_m WINDOW w AS (PARTITION BY ticker, ts)""")
def display(spark, sf):
    w = grid.display_weights(grid.smoothed_weights(materialize(m_psi(spark, sf), "psi"), MONTH_GAP_S))
    return w.select("ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), r("w").alias("w"))


@query("agg_5_cell_values", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, strike,
       CAST(sign(c) AS BIGINT) AS c_sign, round(ln(1 + abs(c)), 6) AS log_c FROM valued_m""")
def cell_values(spark, sf):
    return valued(spark, sf).select(
        "ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), "strike", n(F.signum("c")).alias("c_sign"),
        r(F.log1p(F.abs("c"))).alias("log_c"))


@query("agg_6_node_values", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike,
       round(v / max(abs(v)) OVER (PARTITION BY ticker, ts), 6) + 0.0 AS v_share FROM nodes_m""")
def node_values(spark, sf):
    from pyspark.sql import Window
    nodes = grid.node_values(valued(spark, sf))
    top = F.max(F.abs("v")).over(Window.partitionBy("ticker", "ts"))
    return nodes.select("ticker", d("ts").alias("ts"), "strike", r(F.col("v") / top).alias("v_share"))


@query("top_1_king_top6", """
SELECT * FROM (SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, row_number() OVER (
  PARTITION BY ticker, ts ORDER BY abs(v) DESC, strike) AS node_rank, round(ln(1 + abs(v)), 6) AS log_v FROM nodes_m)
WHERE node_rank <= 6""")
def king_top6(spark, sf):
    return grid.top_nodes(grid.node_values(valued(spark, sf))).select(
        "ticker", d("ts").alias("ts"), "strike", n("node_rank").alias("node_rank"), r(F.log1p(F.abs("v"))).alias("log_v"))


@query("top_2_stars", """
SELECT ticker, ts, expiry, star, log_star, row_number() OVER (
  PARTITION BY ticker, ts ORDER BY a DESC, star, expiry) = 1 AS global_star FROM (
  SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, strike AS star, abs(c) AS a,
         round(ln(1 + abs(c)), 6) AS log_star, row_number() OVER (
    PARTITION BY ticker, ts, expiry ORDER BY abs(c) DESC, strike) AS rn FROM valued_m) WHERE rn = 1""")
def stars(spark, sf):
    return grid.stars(valued(spark, sf)).select(
        "ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), "star",
        r(F.log1p(F.abs("star_value"))).alias("log_star"), "global_star")
