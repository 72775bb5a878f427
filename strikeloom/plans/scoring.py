"""Scorecards of the smoothed model against a target grid."""

from pyspark.sql import functions as F

from strikeloom.functions.quantiles import exact_quantiles
from strikeloom.operators import grid, scoring
from strikeloom.plans.common import MONTH_GAP_S, d, m_cells, n, r
from strikeloom.plans.registry import query, view
from strikeloom.session import materialize, scratch_dir
from strikeloom.sources import sinks

# The target grid: another weighting of the same chain plus an open-interest term.
view("tcells", """
SELECT v.ticker, v.ts, v.strike, v.expiry, v.g, v.a, v.c, month(v.expiry) * v.g + 10.0::DOUBLE * (v.call_oi - v.put_oi) AS y FROM valued_m v""")
view("npairs", "SELECT ticker, ts, strike, sum(y) AS y, sum(c) AS v FROM tcells GROUP BY ALL")


def tolerance():
    """The ticker R stands for the index."""
    return scoring.king_tolerance(("R",))


def target(df):
    return df.withColumn("y", F.month("expiry") * F.col("g") + F.lit(10.0) * (F.col("call_oi") - F.col("put_oi")))


def pair_cells(spark, sf, gamma=0.7):
    """Cells with target and model value, written once per query."""
    cells = materialize(m_cells(spark, sf), "cells")
    w = grid.smoothed_weights(grid.psi(grid.features(grid.columns(cells)), gamma), MONTH_GAP_S)
    both = target(grid.cell_values(grid.shaped(cells.repartition("ticker", "ts")), w))
    return materialize(both.select("ticker", "ts", "strike", "expiry", "spot", "g", "h", "a", "c", "y"), "pairs")


def nerr_sql(src: str, keys: str = "ticker, ts") -> str:
    return f"""
SELECT {keys}, any_value(sc) AS c_scale, count(*) AS n_material, list_sort(list(e))[count(*) // 2 + 1] AS med_ape,
  list_sort(list(e))[least(CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT), count(*) - 1) + 1] AS p90_ape, quantile_cont(u, 0.5) AS med_ape_unscaled,
  coalesce(sum(y * v) * sum(y * v) / nullif(sum(y * y) * sum(v * v), 0), 0) AS cos2
FROM (SELECT *, abs(sc * v - y) / greatest(abs(y), 1e-12) AS e, abs(v - y) / greatest(abs(y), 1e-12) AS u FROM (
  SELECT *, coalesce(sum(y * v) OVER w / nullif(sum(v * v) OVER w, 0), 0) AS sc, max(abs(y)) OVER w AS top FROM {src} WINDOW w AS (PARTITION BY {keys}))
  WHERE top > 0 AND abs(y) >= 0.05 * top) GROUP BY {keys}"""


def kings_sql(src: str, keys: str = "ticker, ts") -> str:
    return f"""
SELECT {keys}, max(CASE WHEN ry = 1 THEN strike END) AS king_true, max(CASE WHEN rv = 1 THEN strike END) AS king_pred, count(*) FILTER (ry <= 6 AND rv <= 6) AS top6_overlap,
  max(CASE WHEN ry = 1 THEN strike END) = max(CASE WHEN rv = 1 THEN strike END) AS king_exact,
  abs(max(CASE WHEN ry = 1 THEN strike END) - max(CASE WHEN rv = 1 THEN strike END)) <= CASE WHEN ticker = 'R' THEN 25 ELSE 5 END AS king_in_tol
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY abs(y) DESC, strike) AS ry, row_number() OVER (PARTITION BY {keys} ORDER BY abs(v) DESC, strike) AS rv FROM {src}) GROUP BY {keys}"""


view("nerr", nerr_sql("npairs"))
view("kscore", kings_sql("npairs"))
view("sscore", """
SELECT ticker, ts, count(*) FILTER (ry = 1 AND y <> 0) AS star_total, count(*) FILTER (ry = 1 AND y <> 0 AND rc = 1) AS star_exact,
  count(*) FILTER (ry = 1 AND y <> 0 AND rc <= 3) AS star_top3, count(*) FILTER (gy = 1 AND gc = 1) > 0 AS global_star_exact FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, ts, expiry ORDER BY abs(y) DESC, strike) AS ry, row_number() OVER (PARTITION BY ticker, ts, expiry ORDER BY abs(c) DESC, strike) AS rc,
    row_number() OVER (PARTITION BY ticker, ts ORDER BY abs(y) DESC, strike, expiry) AS gy, row_number() OVER (PARTITION BY ticker, ts ORDER BY abs(c) DESC, strike, expiry) AS gc FROM tcells) GROUP BY ticker, ts""")
view("rscore", "SELECT * FROM nerr JOIN kscore USING (ticker, ts) JOIN sscore USING (ticker, ts)")


@query("fit_3_node_error", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, round(c_scale * 1e9, 4) + 0.0 AS c_scale, n_material, round(med_ape, 6) AS med_ape, round(p90_ape, 6) AS p90_ape,
  round(ln(1 + med_ape_unscaled), 6) AS log_unscaled, round(cos2, 6) AS cos2 FROM nerr""")
def node_error(spark, sf):
    e = scoring.node_error(scoring.node_pairs(pair_cells(spark, sf)))
    return e.select("ticker", d("ts").alias("ts"), r(F.col("c_scale") * 1e9, 4).alias("c_scale"), "n_material", r("med_ape").alias("med_ape"),
                    r("p90_ape").alias("p90_ape"), r(F.ln(1 + F.col("med_ape_unscaled"))).alias("log_unscaled"), r("cos2").alias("cos2"))


@query("fit_4_king_star_scorecard", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, king_true, king_pred, king_exact, king_in_tol, star_total, star_exact, star_top3, global_star_exact FROM rscore""")
def king_star(spark, sf):
    cells = pair_cells(spark, sf)
    s = scoring.king_scores(scoring.node_pairs(cells), tolerance=tolerance()).join(scoring.star_scores(cells), ["ticker", "ts"])
    return s.select("ticker", d("ts").alias("ts"), "king_true", "king_pred", "king_exact", "king_in_tol", "star_total", "star_exact", "star_top3", "global_star_exact")


@query("top_9_top6_overlap", "SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, top6_overlap FROM kscore")
def overlap(spark, sf):
    return scoring.king_scores(scoring.node_pairs(pair_cells(spark, sf)), tolerance=tolerance()).select("ticker", d("ts").alias("ts"), "top6_overlap")


@query("top_8_rank_of_column_star", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, n AS n_shared, strike AS star, rg AS rank, rg <= 3 AS top3 FROM (
  SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY ticker, ts, expiry ORDER BY abs(g) DESC, strike) AS rg,
    row_number() OVER (PARTITION BY ticker, ts, expiry ORDER BY abs(y) DESC, strike) AS ry FROM tcells WINDOW w AS (PARTITION BY ticker, ts, expiry)) WHERE ry = 1 AND n >= 5""")
def column_star(spark, sf):
    out = scoring.column_rank_of_star(target(m_cells(spark, sf)))
    return out.select("ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), n("n_shared").alias("n_shared"), "star", n("rank").alias("rank"),
                      (F.col("rank") <= 3).alias("top3"))


_CARD = """
SELECT scope, count(*) AS n_records, round(avg(king_exact::INT), 6) AS king_exact_rate, round(avg(king_in_tol::INT), 6) AS king_tol_rate, round(avg(top6_overlap), 6) AS overlap_mean,
  round(avg(global_star_exact::INT), 6) AS global_star_rate, round(sum(star_exact) / greatest(sum(star_total), 1), 6) AS star_exact_rate,
  round(sum(star_top3) / greatest(sum(star_total), 1), 6) AS star_top3_rate, round(list_sort(list(med_ape))[count(*) // 2 + 1], 6) AS med_ape
FROM (SELECT *, year(ts)::VARCHAR AS scope FROM rscore UNION ALL SELECT *, 'overall' FROM rscore) GROUP BY scope"""
_CARD_COLS = ("king_exact_rate", "king_tol_rate", "overlap_mean", "global_star_rate", "star_exact_rate", "star_top3_rate", "med_ape")


def card(spark, sf, gamma=0.7):
    return scoring.scorecard(materialize(scoring.record_scores(pair_cells(spark, sf, gamma), tolerance=tolerance()), "scores"), F.year("ts"))


@query("agg_21_scorecard", _CARD)
def scorecard(spark, sf):
    return card(spark, sf).select("scope", "n_records", *[r(c).alias(c) for c in _CARD_COLS])


@query("agg_22_cross_tab", """
SELECT coalesce(ticker, 'all') AS "row", coalesce(yr, 'all') AS "col", count(*) AS n, count(*) FILTER (king_exact) AS n_exact, count(*) FILTER (king_in_tol) AS n_tol,
  round(count(*) FILTER (king_exact) / count(*)::DOUBLE, 6) AS exact_rate FROM (SELECT *, year(ts)::VARCHAR AS yr FROM kscore) GROUP BY CUBE (ticker, yr)""")
def cross_tab(spark, sf):
    k = scoring.king_scores(scoring.node_pairs(pair_cells(spark, sf)), tolerance=tolerance())
    return scoring.cross_tab(k, F.col("ticker"), F.year("ts")).select("row", "col", "n", "n_exact", "n_tol", r("exact_rate").alias("exact_rate"))


@query("fit_17_acceptance_gate", """
SELECT metric, round(measured, 6) AS measured, bar::DOUBLE AS bar, met FROM (
  SELECT 'king_exact_rate' AS metric, avg(king_exact::INT) AS measured, 0.9 AS bar, avg(king_exact::INT) >= 0.9 AS met FROM rscore
  UNION ALL SELECT 'node_med_ape', m, 0.1, m <= 0.1 FROM (SELECT list_sort(list(med_ape))[count(*) // 2 + 1] AS m FROM rscore)
  UNION ALL SELECT 'session_days', count(DISTINCT ts), 20, count(DISTINCT ts) >= 20 FROM rscore)""")
def gate(spark, sf):
    scores = materialize(scoring.record_scores(pair_cells(spark, sf), tolerance=tolerance()), "scores")
    days = scores.agg(F.countDistinct("ts").alias("days"))
    c = scoring.scorecard(scores, F.year("ts")).join(F.broadcast(days))
    return scoring.gate(c, n_days=F.col("days")).select("metric", r("measured").alias("measured"), "bar", "met")


view("misses", """
SELECT m.*, s.a_spread, CASE WHEN king_true = king_pred THEN 'exact' WHEN y_t > 0 AND y_p >= 0.9 * y_t THEN 'near_tie_intrinsic' WHEN o_p > 0 AND o_t >= 0.9 * o_p THEN 'near_tie_ours'
    WHEN gross_t >= gross_p THEN 'sign_cancellation' ELSE 'expiry_mislocation' END AS label, dom_ours <> dom_true AS driver_mismatch, abs(king_pred - king_true) / CASE WHEN ticker = 'R' THEN 25.0::DOUBLE ELSE 5.0::DOUBLE END AS err_tol_units FROM (
  SELECT c.ticker, c.ts, k.king_true, k.king_pred, abs(coalesce(sum(y) FILTER (c.strike = king_true), 0)) AS y_t, abs(coalesce(sum(y) FILTER (c.strike = king_pred), 0)) AS y_p,
    abs(coalesce(sum(c.c) FILTER (c.strike = king_true), 0)) AS o_t, abs(coalesce(sum(c.c) FILTER (c.strike = king_pred), 0)) AS o_p,
    coalesce(sum(abs(a * g)) FILTER (c.strike = king_true), 0) AS gross_t, coalesce(sum(abs(a * g)) FILTER (c.strike = king_pred), 0) AS gross_p,
    arg_max(expiry, row(abs(a * g), -epoch(expiry))) FILTER (c.strike = king_pred) AS dom_ours, arg_max(expiry, row(abs(y), -epoch(expiry))) FILTER (c.strike = king_true) AS dom_true
  FROM tcells c JOIN kscore k USING (ticker, ts) GROUP BY c.ticker, c.ts, k.king_true, k.king_pred) m
LEFT JOIN (SELECT ticker, ts, max(abs(a)) / min(abs(a)) AS a_spread FROM tcells WHERE a <> 0 GROUP BY ticker, ts) s USING (ticker, ts)""")


@query("fit_14_miss_taxonomy", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, label, driver_mismatch, round(err_tol_units, 6) AS err_tol_units, round(ln(a_spread), 6) AS log_spread FROM misses""")
def taxonomy(spark, sf):
    cells = pair_cells(spark, sf)
    kings = scoring.king_scores(scoring.node_pairs(cells), tolerance=tolerance())
    return scoring.classify_misses(cells, kings, tolerance=tolerance()).select(
        "ticker", d("ts").alias("ts"), "label", "driver_mismatch", r("err_tol_units").alias("err_tol_units"), r(F.ln("a_spread")).alias("log_spread"))


@query("fit_14_miss_summary", """
SELECT label, count(*) AS n, count(*) FILTER (driver_mismatch) AS n_mismatch, round(list_sort(list(err_tol_units))[count(*) // 2 + 1], 6) AS err_p50,
  round(list_sort(list(err_tol_units))[CAST(floor(0.9::DOUBLE * (count(*) - 1)) AS BIGINT) + 1], 6) AS err_p90 FROM misses GROUP BY label""")
def miss_summary(spark, sf):
    cells = pair_cells(spark, sf)
    m = materialize(scoring.classify_misses(cells, scoring.king_scores(scoring.node_pairs(cells), tolerance=tolerance()), tolerance=tolerance()), "misses")
    base = m.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("driver_mismatch").alias("n_mismatch"))
    q = exact_quantiles(m, ["label"], "err_tol_units", {"err_p50": (0.5, "upper"), "err_p90": (0.9, "lower")}).drop("n")
    return base.join(q, "label").select("label", "n", "n_mismatch", r("err_p50").alias("err_p50"), r("err_p90").alias("err_p90"))


view("psi_1", "SELECT *, sign(psi) * pow(abs(psi), 1 / 0.7::DOUBLE) AS psi1 FROM psi_m")
view("weights_1", """
SELECT s.ticker, s.ts, s.expiry, sum(sign(q.psi) * pow(abs(q.psi), 1 / 0.7::DOUBLE) * CASE WHEN q.k = 0 THEN pow(0.79::DOUBLE, s.k) ELSE 0.21::DOUBLE * pow(0.79::DOUBLE, s.k - q.k) END) AS a
FROM segs_m s JOIN segs_m q ON s.ticker = q.ticker AND s.expiry = q.expiry AND s.seg = q.seg AND q.k <= s.k GROUP BY s.ticker, s.ts, s.expiry""")
view("npairs_1", """
SELECT t.ticker, t.ts, t.strike, sum(t.y) AS y, sum(w.a * s.h) AS v FROM tcells t JOIN shaped_m s USING (ticker, ts, strike, expiry) JOIN weights_1 w USING (ticker, ts, expiry) GROUP BY t.ticker, t.ts, t.strike""")
view("kscore_1", kings_sql("npairs_1"))


@query("fit_18_compare_runs", """
SELECT ticker, metric, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 6) + 0.0 AS delta FROM (
  SELECT b.ticker, 'exact' AS metric, b.e AS before, a.e AS after FROM (SELECT ticker, avg(king_exact::INT) AS e FROM kscore_1 GROUP BY ticker) b JOIN (SELECT ticker, avg(king_exact::INT) AS e FROM kscore GROUP BY ticker) a USING (ticker)
  UNION ALL SELECT b.ticker, 'overlap', b.e, a.e FROM (SELECT ticker, avg(top6_overlap) AS e FROM kscore_1 GROUP BY ticker) b JOIN (SELECT ticker, avg(top6_overlap) AS e FROM kscore GROUP BY ticker) a USING (ticker))""")
def compare_runs(spark, sf):
    def one(gamma):
        k = scoring.king_scores(scoring.node_pairs(pair_cells(spark, sf, gamma)), tolerance=tolerance())
        return k.groupBy("ticker").agg(F.avg(F.when(F.col("king_exact"), 1.0).otherwise(0.0)).alias("exact"), F.avg("top6_overlap").alias("overlap"))
    return scoring.compare_runs(one(1.0), one(0.7), ["ticker"], ["exact", "overlap"]).select(
        "ticker", "metric", r("before").alias("before"), r("after").alias("after"), r("delta").alias("delta"))


@query("fit_19_semantics_probe", """
SELECT c.ticker, strftime(c.ts, '%Y-%m-%d') AS ts, count(*) AS n, count(*) FILTER (abs(v - h_sum) < 1e-6) AS exact_sum, count(*) FILTER (abs(v - h_abs) < 1e-6) AS exact_abs,
  count(*) FILTER (abs(v - h_peak) < 1e-6) AS exact_peak, round(coalesce(corr(v, h_abs), 0), 6) + 0.0 AS corr_abs, round(coalesce(corr(v, h_peak), 0), 6) + 0.0 AS corr_peak, true AS flag_is_argmax
FROM mrank c JOIN (SELECT ticker, ts, strike, sum(g) AS h_sum, sum(abs(g)) AS h_abs, arg_max(g, row(abs(g), g)) AS h_peak FROM cells_m GROUP BY ALL) h USING (ticker, ts, strike) GROUP BY c.ticker, c.ts""")
def probe(spark, sf):
    from pyspark.sql import Window
    cells = materialize(m_cells(spark, sf).select("ticker", "ts", "strike", "expiry", "g"), "cells")
    nodes = cells.groupBy("ticker", "ts", "strike").agg(F.sum("g").alias("value"))
    order = Window.partitionBy("ticker", "ts").orderBy(F.abs("value").desc(), "strike")
    vector = nodes.withColumn("is_king", F.row_number().over(order) == 1)
    p = scoring.semantics_probe(cells, vector)
    return p.select("ticker", d("ts").alias("ts"), "n", "exact_sum", "exact_abs", "exact_peak", r("corr_abs").alias("corr_abs"), r("corr_peak").alias("corr_peak"), "flag_is_argmax")


view("star_rows", """
SELECT ticker, ts, expiry, max(CASE WHEN ry = 1 THEN strike END) AS star_true, max(CASE WHEN rc = 1 THEN strike END) AS star_pred, max(CASE WHEN ry = 1 THEN rc END) AS rank_of_true FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, ts, expiry ORDER BY abs(y) DESC, strike) AS ry, row_number() OVER (PARTITION BY ticker, ts, expiry ORDER BY abs(c) DESC, strike) AS rc FROM tcells)
GROUP BY ticker, ts, expiry""")


@query("src_11_comparison_files", """
SELECT 'node_comparison' AS file, ticker, count(*) AS n, round(sum(strike), 2) AS total, count(*) FILTER (abs(y) > 1000) AS hits FROM npairs GROUP BY ticker
UNION ALL SELECT 'star_comparison', ticker, count(*), CAST(sum(rank_of_true) AS DOUBLE), count(*) FILTER (star_true = star_pred) FROM star_rows GROUP BY ticker
UNION ALL SELECT 'per_record', ticker, count(*), CAST(sum(top6_overlap) AS DOUBLE), count(*) FILTER (king_exact) FROM rscore GROUP BY ticker
UNION ALL SELECT 'summary', 'all', count(*), round(avg(top6_overlap), 6), count(*) FILTER (king_exact) FROM rscore""")
def comparison_files(spark, sf):
    """Nodes, stars, records and the summary of a run, written and read back."""
    cells = pair_cells(spark, sf)
    nodes = scoring.node_pairs(cells).select("ticker", "ts", "strike", "y", "v")
    records = materialize(scoring.record_scores(cells, tolerance=tolerance()), "records")
    total = records.agg(F.count(F.lit(1)).alias("n"), F.avg("top6_overlap").alias("overlap"), F.count_if("king_exact").alias("exact"))
    path = scratch_dir(spark, "results")
    tables = {"node_comparison": nodes, "star_comparison": scoring.star_rows(cells), "per_record": records, "summary": total}
    sinks.write_results(path, **tables)
    back = {name: sinks.read_results(spark, path, name, df.schema) for name, df in tables.items()}

    def part(name, value, hit):
        rows = back[name]
        by = F.lit("all") if name == "summary" else F.col("ticker")
        return rows.groupBy(by.alias("ticker")).agg(F.count(F.lit(1)).alias("n"), value.cast("double").alias("total"), hit.alias("hits")).select(F.lit(name).alias("file"), "ticker", "n", "total", "hits")

    out = part("node_comparison", F.round(F.sum("strike"), 2), F.count_if(F.abs("y") > 1000))
    out = out.unionByName(part("star_comparison", F.sum("rank_of_true"), F.count_if(F.col("star_true") == F.col("star_pred"))))
    out = out.unionByName(part("per_record", F.sum("top6_overlap"), F.count_if("king_exact")))
    one = back["summary"].select(F.lit("summary").alias("file"), F.lit("all").alias("ticker"), "n", r("overlap").alias("total"), F.col("exact").alias("hits"))
    return out.unionByName(one)
