"""Weight, shape, trajectory and feature fits against the target grid."""

import numpy as np
from pyspark.sql import functions as F

from strikeloom.constants import FEATURES, LAMBDA_GRID
from strikeloom.functions.quantiles import exact_quantiles
from strikeloom.operators import fits, grid, rows, scoring, state
from strikeloom.operators.state import CELL_FEATURES
from strikeloom.plans.common import MONTH_GAP_S, d, m_cells, n, r
from strikeloom.plans.registry import query, view
from strikeloom.plans.scoring import kings_sql, nerr_sql, target, tolerance
from strikeloom.plans.sources import range_frames
from strikeloom.plans.states import _STABLE, m_features
from strikeloom.session import materialize

_REC = ["ticker", "ts"]


def target_cells(spark, sf):
    cells = target(m_cells(spark, sf))
    return materialize(cells, "target")


def target_nodes(cells):
    return cells.groupBy(*_REC, "strike").agg(F.sum("y").alias("y"))


view("tc", "SELECT *, month(expiry) * g + 10.0::DOUBLE * (call_oi - put_oi) AS y FROM cells_m")
view("tn", "SELECT ticker, ts, strike, sum(y) AS y FROM tc GROUP BY ALL")
view("csums", "SELECT ticker, ts, expiry, count(*) AS n, sum(y * g) AS s_yx, sum(g * g) AS s_xx, sum(y * y) AS s_yy, sum(abs(g)) AS s_ax FROM tc WHERE g <> 0 GROUP BY ALL")
view("free", "SELECT *, CASE WHEN n >= 5 THEN s_yx / s_xx END AS a, CASE WHEN n >= 5 THEN s_yx / s_xx * s_yx / s_yy END AS r2 FROM csums")
view("crho", """
SELECT ticker, ts, expiry, CASE WHEN count(*) >= 3 THEN coalesce(corr(ry, rx), 0) ELSE 0 END AS rho FROM (
  SELECT *, rank() OVER (PARTITION BY ticker, ts, expiry ORDER BY y) + (count(*) OVER (PARTITION BY ticker, ts, expiry, y) - 1) / 2.0::DOUBLE AS ry,
    rank() OVER (PARTITION BY ticker, ts, expiry ORDER BY g) + (count(*) OVER (PARTITION BY ticker, ts, expiry, g) - 1) / 2.0::DOUBLE AS rx FROM tc WHERE g <> 0) GROUP BY ALL""")


@query("fit_1_column_weights", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, n, round(a, 6) AS a, round(r2, 6) AS r2, round(rho, 6) + 0.0 AS rho FROM free JOIN crho USING (ticker, ts, expiry)""")
def column_weights(spark, sf):
    cells = target_cells(spark, sf)
    f = fits.free_weights(fits.column_sums(cells)).join(fits.column_spearman(cells), [*_REC, "expiry"])
    return f.select("ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), "n", r("a").alias("a"), r("r2").alias("r2"), r("rho").alias("rho"))


# SQL solve by Gauss-Jordan on the augmented matrix of each record.
def _augmented(cells: str, nodes: str, keys: str, join: str, ridge: str) -> str:
    on = " AND ".join(f"p.{k.strip()} = q.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT {keys}, any_value(lam) AS lam, list(e1 ORDER BY e1) AS es, list(b ORDER BY e1) AS bs, list(row ORDER BY e1) AS m FROM (
  SELECT {keys}, e1, any_value(b) AS b, any_value(lam) AS lam, list_append(list(s + CASE WHEN e1 = e2 THEN lam ELSE 0 END ORDER BY e2), any_value(b)) AS row FROM (
    SELECT x.*, {ridge} AS lam FROM (
      SELECT p.*, sum(CASE WHEN e1 = e2 THEN s ELSE 0 END) OVER (PARTITION BY {keys}) AS trace, count(*) OVER (PARTITION BY {keys}, e1) AS ne FROM (
        SELECT {', '.join('p.' + k.strip() for k in keys.split(','))}, p.expiry AS e1, q.expiry AS e2, p.b,
          coalesce(z.s, 0) AS s
        FROM (SELECT {keys}, expiry, sum(g * y) AS b FROM ({join}) GROUP BY ALL) p JOIN (SELECT DISTINCT {keys}, expiry FROM ({join})) q ON {on}
        LEFT JOIN (SELECT {', '.join('p.' + k.strip() for k in keys.split(','))}, p.expiry AS e1, q.expiry AS e2, sum(p.g * q.g) AS s FROM ({join}) p JOIN ({join}) q ON {on} AND p.strike = q.strike GROUP BY ALL) z
        ON {on.replace('q.', 'z.')} AND z.e1 = p.expiry AND z.e2 = q.expiry) p) x) GROUP BY {keys}, e1) GROUP BY {keys}"""


def _solve(aug: str, name: str, keys: str) -> str:
    return f"""
SELECT {keys}, lam, es, bs, 1 AS k, m FROM {aug}
UNION ALL SELECT {keys}, lam, es, bs, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(row, lambda x: x / m[k][k])
  ELSE list_transform(row, lambda x, j: x - row[k] * m[k][j] / m[k][k]) END) FROM {name} WHERE k <= len(m)"""


view("jcells", "SELECT c.ticker, c.ts, c.strike, c.expiry, c.g, t.y FROM tc c JOIN tn t USING (ticker, ts, strike) WHERE c.g <> 0")
view("jaug", _augmented("tc", "tn", "ticker, ts", "SELECT * FROM jcells", "1e-3::DOUBLE * trace / ne"))
view("jgj", _solve("jaug", "jgj", "ticker, ts"))
view("jsol", "SELECT ticker, ts, unnest(es) AS expiry, unnest(list_transform(m, lambda row: row[len(row)])) AS a FROM jgj WHERE k = len(m) + 1")


@query("fit_5_joint_ridge", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, round(a, 5) + 0.0 AS a FROM jsol""")
def joint_ridge(spark, sf):
    cells = target_cells(spark, sf)
    solved = fits.solve_ridge(fits.joint_gram(cells, target_nodes(cells), _REC), _REC)
    return fits.weights_long(solved, _REC).select("ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), r("a", 5).alias("a"))


view("shape_params", """
SELECT 'uniform' AS model, 0.0::DOUBLE AS param UNION ALL SELECT 'dte_power', i * 0.05::DOUBLE FROM range(61) x(i) UNION ALL SELECT 'size_power', -2.0::DOUBLE + i * 0.1::DOUBLE FROM range(41) x(i)""")
view("shape_best", """
SELECT ticker, ts, model, param, sse / nullif(sse_free, 0) AS sse_ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, ts, model ORDER BY sse, param) AS rn FROM (
    SELECT ticker, ts, model, param, sum(s_yy) - 2 * sum(s * s_yx) / sum(s * s * s_xx) * sum(s * s_yx) + (sum(s * s_yx) / sum(s * s * s_xx)) * (sum(s * s_yx) / sum(s * s * s_xx)) * sum(s * s * s_xx) AS sse,
      sum(s_yy) - sum(coalesce(a * s_yx, 0)) AS sse_free
    FROM (SELECT f.*, model, param, CASE model WHEN 'uniform' THEN 1.0::DOUBLE WHEN 'dte_power' THEN pow(greatest(date_diff('day', CAST(ts AS DATE), expiry), 0.25::DOUBLE), -param)
      ELSE pow(s_ax / max(s_ax) OVER (PARTITION BY ticker, ts, model, param), param) END AS s FROM free f CROSS JOIN shape_params) GROUP BY ticker, ts, model, param)) WHERE rn = 1""")


def shapes(spark, sf):
    free = materialize(fits.free_weights(fits.column_sums(target_cells(spark, sf))), "free")
    out = None
    for name, df in fits.baseline_shapes(free, F.to_date("ts")).items():
        one = df.withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return free, out


@query("fit_6_shape_models", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, model, round(param, 4) AS param, round(sse_ratio, 5) AS sse_ratio FROM shape_best""")
def shape_models(spark, sf):
    return shapes(spark, sf)[1].select("ticker", d("ts").alias("ts"), "model", r("param", 4).alias("param"), r("sse_ratio", 5).alias("sse_ratio"))


_XS = ["one", *FEATURES]
_X7 = ["one", *FEATURES[:-1]]
view("samples", """
SELECT ticker, ts, expiry, year(ts) AS fold, a, ln(abs(a)) AS la, 1.0::DOUBLE AS one, log_dte, log_gmag, net_col_sign_log, askbid_imbalance, doi_migration, com_dist_rel, tod_frac
FROM free JOIN feats_m USING (ticker, ts, expiry) WHERE a IS NOT NULL AND a <> 0""")
view("ols_train", "SELECT fold AS held, s.* EXCLUDE (fold) FROM (SELECT DISTINCT fold FROM samples) f JOIN samples s ON s.fold <> f.fold".replace("fold AS held, s.*", "f.fold AS held, s.*") + " UNION ALL SELECT NULL, * EXCLUDE (fold) FROM samples")
view("ols_aug", "SELECT held, 0 AS lam, 0 AS es, 0 AS bs, [" + ", ".join(
    "[" + ", ".join(f"sum({a} * {b})" for b in [*_X7, "la"]) + "]" for a in _X7) + "] AS m FROM ols_train GROUP BY held")
view("ols_gj", _solve("ols_aug", "ols_gj", "held"))
view("ols", "SELECT held, list_transform(m, lambda row: row[len(row)]) AS theta FROM ols_gj WHERE k = len(m) + 1")


def _samples(spark, sf, cells=None):
    cells = target_cells(spark, sf) if cells is None else cells
    free = fits.free_weights(fits.column_sums(cells)).select(*_REC, "expiry", "a")
    feats = grid.features(grid.columns(cells))
    return feats.join(free, [*_REC, "expiry"], "left").withColumns({"one": F.lit(1.0), "fold": F.year("ts").cast("bigint")})


def _fold_models(samples):
    usable = samples.where(F.col("a").isNotNull() & (F.col("a") != 0)).select("fold", *_XS, F.ln(F.abs("a")).alias("la"))
    return fits.fold_models(usable, "fold", _XS, F.col("la"))


@query("fit_7_feature_model", """
SELECT coalesce(held::VARCHAR, 'all') AS held_out, i - 1 AS term, round(CASE WHEN i <= 7 THEN theta[i] ELSE 0 END, 5) + 0.0 AS theta FROM ols, range(1, 9) x(i)""")
def feature_model(spark, sf):
    models = _fold_models(_samples(spark, sf))
    return models.select(F.coalesce(F.col("fold").cast("string"), F.lit("all")).alias("held_out"), F.posexplode("theta").alias("term", "t")).select(
        "held_out", n("term").alias("term"), r("t", 5).alias("theta"))


_DOT = " + ".join(f"theta[{i + 1}] * {c}" for i, c in enumerate(_X7))
view("heldout", f"""
SELECT s.*, CASE WHEN net_col_sign_log >= 0 THEN 1 ELSE -1 END * exp({_DOT}) AS ahat FROM (
  SELECT f.ticker, f.ts, f.expiry, year(f.ts) AS fold, w.a, 1.0::DOUBLE AS one, f.* EXCLUDE (ticker, ts, expiry) FROM feats_m f LEFT JOIN free w USING (ticker, ts, expiry)) s JOIN ols o ON o.held = s.fold""")
view("hpairs", """
SELECT c.ticker, c.ts, c.strike, sum(c.y) AS y, sum(c.g * h.ahat * h.kappa) AS v FROM tc c JOIN (
  SELECT *, coalesce(sum(a * ahat) OVER w / nullif(sum(CASE WHEN a IS NOT NULL THEN ahat * ahat END) OVER w, 0), 0) AS kappa FROM heldout WINDOW w AS (PARTITION BY ticker, ts)) h USING (ticker, ts, expiry) GROUP BY c.ticker, c.ts, c.strike""")
view("hkings", kings_sql("hpairs"))
view("hnerr", nerr_sql("hpairs"))


@query("fit_7_leave_one_day_out", """
SELECT a.fold, n_samples, round(sign_acc, 6) AS sign_acc, round(med_rel_err, 5) AS med_rel_err, n_records, round(med_ape, 5) AS med_ape, round(king_exact, 6) AS king_exact, round(king_tol, 6) AS king_tol
FROM (SELECT fold, count(*) AS n_samples, avg((CASE WHEN net_col_sign_log >= 0 THEN 1 ELSE -1 END = CASE WHEN a > 0 THEN 1 ELSE -1 END)::INT) AS sign_acc,
  quantile_cont(abs(abs(ahat) - abs(a)) / greatest(abs(a), 1e-12), 0.5) AS med_rel_err FROM heldout WHERE a IS NOT NULL AND a <> 0 GROUP BY fold) a
JOIN (SELECT year(ts) AS fold, count(*) AS n_records, quantile_cont(med_ape_unscaled, 0.5) AS med_ape, avg(king_exact::INT) AS king_exact, avg(king_in_tol::INT) AS king_tol
  FROM hkings JOIN hnerr USING (ticker, ts) GROUP BY ALL) b USING (fold)""")
def leave_one_day_out(spark, sf):
    cells = target_cells(spark, sf)
    samples = materialize(_samples(spark, sf, cells), "samples")
    theta = _fold_models(samples).where("fold is not null").select("fold", "theta")
    up = F.when(F.col("net_col_sign_log") >= 0, 1.0).otherwise(-1.0)
    held = samples.join(theta, "fold").withColumn("ahat", up * F.exp(fits.predict(F.col("theta"), _XS)))
    held = materialize(held.select(*_REC, "expiry", "fold", "a", "ahat", up.alias("up")), "held")
    scored = held.where(F.col("a").isNotNull() & (F.col("a") != 0)).withColumn(
        "err", F.abs(F.abs("ahat") - F.abs("a")) / F.greatest(F.abs("a"), F.lit(1e-12)))
    weights = scored.groupBy("fold").agg(F.count(F.lit(1)).alias("n_samples"), F.avg(F.when(F.col("up") == F.signum("a"), 1.0).otherwise(0.0)).alias("sign_acc"))
    weights = weights.join(exact_quantiles(scored, ["fold"], "err", {"med_rel_err": (0.5, "linear")}).drop("n"), "fold")
    kappa = held.groupBy(*_REC).agg((F.sum(F.col("a") * F.col("ahat")) / F.sum(F.when(F.col("a").isNotNull(), F.col("ahat") * F.col("ahat")))).alias("kappa"))
    w = held.join(kappa, _REC).select(*_REC, "expiry", (F.col("ahat") * F.coalesce("kappa", F.lit(0.0))).alias("w"))
    pairs = scoring.node_pairs(cells.join(w, [*_REC, "expiry"]).withColumn("c", F.col("w") * F.col("g")))
    rec = materialize(scoring.node_error(pairs).join(scoring.king_scores(pairs, tolerance=tolerance()), _REC).withColumn("fold", F.year("ts").cast("bigint")), "records")
    rate = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    ends = rec.groupBy("fold").agg(F.count(F.lit(1)).alias("n_records"), rate("king_exact").alias("king_exact"), rate("king_in_tol").alias("king_tol"))
    ends = ends.join(exact_quantiles(rec, ["fold"], "med_ape_unscaled", {"med_ape": (0.5, "linear")}).drop("n"), "fold")
    return weights.join(ends, "fold").select("fold", "n_samples", r("sign_acc").alias("sign_acc"), r("med_rel_err", 5).alias("med_rel_err"), "n_records",
                                             r("med_ape", 5).alias("med_ape"), r("king_exact").alias("king_exact"), r("king_tol").alias("king_tol"))


view("fcells", """
SELECT c.ticker, c.ts, f.frame, c.strike, c.expiry, c.g, f.value AS y FROM cells_m c JOIN rframes f USING (ticker, ts, strike) WHERE c.g <> 0""")
view("faug", _augmented("", "", "ticker, ts, frame", "SELECT * FROM fcells", "1e-3::DOUBLE * trace / ne"))
view("fgj", _solve("faug", "fgj", "ticker, ts, frame"))
view("fsol", """
SELECT ticker, ts, frame, len(es) AS n_expiries, lam, bs, list_transform(m, lambda row: row[len(row)]) AS a FROM fgj WHERE k = len(m) + 1""")
view("fr2", """
SELECT s.ticker, s.ts, s.frame, n_expiries, CASE WHEN st > 0 THEN 1 - (yy - list_dot_product(a, bs) - lam * list_dot_product(a, a)) / st ELSE 0 END AS r2
FROM fsol s JOIN (SELECT ticker, ts, frame, sum(value * value) AS yy, sum(value * value) - sum(value) * sum(value) / count(*) AS st, max(abs(value)) AS top FROM rframes GROUP BY ALL) n USING (ticker, ts, frame)
WHERE top > 0 AND n_expiries >= 2""")


def _frames(spark, sf, cells):
    raw = range_frames(spark, sf, cells)
    ts = F.to_timestamp("window_from")
    return materialize(raw.select(F.col("symbol").alias("ticker"), ts.alias("ts"), n("frame").alias("frame"), n("axis").alias("axis"), "strike", F.col("value").alias("y")), "frames")


@query("fit_8_trajectory_fit", "SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, frame, n_expiries, round(r2, 5) + 0.0 AS r2 FROM fr2")
def trajectory(spark, sf):
    cells = target_cells(spark, sf)
    out = fits.frame_fit(cells, _frames(spark, sf, cells), _REC)
    return out.select("ticker", d("ts").alias("ts"), "frame", n("n_expiries").alias("n_expiries"), r("r2", 5).alias("r2"))


_SIGNED = "CASE WHEN {0}_ask_vol > {0}_bid_vol THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"
view("basis_cells", f"""
SELECT * FROM (
  SELECT basis, c.ticker, c.ts, f.frame, c.strike, c.expiry, f.value AS y, CASE basis WHEN 'net' THEN call_gex - put_gex WHEN 'gross' THEN call_gex + put_gex
    WHEN 'flip' THEN {_SIGNED.format('call')} * abs(call_gex) - {_SIGNED.format('put')} * abs(put_gex)
    ELSE {_SIGNED.format('call')} * (call_volume + 0.5::DOUBLE * call_oi) - {_SIGNED.format('put')} * (put_volume + 0.5::DOUBLE * put_oi) END AS g
  FROM cells_m c JOIN rframes f USING (ticker, ts, strike) CROSS JOIN (VALUES ('net'), ('gross'), ('flip'), ('oi_size')) v(basis)) WHERE g <> 0""")
view("basis_aug", _augmented("", "", "basis, ticker, ts, frame", "SELECT * FROM basis_cells", "1e-3::DOUBLE * trace / ne"))
view("basis_gj", _solve("basis_aug", "basis_gj", "basis, ticker, ts, frame"))
view("basis_sol", """
SELECT basis, ticker, ts, frame, len(es) AS n_expiries, lam, bs, list_transform(m, lambda row: row[len(row)]) AS a FROM basis_gj WHERE k = len(m) + 1""")
view("basis_r2", """
SELECT s.basis, CASE WHEN st > 0 THEN 1 - (yy - list_dot_product(a, bs) - lam * list_dot_product(a, a)) / st ELSE 0 END AS r2
FROM basis_sol s JOIN (SELECT ticker, ts, frame, sum(value * value) AS yy, sum(value * value) - sum(value) * sum(value) / count(*) AS st, max(abs(value)) AS top FROM rframes GROUP BY ALL) n USING (ticker, ts, frame)
WHERE top > 0 AND n_expiries >= 2""")


@query("fit_15_basis_comparison", """
SELECT basis, count(*) AS n, round(list_sort(list(r2))[count(*) // 2 + 1], 4) AS r2_median, round(list_sort(list(r2))[count(*) // 4 + 1], 4) AS r2_p25,
  round(list_sort(list(r2))[least(CAST(floor(count(*) * 0.75::DOUBLE) AS BIGINT), count(*) - 1) + 1], 4) AS r2_p75 FROM basis_r2 GROUP BY basis""")
def basis_comparison(spark, sf):
    cells = target_cells(spark, sf)
    frames = _frames(spark, sf, cells)
    out = None
    for name in rows.BASES:
        one = fits.frame_fit(cells.withColumn("x", rows.basis(name)), frames, _REC, "x").withColumn("basis", F.lit(name)).select("basis", "r2")
        out = one if out is None else out.unionByName(one)
    q = exact_quantiles(materialize(out, "r2"), ["basis"], "r2", {"r2_median": (0.5, "upper"), "r2_p25": (0.25, "upper"), "r2_p75": (0.75, "upper")})
    return q.select("basis", "n", *[r(c, 4).alias(c) for c in ("r2_median", "r2_p25", "r2_p75")])


@query("fit_9_profiled_fit")
def profiled(spark, sf):
    cells = target_cells(spark, sf)
    cols = grid.columns(cells)
    w = materialize(grid.smoothed_weights(grid.psi(grid.features(cols)), MONTH_GAP_S), "weights")
    ranges = materialize(state.session_range(cols, F.date_trunc("year", "ts")), "ranges")
    node_scores = materialize(state.scores(state.interactions(cells, grid.batches(cols))), "scores")
    nodes = target_nodes(cells)
    month = 30 * 86400.0
    lams = (0.79, 0.99)
    moments = None
    for lam in lams:
        st = state.cell_state(cells, grid.batches(cols), lam, month)
        design = state.node_design(state.state_cells(st, w, ranges), node_scores).join(nodes, [*_REC, "strike"])
        one = fits.record_moments(design).withColumns({"run": F.lit(str(lam)), "fold": F.year("ts").cast("string")})
        moments = one if moments is None else moments.unionByName(one)
    moments = materialize(moments, "moments")
    folds = [row["fold"] for row in moments.select("fold").distinct().orderBy("fold").collect()]
    models = [(str(lam), f) for lam in lams for f in (None, *folds)]
    fit = fits.ProfiledFit(moments, models)
    beta, j = fit.fit()
    held = fit.objective(beta[:, None, :], held_out=True)[:, 0]
    best = max((j[i], m[0]) for i, m in enumerate(models) if m[1] is None)[1]
    out = [(f"lambda={m[0]}", float(m[0]), float(j[i]), [float(b) for b in beta[i]]) for i, m in enumerate(models) if m[1] is None]
    out += [(f"held_out={m[1]}", float(m[0]), float(held[i]), [float(b) for b in beta[i]]) for i, m in enumerate(models) if m[1] is not None and m[0] == best]
    return spark.createDataFrame(out, "run string, lam double, objective double, beta array<double>")


def _target_features(spark, sf):
    feats = m_features(spark, sf)
    y = target(m_cells(spark, sf)).select(*_REC, "strike", "expiry", "y")
    return materialize(feats.join(y, [*_REC, "strike", "expiry"]), "features")


def _feature_quartiles(spark, sf, names):
    long = fits.feature_cos2(_target_features(spark, sf), names, [*_REC, "expiry"])
    q = fits.quartiles(materialize(long, "cos2"), ["feature"], "cos2")
    return q.select("feature", "n", r("median", 5).alias("median"), r("p25", 5).alias("p25"), r("p75", 5).alias("p75"))


view("featy", "SELECT f.*, t.y FROM feat41 f JOIN tc t ON f.ticker = t.ticker AND f.ts = t.ts AND f.strike = t.strike AND f.expiry = t.expiry WHERE f.g <> 0")
_LIST = "[" + ", ".join(f"{{'f': '{c}', 'v': {c}::DOUBLE}}" for c in _STABLE) + "]"


@query("fit_10_feature_cos2", f"""
SELECT feature, count(*) AS n, round(quantile_cont(cos2, 0.5), 5) AS median, round(quantile_cont(cos2, 0.25), 5) AS p25, round(quantile_cont(cos2, 0.75), 5) AS p75 FROM (
  SELECT ticker, ts, expiry, u.f AS feature, sum(y * u.v) * sum(y * u.v) / (sum(y * y) * sum(u.v * u.v)) AS cos2 FROM (
    SELECT ticker, ts, expiry, y, unnest({_LIST}) AS u FROM featy) GROUP BY ALL HAVING count(*) >= 5 AND sum(y * y) > 0 AND sum(u.v * u.v) > 0) GROUP BY feature""")
def feature_cos2(spark, sf):
    return _feature_quartiles(spark, sf, _STABLE)


view("featz", """
SELECT f.* REPLACE (CASE WHEN s.lo = s.hi THEN 0 ELSE f.g_z END AS g_z) FROM featy f
JOIN (SELECT ticker, ts, expiry, min(g) AS lo, max(g) AS hi FROM cells_m GROUP BY ALL) s ON f.ticker = s.ticker AND f.ts = s.ts AND f.expiry = s.expiry""")
_ALL = "[" + ", ".join(f"{{'f': '{c}', 'v': {c}::DOUBLE}}" for c in CELL_FEATURES) + "]"


@query("fit_10_all_feature_cos2", f"""
SELECT feature, count(*) AS n, round(quantile_cont(cos2, 0.5), 5) AS median, round(quantile_cont(cos2, 0.25), 5) AS p25, round(quantile_cont(cos2, 0.75), 5) AS p75 FROM (
  SELECT ticker, ts, expiry, u.f AS feature, sum(y * u.v) * sum(y * u.v) / (sum(y * y) * sum(u.v * u.v)) AS cos2 FROM (
    SELECT ticker, ts, expiry, y, unnest({_ALL}) AS u FROM featz) GROUP BY ALL HAVING count(*) >= 5 AND sum(y * y) > 0 AND sum(u.v * u.v) > 0) GROUP BY feature""")
def all_feature_cos2(spark, sf):
    return _feature_quartiles(spark, sf, CELL_FEATURES)


@query("fit_10_ordinal_correlation", """
SELECT count(*) AS n, round(quantile_cont(rho, 0.5), 5) AS median, round(quantile_cont(rho, 0.25), 5) AS p25, round(quantile_cont(rho, 0.75), 5) AS p75 FROM (
  SELECT ticker, ts, expiry, corr(ry, rg) AS rho FROM (SELECT *, row_number() OVER (PARTITION BY ticker, ts, expiry ORDER BY y, strike) AS ry,
    row_number() OVER (PARTITION BY ticker, ts, expiry ORDER BY g, strike) AS rg FROM tc WHERE g <> 0) GROUP BY ALL HAVING count(*) >= 5 AND min(y) <> max(y) AND min(g) <> max(g))""")
def ordinal(spark, sf):
    rho = fits.ordinal_spearman(target_cells(spark, sf), [*_REC, "expiry"], "y", "g")
    return fits.quartiles(materialize(rho, "rho"), [], "rho").select("n", r("median", 5).alias("median"), r("p25", 5).alias("p25"), r("p75", 5).alias("p75"))


_CHAIN = ("g", "call_gex", "put_gex", "gex_value", "abs_gex", "dex_value", "net_dex")
_OI_VOL = ("net_oi", "tot_oi", "abs_oi", "doi_net", "doi_gross", "net_volume", "tot_volume", "cab", "pab", "imb", "iv")
_SHAPE = ("x", "ax", "x2", "sgx", "expd", "g_x", "g_sgx", "abs_g_expd", "g_expd", "net_oi_expd", "net_oi_x", "g_colnorm", "g_z")
_ACCUM = ("cum_net_volume", "cum_imb", "cum_doi_net", "ewma_g_slow", "g_dev_slow", "ewma_g_fast", "g_dev_fast", "n_batches")
# call_dex and put_dex are in no group of their own: dex_value and net_dex are their sum and difference.
FEATURE_GROUPS = {"chain": _CHAIN, "chain+oi_vol": _CHAIN + _OI_VOL, "chain+shape": _CHAIN + _SHAPE, "chain+accum": _CHAIN + _ACCUM,
                  "all": _CHAIN + _OI_VOL + _SHAPE + _ACCUM}
_FITTED = FEATURE_GROUPS["all"]


def theta_fit(spark, sf, groups, held_out=True):
    """Fits over the cell features by group; a missing value counts as 0."""
    feats = _target_features(spark, sf).fillna(0.0, list(_FITTED))
    means, norms = fits.standardization(feats, _FITTED)
    packed = materialize(fits.packed_columns(feats, _FITTED, [*_REC, "expiry"], "y", F.year("ts")), "packed")
    folds = [row["fold"] for row in packed.select("fold").distinct().orderBy("fold").collect()] if held_out else []
    places = {g: [_FITTED.index(c) for c in FEATURE_GROUPS[g]] for g in groups}
    return feats, packed, means, norms, fits.alternating_fits(packed, means, norms, folds, groups=places)


@query("fit_11_alternating_fit")
def alternating(spark, sf):
    _, packed, means, norms, models = theta_fit(spark, sf, FEATURE_GROUPS)
    long = fits.fitted_cos2(packed, means, norms, models)
    q = fits.quartiles(materialize(long, "cos2"), ["group", "scope"], "cos2").select("group", "scope", "n", F.col("median").alias("median_cos2"))
    info = spark.createDataFrame(
        [(g, f or "in_sample", len(h), list(FEATURE_GROUPS[g]), [float(t[_FITTED.index(c)]) for c in FEATURE_GROUPS[g]]) for (g, f), (t, h) in models.items()],
        "group string, scope string, iterations int, features array<string>, theta array<double>")
    return q.join(F.broadcast(info), ["group", "scope"])


_VARIANTS = [
    {"name": "base"}, {"name": "pow_0", "power": 0.0}, {"name": "pow_0.25", "power": 0.25}, {"name": "pow_0.5", "power": 0.5},
    {"name": "pow_0.85", "power": 0.85}, {"name": "clip_13.3", "clip": 13.3}, {"name": "clip_50", "clip": 50.0}, {"name": "clip_623", "clip": 623.0},
    {"name": "sign_flip", "sign": "flip"}, {"name": "sign_flow", "sign": "flow"}, {"name": "positive", "sign": "positive"},
    {"name": "basis_flip", "basis": "flip"}, {"name": "basis_oi_size", "basis": "oi_size"}, {"name": "pow_0.7_clip_623", "power": 0.7, "clip": 623.0},
]
_MORE_VARIANTS = [
    {"name": "pow_0.7", "power": 0.7}, {"name": "clip_3740", "clip": 3740.0},
    {"name": "basis_flip_pow_0.5", "basis": "flip", "power": 0.5}, {"name": "basis_oi_size_pow_0.5", "basis": "oi_size", "power": 0.5},
]
view("variants", "SELECT * FROM (VALUES " + ", ".join(
    f"('{v['name']}', {v.get('power', 1.0)}::DOUBLE, {'NULL' if v.get('clip') is None else v['clip']}::DOUBLE, '{v.get('sign', 'net')}', '{v.get('basis', 'net')}')" for v in _VARIANTS + _MORE_VARIANTS)
    + ") v(variant, power, clip, sign_rule, basis)")
view("vcells", """
SELECT *, fc * abs(call_gex) - fp * abs(put_gex) AS b_flip, fc * (call_volume + 0.5 * call_oi) - fp * (put_volume + 0.5 * put_oi) AS b_oi FROM (
  SELECT *, CASE WHEN call_ask_vol > call_bid_vol THEN 1 ELSE -1 END AS fc, CASE WHEN put_ask_vol > put_bid_vol THEN 1 ELSE -1 END AS fp FROM tc)""")
view("vcols", """
SELECT ticker, ts, expiry, sum(b_flip) AS flip, sum((call_ask_vol - call_bid_vol) - (put_ask_vol - put_bid_vol)) AS flow FROM vcells GROUP BY ALL""")
view("vweights", """
SELECT ticker, ts, expiry, variant, basis, coalesce(CASE sign_rule WHEN 'flip' THEN CASE WHEN flip >= 0 THEN 1 ELSE -1 END WHEN 'flow' THEN CASE WHEN flow >= 0 THEN 1 ELSE -1 END WHEN 'positive' THEN 1 ELSE sign(a) END
  * CASE WHEN clip IS NOT NULL AND hi / lo > clip THEN greatest(least(mag, gm * sqrt(clip)), gm / sqrt(clip)) ELSE mag END, 0) AS av FROM (
  SELECT *, min(mag) OVER w AS lo, max(mag) OVER w AS hi, exp(avg(ln(mag)) OVER w) AS gm FROM (
    SELECT w.ticker, w.ts, w.expiry, w.a, c.flip, c.flow, v.*, CASE WHEN a <> 0 THEN pow(abs(a), power) END AS mag FROM weights_m w JOIN vcols c USING (ticker, ts, expiry) CROSS JOIN variants v)
  WINDOW w AS (PARTITION BY ticker, ts, variant))""")
view("vpairs", """
SELECT variant, c.ticker, c.ts, c.strike, sum(c.y) AS y, sum(av * CASE basis WHEN 'flip' THEN b_flip WHEN 'oi_size' THEN b_oi ELSE g END) AS v FROM vcells c JOIN vweights w USING (ticker, ts, expiry) GROUP BY ALL""")
view("vkings", kings_sql("vpairs", "variant, ticker, ts"))


_SWEEP = "SELECT variant, ticker, count(*) AS n, count(*) FILTER (king_exact) AS n_exact, count(*) FILTER (king_in_tol) AS n_tol FROM vkings"


@query("fit_12_variant_sweep", f"{_SWEEP} WHERE variant IN ({', '.join(repr(v['name']) for v in _VARIANTS)}) GROUP BY ALL")
def variant_sweep(spark, sf):
    return _rates(_sweep(spark, sf, _VARIANTS), "variant", "ticker")


@query("fit_12_all_variants", f"{_SWEEP} GROUP BY ALL")
def all_variants(spark, sf):
    return _rates(_sweep(spark, sf, _VARIANTS + _MORE_VARIANTS), "variant", "ticker")


@query("fit_12_variants_by_day", """
SELECT variant, coalesce(ticker, 'all') AS ticker, coalesce(strftime(ts, '%Y-%m-%d'), 'all') AS day, count(*) AS n,
  round(count(*) FILTER (king_exact) / count(*)::DOUBLE, 6) AS exact_rate, round(count(*) FILTER (king_in_tol) / count(*)::DOUBLE, 6) AS tol_rate
FROM vkings GROUP BY GROUPING SETS ((variant), (variant, ticker), (variant, ts), (variant, ticker, ts))""")
def variants_by_day(spark, sf):
    """Rates of every variant over all, by symbol, by day and by both."""
    k = _sweep(spark, sf, _VARIANTS + _MORE_VARIANTS).withColumn("day", d("ts"))
    sets = k.groupingSets([["variant"], ["variant", "ticker"], ["variant", "day"], ["variant", "ticker", "day"]], "variant", "ticker", "day").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("king_exact").alias("n_exact"), F.count_if("king_in_tol").alias("n_tol"))
    return sets.select(
        "variant", F.coalesce("ticker", F.lit("all")).alias("ticker"), F.coalesce("day", F.lit("all")).alias("day"), "n",
        r(F.col("n_exact") / F.col("n")).alias("exact_rate"), r(F.col("n_tol") / F.col("n")).alias("tol_rate"))


def _rates(kings, *by):
    return kings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if("king_exact").alias("n_exact"), F.count_if("king_in_tol").alias("n_tol"))


def _sweep(spark, sf, variants):
    cells = target_cells(spark, sf).withColumns({"b_flip": rows.basis("flip"), "b_oi": rows.basis("oi_size")})
    flow = (F.col("call_ask_vol") - F.col("call_bid_vol")) - (F.col("put_ask_vol") - F.col("put_bid_vol"))
    sums = cells.groupBy(*_REC, "expiry").agg(F.sum("b_flip").alias("flip"), F.sum(flow).alias("flow"))
    w = grid.smoothed_weights(grid.psi(grid.features(grid.columns(cells))), MONTH_GAP_S).select(*_REC, "expiry", "a").join(sums, [*_REC, "expiry"])
    vw = fits.variant_weights(w, variants)
    value = F.when(F.col("basis") == "flip", F.col("b_flip")).when(F.col("basis") == "oi_size", F.col("b_oi")).otherwise(F.col("g"))
    both = cells.select(*_REC, "strike", "expiry", "g", "b_flip", "b_oi", "y").join(vw, [*_REC, "expiry"]).withColumn("c", F.col("av") * value)
    keys = ["variant", *_REC]
    return scoring.king_scores(scoring.node_pairs(both, keys), keys, tolerance())


def _bound_views(x, cells):
    """Views of the two bounds on the within-column value ``g`` of ``cells``; ``x`` ends their names."""
    view(f"jcells{x}", f"SELECT c.ticker, c.ts, c.strike, c.expiry, c.g, t.y FROM {cells} c JOIN tn t USING (ticker, ts, strike) WHERE c.g <> 0")
    view(f"jaug0{x}", _augmented(cells, "tn", "ticker, ts", f"SELECT * FROM jcells{x}", "1e-9::DOUBLE"))
    view(f"jgj0{x}", _solve(f"jaug0{x}", f"jgj0{x}", "ticker, ts"))
    view(f"jsol0{x}", f"SELECT ticker, ts, unnest(es) AS expiry, unnest(list_transform(m, lambda row: row[len(row)])) AS a FROM jgj0{x} WHERE k = len(m) + 1")
    view(f"freeall{x}", f"SELECT ticker, ts, expiry, sum(y * g) / sum(g * g) AS a FROM {cells} WHERE g <> 0 GROUP BY ALL")
    view(f"bpairs{x}", f"""
SELECT bound, c.ticker, c.ts, c.strike, sum(c.y) AS y, sum(coalesce(w.a, 0) * c.g) AS v FROM {cells} c CROSS JOIN (VALUES ('free'), ('joint')) b(bound)
LEFT JOIN (SELECT 'free' AS bound, * FROM freeall{x} UNION ALL SELECT 'joint', * FROM jsol0{x}) w USING (bound, ticker, ts, expiry) GROUP BY ALL""")
    view(f"bkings{x}", kings_sql(f"bpairs{x}", "bound, ticker, ts"))
    return f"SELECT bound, ticker, count(*) AS n, count(*) FILTER (king_exact) AS n_exact, count(*) FILTER (king_in_tol) AS n_tol FROM bkings{x} GROUP BY ALL"


def bound_weights(cells, x="g"):
    free = fits.free_weights(fits.column_sums(cells, x=x), 1).select(*_REC, "expiry", "a").withColumn("bound", F.lit("free"))
    solved = fits.solve_ridge(fits.joint_gram(cells, target_nodes(cells), _REC, x), _REC, 0.0, 1e-9)
    return free.unionByName(fits.weights_long(solved, _REC).withColumn("bound", F.lit("joint")))


@query("fit_13_upper_bounds", _bound_views("", "tc"))
def upper_bounds(spark, sf):
    return _bounds(target_cells(spark, sf))


view("tc_flip", "SELECT * REPLACE (b_flip AS g) FROM vcells")


@query("fit_13_flip_bounds", _bound_views("_flip", "tc_flip"))
def flip_bounds(spark, sf):
    return _bounds(target_cells(spark, sf).withColumn("g", rows.basis("flip")))


def _bounds(cells):
    cells = cells.select(*_REC, "strike", "expiry", "g", "y")
    both = fits.param_rows(cells, "_i", [0, 1]).withColumn("bound", F.when(F.col("_i") == 0, "free").otherwise("joint"))
    both = both.join(bound_weights(cells), ["bound", *_REC, "expiry"], "left").withColumn("c", F.coalesce("a", F.lit(0.0)) * F.col("g"))
    keys = ["bound", *_REC]
    return _rates(scoring.king_scores(scoring.node_pairs(both, keys), keys, tolerance()), "bound", "ticker")


@query("fit_23_model_evaluation")
def model_evaluation(spark, sf):
    feats, _, means, norms, models = theta_fit(spark, sf, ["all"], held_out=False)
    fitted = fits.standardized_value(_FITTED, models["all", None][0], means, norms)
    cells = feats.select(*_REC, "strike", "expiry", "spot", "y", F.col("g"), fitted.alias("fit"))
    shaped = materialize(grid.shaped(cells).select(*_REC, "strike", "expiry", "y", "g", "h", "fit"), "shaped")
    w = grid.smoothed_weights(grid.psi(grid.features(grid.columns(m_cells(spark, sf)))), MONTH_GAP_S)
    w = materialize(w.select(*_REC, "expiry", "a", F.lit("production").alias("bound")), "weights")
    out = None
    for basis in ("g", "h", "fit"):
        all_w = w.unionByName(bound_weights(shaped, basis))
        one = shaped.join(all_w, [*_REC, "expiry"]).select(*_REC, "strike", "y", (F.col("a") * F.col(basis)).alias("c"), F.concat_ws("_", F.lit(basis), "bound").alias("model"))
        out = one if out is None else out.unionByName(one)
    keys = ["model", *_REC]
    pairs = materialize(scoring.node_pairs(out, keys), "pairs")
    rec = materialize(scoring.node_error(pairs, keys).join(scoring.king_scores(pairs, keys, tolerance()), keys), "records")
    rate = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    card = rec.groupBy("model").agg(F.count(F.lit(1)).alias("n"), rate("king_exact").alias("king_exact"), rate("king_in_tol").alias("king_tol"), F.avg("top6_overlap").alias("overlap"))
    med = exact_quantiles(rec, ["model"], "med_ape", {"med_ape": (0.5, "linear")}).drop("n")
    return card.join(med, "model").select("model", "n", *[r(c, 4).alias(c) for c in ("king_exact", "king_tol", "overlap", "med_ape")])


view("traj", "SELECT *, lead(a) OVER (PARTITION BY ticker, expiry ORDER BY ts) AS nxt, avg(a) OVER (PARTITION BY ticker, expiry) AS mean, count(*) OVER (PARTITION BY ticker, expiry) AS np FROM free WHERE a IS NOT NULL AND a <> 0")


@query("win_16_persistence_error", f"""
SELECT ticker, lam, count(*) AS n, round(avg(pow(nxt - (lam * a + (1 - lam) * mean), 2)), 5) AS mse FROM traj
CROSS JOIN (VALUES {', '.join(f'({x}::DOUBLE)' for x in LAMBDA_GRID)}) v(lam) WHERE np >= 10 AND nxt IS NOT NULL GROUP BY ALL""")
def persistence(spark, sf):
    free = fits.free_weights(fits.column_sums(target_cells(spark, sf)))
    return fits.persistence_error(free, ["ticker", "expiry"], ["ticker"]).select("ticker", "lam", "n", r("mse", 5).alias("mse"))


@query("fit_24_fit_summary", """
SELECT metric, count(*) AS n, round(list_sort(list(value))[count(*) // 2 + 1], 5) AS median, round(list_sort(list(value))[count(*) // 4 + 1], 5) AS p25, round(list_sort(list(value))[3 * count(*) // 4 + 1], 5) AS p75 FROM (
  SELECT 'cols_fit' AS metric, count(a)::DOUBLE AS value FROM free GROUP BY ticker, ts
  UNION ALL SELECT 'col_r2', quantile_cont(r2, 0.5) FROM free WHERE r2 IS NOT NULL GROUP BY ticker, ts
  UNION ALL SELECT 'sse_' || model, sse_ratio FROM shape_best UNION ALL SELECT 'param_' || model, param FROM shape_best WHERE model <> 'uniform') GROUP BY metric""")
def fit_summary(spark, sf):
    free, best = shapes(spark, sf)
    n_cols = free.groupBy(*_REC).agg(F.count("a").cast("double").alias("value")).select(F.lit("cols_fit").alias("metric"), "value")
    q = exact_quantiles(free.where("r2 is not null"), _REC, "r2", {"value": (0.5, "linear")}).select(F.lit("col_r2").alias("metric"), "value")
    best = materialize(best, "shapes")
    sse = best.select(F.concat(F.lit("sse_"), "model").alias("metric"), F.col("sse_ratio").alias("value"))
    par = best.where("model <> 'uniform'").select(F.concat(F.lit("param_"), "model").alias("metric"), F.col("param").alias("value"))
    long = n_cols.unionByName(q).unionByName(sse).unionByName(par)
    out = exact_quantiles(materialize(long, "metrics"), ["metric"], "value", {"median": (0.5, "upper"), "p25": (0.25, "upper"), "p75": (0.75, "upper")})
    return out.select("metric", "n", *[r(c, 5).alias(c) for c in ("median", "p25", "p75")])
