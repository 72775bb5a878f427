"""Compare a model grid with a target grid: errors, kings, stars, classes, scorecards.

A record is one grid (for example one batch of one ticker). Windows and arrays
here run over the strikes or cells of a single record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.constants import INDEX_SYMBOLS, KING_TOL_INDEX, KING_TOL_OTHER, MATERIAL_FRAC, NEAR_TIE
from strikeloom.functions.quantiles import array_quantile, exact_quantiles
from strikeloom.functions.scalar import ratio, ratio_or

RECORD = ("ticker", "ts")


def node_pairs(cells: DataFrame, keys: Sequence[str] = RECORD, y: str = "y", v: str = "c") -> DataFrame:
    """Node values of target and model from cells holding both."""
    return cells.groupBy(*keys, "strike").agg(
        F.sum(F.coalesce(y, F.lit(0.0))).alias("y"), F.sum(F.coalesce(v, F.lit(0.0))).alias("v"))


def node_error(pairs: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """Error of material nodes after one scale factor per record, and without it."""
    w = Window.partitionBy(*keys)
    rows = pairs.withColumns({
        "_vv": F.sum(F.col("v") * F.col("v")).over(w), "_yv": F.sum(F.col("y") * F.col("v")).over(w),
        "_top": F.max(F.abs("y")).over(w),
    }).where(F.col("_top") > 0)
    material = F.abs("y") >= MATERIAL_FRAC * F.col("_top")
    scale = ratio_or("_yv", "_vv", 0.0)
    base = F.greatest(F.abs("y"), F.lit(1e-12))
    rows = rows.where(material).withColumns({
        "c_scale": scale, "_e": F.abs(scale * F.col("v") - F.col("y")) / base, "_u": F.abs(F.col("v") - F.col("y")) / base})
    out = rows.groupBy(*keys).agg(
        F.max("c_scale").alias("c_scale"), F.count(F.lit(1)).alias("n_material"), F.collect_list("_e").alias("_es"),
        F.collect_list("_u").alias("_us"), F.sum(F.col("y") * F.col("v")).alias("_d"),
        F.sum(F.col("y") * F.col("y")).alias("_a"), F.sum(F.col("v") * F.col("v")).alias("_b"))
    return out.select(
        *keys, "c_scale", "n_material", array_quantile(F.col("_es"), 0.5, "upper").alias("med_ape"),
        array_quantile(F.col("_es"), 0.9, "upper").alias("p90_ape"),
        array_quantile(F.col("_us"), 0.5, "linear").alias("med_ape_unscaled"),
        ratio_or(F.col("_d") * F.col("_d"), F.col("_a") * F.col("_b"), 0.0).alias("cos2"))


def king_tolerance(index_symbols: Sequence[str] = INDEX_SYMBOLS) -> Column:
    """Strike tolerance of a row's ticker: wide for the index symbols."""
    return F.when(F.col("ticker").isin(*index_symbols), F.lit(KING_TOL_INDEX)).otherwise(F.lit(KING_TOL_OTHER))


def king_scores(pairs: DataFrame, keys: Sequence[str] = RECORD, tolerance: Column | None = None, top: int = 6) -> DataFrame:
    tolerance = king_tolerance() if tolerance is None else tolerance
    by_y = Window.partitionBy(*keys).orderBy(F.abs("y").desc(), "strike")
    by_v = Window.partitionBy(*keys).orderBy(F.abs("v").desc(), "strike")
    rows = pairs.withColumns({"_ry": F.row_number().over(by_y), "_rv": F.row_number().over(by_v)})
    out = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("_ry") == 1, F.col("strike"))).alias("king_true"),
        F.max(F.when(F.col("_rv") == 1, F.col("strike"))).alias("king_pred"),
        F.count_if((F.col("_ry") <= top) & (F.col("_rv") <= top)).alias("top6_overlap"))
    return out.withColumns({
        "king_exact": F.col("king_true") == F.col("king_pred"),
        "king_in_tol": F.abs(F.col("king_true") - F.col("king_pred")) <= tolerance})


def star_scores(cells: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """Column stars and the grid star of target ``y`` and model ``c``."""
    col = Window.partitionBy(*keys, "expiry")
    grid = Window.partitionBy(*keys)
    rows = cells.withColumns({
        "_ry": F.row_number().over(col.orderBy(F.abs("y").desc(), "strike")),
        "_rc": F.row_number().over(col.orderBy(F.abs("c").desc(), "strike")),
        "_gy": F.row_number().over(grid.orderBy(F.abs("y").desc(), "strike", "expiry")),
        "_gc": F.row_number().over(grid.orderBy(F.abs("c").desc(), "strike", "expiry"))})
    star = (F.col("_ry") == 1) & (F.col("y") != 0)
    return rows.groupBy(*keys).agg(
        F.count_if(star).alias("star_total"), F.count_if(star & (F.col("_rc") == 1)).alias("star_exact"),
        F.count_if(star & (F.col("_rc") <= 3)).alias("star_top3"),
        (F.count_if((F.col("_gy") == 1) & (F.col("_gc") == 1)) > 0).alias("global_star_exact"))


def star_rows(cells: DataFrame, keys: Sequence[str] = RECORD) -> DataFrame:
    """Per column: the strikes of the target's and the model's star, and the model's rank of the target's."""
    col = Window.partitionBy(*keys, "expiry")
    rows = cells.withColumns({
        "_ry": F.row_number().over(col.orderBy(F.abs("y").desc(), "strike")), "_rc": F.row_number().over(col.orderBy(F.abs("c").desc(), "strike"))})
    first = F.col("_ry") == 1
    return rows.groupBy(*keys, "expiry").agg(
        F.max(F.when(first, F.col("strike"))).alias("star_true"), F.max(F.when(F.col("_rc") == 1, F.col("strike"))).alias("star_pred"),
        F.max(F.when(first, F.col("y"))).alias("star_y"), F.max(F.when(first, F.col("_rc"))).alias("rank_of_true"))


def record_scores(cells: DataFrame, keys: Sequence[str] = RECORD, tolerance: Column | None = None) -> DataFrame:
    pairs = node_pairs(cells, keys)
    return node_error(pairs, keys).join(king_scores(pairs, keys, tolerance), list(keys)).join(star_scores(cells, keys), list(keys))


def scorecard(scores: DataFrame, scope: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Rates per scope value and overall."""
    rows = scores.withColumn("scope", F.explode(F.array(scope.cast("string"), F.lit("overall"))))
    keys = [*keys, "scope"]
    rate = lambda c: F.avg(F.when(F.col(c), 1.0).otherwise(0.0))
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"), rate("king_exact").alias("king_exact_rate"), rate("king_in_tol").alias("king_tol_rate"),
        F.avg("top6_overlap").alias("overlap_mean"), rate("global_star_exact").alias("global_star_rate"),
        (F.sum("star_exact") / F.greatest(F.sum("star_total"), F.lit(1))).alias("star_exact_rate"),
        (F.sum("star_top3") / F.greatest(F.sum("star_total"), F.lit(1))).alias("star_top3_rate"))
    med = exact_quantiles(rows, keys, "med_ape", {"med_ape": (0.5, "upper")}).drop("n")
    return out.join(med, keys, "left")


def cross_tab(scores: DataFrame, rows: Column, cols: Column) -> DataFrame:
    """Counts and exact rates by both labels, by each label and in total."""
    named = scores.withColumns({"_row": rows.cast("string"), "_col": cols.cast("string")})
    return named.cube("_row", "_col").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("king_exact").alias("n_exact"), F.count_if("king_in_tol").alias("n_tol")
    ).select(F.coalesce("_row", F.lit("all")).alias("row"), F.coalesce("_col", F.lit("all")).alias("col"), "n", "n_exact", "n_tol",
             (F.col("n_exact") / F.col("n")).alias("exact_rate"), ratio(F.col("n_tol") - F.col("n_exact"), F.col("n") - F.col("n_exact")).alias("tol_of_misses"))


def gate(card: DataFrame, min_exact: float = 0.90, max_ape: float = 0.10, min_days: int = 20, n_days: Column | None = None) -> DataFrame:
    """Measured against the bar, one row per criterion."""
    days = F.lit(None).cast("double") if n_days is None else n_days
    checks = F.array(
        F.struct(F.lit("king_exact_rate").alias("metric"), F.col("king_exact_rate").alias("measured"), F.lit(min_exact).alias("bar"),
                 (F.col("king_exact_rate") >= min_exact).alias("met")),
        F.struct(F.lit("node_med_ape").alias("metric"), F.col("med_ape").alias("measured"), F.lit(max_ape).alias("bar"),
                 (F.col("med_ape") <= max_ape).alias("met")),
        F.struct(F.lit("session_days").alias("metric"), days.cast("double").alias("measured"), F.lit(float(min_days)).alias("bar"),
                 (days >= min_days).alias("met")))
    return card.where("scope = 'overall'").select(F.explode(checks).alias("c")).select("c.*")


def compare_runs(before: DataFrame, after: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics of two runs side by side with their difference."""
    long = None
    for label, df in (("before", before), ("after", after)):
        one = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")
        one = one.withColumn("run", F.lit(label))
        long = one if long is None else long.unionByName(one)
    out = long.groupBy(*keys, "metric").pivot("run", ["before", "after"]).agg(F.max("value"))
    return out.withColumn("delta", F.col("after") - F.col("before"))


def classify_misses(cells: DataFrame, kings: DataFrame, keys: Sequence[str] = RECORD, tolerance: Column | None = None) -> DataFrame:
    """Why the predicted king differs from the true one.

    ``cells`` hold target ``y``, weight ``a`` and basis ``g``. Only the two strikes
    of each record are looked at, in one pass.
    """
    rows = cells.join(kings.select(*keys, "king_true", "king_pred"), list(keys))
    is_t, is_p = F.col("strike") == F.col("king_true"), F.col("strike") == F.col("king_pred")
    part = F.coalesce("a", F.lit(0.0)) * F.col("g")
    spread = rows.where(F.col("a") != 0).groupBy(*keys).agg((F.max(F.abs("a")) / F.min(F.abs("a"))).alias("a_spread"))

    def at(flag, value):
        return F.when(flag, value)

    first = lambda size: F.struct(size, -F.unix_date("expiry"))
    out = rows.where(is_t | is_p).groupBy(*keys, "king_true", "king_pred").agg(
        F.abs(F.coalesce(F.sum(at(is_t, F.col("y"))), F.lit(0.0))).alias("y_t"), F.abs(F.coalesce(F.sum(at(is_p, F.col("y"))), F.lit(0.0))).alias("y_p"),
        F.abs(F.coalesce(F.sum(at(is_t, F.col("c"))), F.lit(0.0))).alias("o_t"), F.abs(F.coalesce(F.sum(at(is_p, F.col("c"))), F.lit(0.0))).alias("o_p"),
        F.coalesce(F.sum(at(is_t, F.abs(part))), F.lit(0.0)).alias("gross_t"), F.coalesce(F.sum(at(is_p, F.abs(part))), F.lit(0.0)).alias("gross_p"),
        F.max_by(F.col("expiry"), at(is_p, first(F.abs(part)))).alias("dom_ours"),
        F.max_by(F.col("expiry"), at(is_t, first(F.abs("y")))).alias("dom_true"))
    label = (
        F.when(F.col("king_true") == F.col("king_pred"), "exact")
        .when((F.col("y_t") > 0) & (F.col("y_p") >= NEAR_TIE * F.col("y_t")), "near_tie_intrinsic")
        .when((F.col("o_p") > 0) & (F.col("o_t") >= NEAR_TIE * F.col("o_p")), "near_tie_ours")
        .when(F.col("gross_t") >= F.col("gross_p"), "sign_cancellation").otherwise("expiry_mislocation"))
    return out.join(spread, list(keys), "left").withColumns({
        "label": label, "driver_mismatch": F.col("dom_ours") != F.col("dom_true"),
        "err_tol_units": F.abs(F.col("king_pred") - F.col("king_true")) / (king_tolerance() if tolerance is None else tolerance)})


def column_rank_of_star(cells: DataFrame, keys: Sequence[str] = RECORD, min_shared: int = 5) -> DataFrame:
    """Rank, in the |g| order of its column, of the strike where the target column peaks."""
    col = Window.partitionBy(*keys, "expiry")
    rows = cells.withColumns({
        "_n": F.count(F.lit(1)).over(col), "_rg": F.row_number().over(col.orderBy(F.abs("g").desc(), "strike")),
        "_ry": F.row_number().over(col.orderBy(F.abs("y").desc(), "strike"))})
    return rows.where((F.col("_ry") == 1) & (F.col("_n") >= min_shared)).select(
        *keys, "expiry", F.col("_n").alias("n_shared"), F.col("strike").alias("star"), F.col("_rg").alias("rank"))


def semantics_probe(cells: DataFrame, vector: DataFrame, keys: Sequence[str] = RECORD, tol: float = 1e-6) -> DataFrame:
    """Is a node vector the sum, the absolute sum or the signed largest cell of each row?"""
    cand = cells.groupBy(*keys, "strike").agg(
        F.sum("g").alias("h_sum"), F.sum(F.abs("g")).alias("h_abs"), F.max_by("g", F.struct(F.abs("g"), F.col("g"))).alias("h_peak"))
    rows = vector.join(cand, [*keys, "strike"])
    top = F.max(F.abs("value")).over(Window.partitionBy(*keys))
    rows = rows.withColumn("_top", top)
    aggs = [F.count(F.lit(1)).alias("n"), (F.count_if(F.col("is_king") & (F.abs("value") >= F.col("_top"))) > 0).alias("flag_is_argmax")]
    for h in ("sum", "abs", "peak"):
        aggs += [F.count_if(F.abs(F.col("value") - F.col(f"h_{h}")) < tol).alias(f"exact_{h}"),
                 F.coalesce(F.nanvl(F.corr("value", f"h_{h}"), F.lit(0.0)), F.lit(0.0)).alias(f"corr_{h}")]
    return rows.groupBy(*keys).agg(*aggs)
