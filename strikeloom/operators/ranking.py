"""Ticker features, cross-sectional ranks, scores and precision against truth lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.constants import SCORE_FEATURES, SURPRISE_DAYS
from strikeloom.functions.ordered import average_rank, ranked
from strikeloom.functions.scalar import percentile_of_history, ratio


def ticker_day(days: DataFrame) -> DataFrame:
    """Contract days to ticker days."""
    return days.groupBy("underlying", "day").agg(
        F.count(F.lit(1)).alias("contracts"), F.sum("volume").alias("volume"), F.sum("premium").alias("premium"),
        F.sum("oi").alias("oi"), F.sum("prev_oi").alias("prev_oi"), F.sum("ask_volume").alias("ask_volume"),
        F.sum("bid_volume").alias("bid_volume"), F.sum("mid_volume").alias("mid_volume"),
        F.countDistinct("strike").alias("n_strikes"),
    )


def flow_score_day(scored: DataFrame, next_day_exclusive: Column | None = None) -> DataFrame:
    """Scored prints to ticker days: count, premium, mean score and bonus, sweep share."""
    return scored.groupBy("underlying", "day").agg(
        F.count(F.lit(1)).alias("n"), F.sum("premium").alias("premium"), F.avg("flow_score").alias("score_mean"),
        F.avg("flow_bonus").alias("bonus_mean"), F.avg(F.when(F.col("is_sweep"), 1.0).otherwise(0.0)).alias("sweep_share"),
    )


def trailing_baseline(tdays: DataFrame, days_back: int = 20, min_days: int = 3) -> DataFrame:
    """Mean and population deviation over the last days that have rows, per ticker day.

    The window runs over the days of one ticker.
    """
    w = Window.partitionBy("underlying").orderBy("day").rowsBetween(-days_back, -1)
    enough = F.col("base_days") >= min_days
    raw = tdays.withColumns({
        "base_days": F.count("volume").over(w),
        "_vm": F.avg("volume").over(w), "_vs": F.stddev_pop("volume").over(w),
        "_pm": F.avg("premium").over(w), "_ps": F.stddev_pop("premium").over(w),
    })
    return raw.withColumns({
        "vol_mean": F.when(enough, F.col("_vm")), "vol_std": F.when(enough, F.col("_vs")),
        "prem_mean": F.when(enough, F.col("_pm")), "prem_std": F.when(enough, F.col("_ps")),
    }).drop("_vm", "_vs", "_pm", "_ps")


def ticker_features(based: DataFrame) -> DataFrame:
    """Ratios of a ticker day; both ask-share definitions are kept under their own names."""
    change = F.col("oi") - F.col("prev_oi")
    ask, bid, mid = F.col("ask_volume"), F.col("bid_volume"), F.col("mid_volume")
    return based.withColumns({
        "oi_change": change,
        "oi_change_pct": ratio(change, "prev_oi") * 100.0,
        "vol_oi": ratio("volume", "oi"),
        "ask_share": ratio(ask, ask + bid),
        "ask_share_all": ratio(ask, ask + bid + mid),
        "prem_vs_base": ratio("premium", "prem_mean"),
        "rvol": ratio("volume", "vol_mean"),
    })


def latest_before(rows: DataFrame, keys: Sequence[str], ts: str, cutoff: Column, values: Sequence[str]) -> DataFrame:
    """Last row per key at or before the cutoff (no look-ahead)."""
    picked = F.max_by(F.struct(*values), F.col(ts)).alias("_r")
    return rows.where(F.col(ts) <= cutoff).groupBy(*keys).agg(picked).select(*keys, "_r.*")


def enrich(features: DataFrame, iv: DataFrame, earnings: DataFrame, flow: DataFrame) -> DataFrame:
    """Optional side data by ticker; a ticker without it keeps nulls."""
    out = (
        features.join(iv, "underlying", "left")
        .join(earnings, "underlying", "left")
        .join(flow, ["underlying", "day"], "left")
    )
    return out.withColumn("days_to_earnings", F.datediff("report_date", "day"))


def section_rank(df: DataFrame, keys: Sequence[str], name: str, value: str) -> DataFrame:
    """(row number - 1) / (n - 1) by value then ticker; one row ranks 0.5, nulls are left out."""
    rows = ranked(df.where(F.col(value).isNotNull()), keys, value, ["underlying"], out="_r", count_out="_n")
    pct = F.when(F.col("_n") > 1, (F.col("_r") - 1) / (F.col("_n") - 1)).otherwise(0.5)
    return rows.withColumn(name, pct).drop("_r", "_n")


def section_ranks(features: DataFrame, names: Sequence[str], keys: Sequence[str] = ("day",)) -> DataFrame:
    """Cross-sectional ranks of many features in long form (underlying, feature, pct)."""
    typed = features.select(*keys, "underlying", *[F.col(n).cast("double").alias(n) for n in names])
    long = typed.unpivot([*keys, "underlying"], list(names), "feature", "value")
    return section_rank(long, [*keys, "feature"], "pct", "value").select(*keys, "underlying", "feature", "pct")


def composite(features: DataFrame, names: Sequence[str] = SCORE_FEATURES, keys: Sequence[str] = ("day",),
              out: str = "score") -> DataFrame:
    """Mean of the ranks a ticker has, with their number."""
    return section_ranks(features, names, keys).groupBy(*keys, "underlying").agg(
        F.avg("pct").alias(out), F.count("pct").alias(f"{out}_n")
    )


def flag_summary(flags: DataFrame) -> DataFrame:
    """Contract flags to ticker level. An infinite relative volume does not count as a maximum."""
    finite = F.when(F.col("rvol") != float("inf"), F.col("rvol"))
    return flags.groupBy("underlying", "day").agg(
        F.count(F.lit(1)).alias("n_contracts"),
        F.sum("premium").alias("premium"), F.sum("volume").alias("volume"),
        F.sum("ask_volume").alias("ask"), F.sum("bid_volume").alias("bid"), F.sum("mid_volume").alias("mid"),
        F.coalesce(F.max(finite), F.lit(0.0)).alias("rvol_max"),
        F.count_if("flag_rvol").alias("n_flag_rvol"), F.count_if("flag_oi").alias("n_flag_oi"),
        F.coalesce(F.max(F.when(F.col("flag_oi"), F.abs("oi_change"))), F.lit(0.0)).alias("oi_max"),
        F.sum(F.abs("oi_change")).alias("oi_abs_sum"),
        F.max("prem_pctile").alias("pctile_max"),
    )


RANKINGS = {
    "rvol": ("n_flag_rvol", "rvol_max", "premium"),
    "oi": ("n_flag_oi", "oi_max", "premium"),
    "union": ("n_flags", "rvol_plus_oi", "premium"),
    "surprise": ("pctile_or_none", "premium"),
    "premium": ("premium",),
}


def ticker_rank(summary: DataFrame, which: str) -> DataFrame:
    """Tickers of a day in one named order, ties ending in the name.

    ``union`` adds relative volume and absolute OI change although their units
    differ; that is its definition.
    """
    rows = _with_orders(summary)
    first, *rest = RANKINGS[which]
    ties = [F.col(c).desc() for c in rest] + [F.col("underlying").asc()]
    return ranked(rows, ["day"], first, ties, descending=True, out="rank",
                  tie_chunk=-_prefix(rest[0]) if rest else None)


def ticker_ranks(summary: DataFrame, which: Sequence[str] = tuple(RANKINGS)) -> DataFrame:
    """(ranking, day, underlying, rank) of all named orders by one window over a long form.

    A section is the tickers of one day, so its size does not grow with the trades.
    """
    rows = _with_orders(summary)

    def order(name: str) -> Column:
        keys = [F.col(c).cast("double") for c in RANKINGS[name]] + [F.lit(0.0)] * 3
        return F.struct(F.lit(name).alias("ranking"), *[k.alias(f"_k{i}") for i, k in enumerate(keys[:3])])

    long = rows.select("day", "underlying", F.explode(F.array(*[order(x) for x in which])).alias("o")).select("day", "underlying", "o.*")
    section = Window.partitionBy("ranking", "day").orderBy(*[F.col(f"_k{i}").desc() for i in range(3)], "underlying")
    return long.select("ranking", "day", "underlying", F.row_number().over(section).alias("rank"))


def _with_orders(summary: DataFrame) -> DataFrame:
    return summary.withColumns({
        "n_flags": F.col("n_flag_rvol") + F.col("n_flag_oi"),
        "rvol_plus_oi": F.col("rvol_max") + F.col("oi_max"),
        "pctile_or_none": F.coalesce("pctile_max", F.lit(-1.0)),
    })


def captured(days: DataFrame, per_ticker: int = 15) -> DataFrame:
    """What a feed of the largest contracts sees: of every ticker and day the first by volume, then premium, then contract.

    A contract outside the list is absent on that day, not zero, so its history has gaps.
    """
    w = Window.partitionBy("underlying", "day").orderBy(F.col("volume").desc(), F.col("premium").desc(), "occ")
    return days.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_ticker).drop("_n")


def evaluate(ranks: DataFrame, truth: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Hits, precision and recall of the first k tickers of every ranking, per day.

    ``ranks``: track, ranking, day, underlying, rank. ``truth``: track, ranking, truth, day, underlying, the sets that
    each ranking is held against. Days without a truth set have no row; ``n`` is below k where fewer are ranked.
    """
    keys = ["track", "ranking", "truth", "day"]
    want = truth.select(*keys, "underlying").distinct()
    sizes = want.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_truth"))
    top = ranks.where(F.col("rank") <= max(ks)).join(sizes, ["track", "ranking", "day"])
    seen = top.join(want.withColumn("_hit", F.lit(1)), [*keys, "underlying"], "left")
    cut = seen.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") <= F.col("k"))
    out = cut.groupBy(*keys, "k", "n_truth").agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hits"))
    return out.withColumns({"precision": ratio("hits", "n"), "recall": ratio("hits", "n_truth")})


def _prefix(name: str) -> Column:
    from strikeloom.functions.ordered import order_prefix

    return order_prefix(F.col(name))


def ticker_surprise(tdays: DataFrame) -> DataFrame:
    """Premium of a ticker day against its own last days that had rows."""
    w = Window.partitionBy("underlying").orderBy("day").rowsBetween(-SURPRISE_DAYS, -1)
    return tdays.withColumn("_h", F.collect_list("premium").over(w)).withColumns({
        "prem_pctile": percentile_of_history("premium", "_h"), "baseline_days": F.size("_h"),
    }).drop("_h")


def precision_at(ranks: DataFrame, truth: DataFrame, ks: Sequence[int], keys: Sequence[str] = ("day",)) -> DataFrame:
    """Hits, precision and recall of the first k ranked tickers against a truth set per key."""
    want = truth.select(*keys, "underlying").distinct().withColumn("_t", F.lit(True))
    sizes = want.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_truth"))
    top = ranks.where(F.col("rank") <= max(ks)).join(want, [*keys, "underlying"], "left")
    aggs = []
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.count_if(inside).alias(f"n_{k}"), F.count_if(inside & F.col("_t")).alias(f"hits_{k}")]
    out = top.groupBy(*keys).agg(*aggs).join(sizes, list(keys), "left")
    spread = {}
    for k in ks:
        spread[f"precision_{k}"] = ratio(f"hits_{k}", f"n_{k}")
        spread[f"recall_{k}"] = ratio(f"hits_{k}", "n_truth")
    return out.withColumns(spread)


def set_precision(pred: DataFrame, truth: DataFrame, keys: Sequence[str], member: str) -> DataFrame:
    """Precision and recall of one membership set against another."""
    a = pred.select(*keys, member).distinct().withColumn("_p", F.lit(1))
    b = truth.select(*keys, member).distinct().withColumn("_q", F.lit(1))
    both = a.join(b, [*keys, member], "full").groupBy(*keys).agg(
        F.count("_p").alias("n_pred"), F.count("_q").alias("n_truth"),
        F.count_if(F.col("_p").isNotNull() & F.col("_q").isNotNull()).alias("hits"),
    )
    return both.withColumns({"precision": ratio("hits", "n_pred"), "recall": ratio("hits", "n_truth")})


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, min_n: int = 3) -> DataFrame:
    """Spearman and Pearson per group; below ``min_n`` pairs both are 0."""
    keys = list(keys)
    rows = average_rank(average_rank(df, keys, a, "_ra"), keys, b, "_rb")
    few = F.count(F.lit(1)) < min_n
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(few, 0.0).otherwise(F.coalesce(F.nanvl(F.corr("_ra", "_rb"), F.lit(0.0)), F.lit(0.0))).alias("spearman"),
        F.when(few, 0.0).otherwise(F.coalesce(F.nanvl(F.corr(a, b), F.lit(0.0)), F.lit(0.0))).alias("pearson"),
    )


def banded_rank(df: DataFrame, keys: Sequence[str], outer: str, inner: str, width: int = 5) -> DataFrame:
    """Order by ``outer``, then re-order by ``inner`` inside consecutive bands of ``width``."""
    keys = list(keys)
    rows = ranked(df, keys, outer, ["underlying"], descending=True, out="outer_rank")
    rows = rows.withColumn("_band", F.floor((F.col("outer_rank") - 1) / width))
    order = Window.partitionBy(*keys, "_band").orderBy(F.round(F.coalesce(F.col(inner), F.lit(-1.0)), 9).desc(), "outer_rank")
    return rows.withColumn("rank", F.col("_band") * width + F.row_number().over(order)).drop("_band")
