"""Row-level rules over whole tables: bases, freshness, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASES = ("net", "gross", "flip", "oi_size")


def basis(name: str) -> Column:
    """Within-cell value of a chain row under a named basis."""
    call_sign = F.when(F.col("call_ask_vol") > F.col("call_bid_vol"), 1.0).otherwise(-1.0)
    put_sign = F.when(F.col("put_ask_vol") > F.col("put_bid_vol"), 1.0).otherwise(-1.0)
    if name == "net":
        return F.col("call_gex") - F.col("put_gex")
    if name == "gross":
        return F.col("call_gex") + F.col("put_gex")
    if name == "flip":
        return call_sign * F.abs("call_gex") - put_sign * F.abs("put_gex")
    if name == "oi_size":
        call_size = F.col("call_volume") + 0.5 * F.col("call_oi")
        put_size = F.col("put_volume") + 0.5 * F.col("put_oi")
        return call_sign * call_size - put_sign * put_size
    raise ValueError(name)


def freshness(rows: DataFrame, keys: list[str], captured: str, expiry: str, oi: str, other_oi: DataFrame,
              offset_s: str, tol_s: float = 90.0) -> DataFrame:
    """Verdict per capture: stale when an expiry had already passed at capture time.

    ``other_oi`` holds the same-instant open interest per key with its time offset.
    """
    own = rows.groupBy(*keys).agg(
        F.count_if(F.col(expiry) < F.col(captured)).alias("n_expired"), F.sum(oi).alias("sum_oi")
    )
    both = own.join(other_oi, keys, "left")
    ratio = F.when(F.col("other_oi") > 0, F.try_divide(F.col("sum_oi"), F.col("other_oi")))
    return both.select(
        *keys, "n_expired", "sum_oi",
        F.when(F.col("n_expired") > 0, "stale").otherwise("fresh").alias("verdict"),
        ratio.alias("oi_ratio"),
        F.coalesce(F.abs(ratio - 1) > 0.20, F.lit(False)).alias("oi_off"),
        F.coalesce(F.abs(offset_s) <= tol_s, F.lit(False)).alias("usable"),
    )


def alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule hits: ``metric operator threshold`` for enabled rules; a null ticker means all."""
    live = rules.where("enabled").select("rule_id", "ticker", "metric", "op", "threshold")
    hit = (
        F.when(F.col("op") == ">", F.col("value") > F.col("threshold"))
        .when(F.col("op") == ">=", F.col("value") >= F.col("threshold"))
        .when(F.col("op") == "<", F.col("value") < F.col("threshold"))
        .when(F.col("op") == "<=", F.col("value") <= F.col("threshold"))
        .when(F.col("op") == "=", F.col("value") == F.col("threshold"))
    )
    # A rule of one ticker meets that ticker's rows only; rules for all tickers are joined apart.
    own = metrics.join(live.where("ticker is not null"), ["metric", "ticker"])
    every = metrics.join(live.where("ticker is null").drop("ticker"), "metric")
    return own.unionByName(every).where(hit)
