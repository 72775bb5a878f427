"""Tier rollups: five-minute buckets, hourly and end-of-day rows, bars, membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strikeloom.sources.captures import node_tier

SNAPSHOT_KEYS = ("ticker", "expiry", "strike")


def _at() -> Column:
    """Order of rows by time, then sequence (any non-negative long), as one number a hash aggregate can hold."""
    return F.expr("CAST(unix_micros(ts) AS DECIMAL(38,0)) * 10000000000000000000BD + seq")


def _first(c: str) -> Column:
    return F.min_by(c, _at())


def _last(c: str) -> Column:
    return F.max_by(c, _at())


def buckets(rows: DataFrame, width: str = "5 minutes") -> DataFrame:
    """One row per (ticker, expiry, strike, bucket). Volumes are the last value of the bucket."""
    return rows.groupBy(*SNAPSHOT_KEYS, F.window("ts", width).alias("w")).agg(
        _first("call_oi").alias("call_oi_first"), _last("call_oi").alias("call_oi_last"),
        _first("put_oi").alias("put_oi_first"), _last("put_oi").alias("put_oi_last"),
        _last("call_volume").alias("call_volume"), _last("put_volume").alias("put_volume"),
        F.avg("call_gamma").alias("call_gamma_avg"), F.avg("put_gamma").alias("put_gamma_avg"),
        F.avg("call_iv").alias("call_iv_avg"), F.avg("put_iv").alias("put_iv_avg"),
        _last("spot").alias("spot_close"), F.count(F.lit(1)).alias("samples"),
    ).select(*SNAPSHOT_KEYS, F.col("w.start").alias("bucket"), "call_oi_first", "call_oi_last", "put_oi_first", "put_oi_last", "call_volume",
             "put_volume", "call_gamma_avg", "put_gamma_avg", "call_iv_avg", "put_iv_avg", "spot_close", "samples")


def hourly(rows: DataFrame, schema_version: int = 1) -> DataFrame:
    out = rows.groupBy("ticker", "expiry", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.sum("call_gex").alias("call_gex"), F.sum("put_gex").alias("put_gex"),
        F.sum("call_vex").alias("call_vex"), F.sum("put_vex").alias("put_vex"),
        _first("spot").alias("spot_open"), _last("spot").alias("spot_close"))
    return out.withColumns({
        "net_gex": F.col("call_gex") - F.col("put_gex"), "net_vex": F.col("call_vex") - F.col("put_vex"),
        "schema_version": F.lit(schema_version).cast("bigint")})


def strike_eod(rows: DataFrame, schema_version: int = 1) -> DataFrame:
    cols = ("call_oi", "put_oi", "call_volume", "put_volume", "call_gex", "put_gex", "spot")
    out = rows.groupBy(*SNAPSHOT_KEYS, F.to_date("ts").alias("day")).agg(*[_last(c).alias(c) for c in cols])
    out = out.withColumnRenamed("spot", "spot_close")
    return out.withColumns({"net_gex": F.col("call_gex") - F.col("put_gex"), "schema_version": F.lit(schema_version).cast("bigint")})


def bars(ticks: DataFrame, width: str = "5 minutes") -> DataFrame:
    return ticks.groupBy("ticker", F.window("ts", width).alias("w")).agg(
        _first("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), _last("price").alias("close"),
        F.sum("size").alias("volume")).select("ticker", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume")


def contract_rollup(prints: DataFrame) -> DataFrame:
    return prints.groupBy("occ", "ticker", "right", "day").agg(
        F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trade_count"), F.sum("premium").alias("premium"),
        F.when(F.sum("size") > 0, F.sum(F.col("price") * F.col("size")) / F.sum("size")).alias("vwap"),
        F.sum(F.when(F.col("is_sweep"), F.col("size")).otherwise(0)).alias("sweep_volume"))


def underlying_rollup(contracts: DataFrame) -> DataFrame:
    def part(c, right):
        return F.sum(F.when(F.col("right") == right, F.col(c)).otherwise(0))

    return contracts.groupBy("ticker", "day").agg(
        part("premium", "C").alias("call_premium"), part("premium", "P").alias("put_premium"),
        part("volume", "C").alias("call_volume"), part("volume", "P").alias("put_volume"), F.countDistinct("occ").alias("contracts"))


def top_members(daily: DataFrame, days_back: int = 20, size: int = 200) -> DataFrame:
    """Members per month by trailing volume, then open interest, then name.

    A trading day counts for the next month start if it lies within the trailing
    days, so no rolling window is needed. The rank filter limits rows before the
    shuffle.
    """
    month = F.add_months(F.trunc("day", "month"), 1)
    used = daily.withColumn("month", month).where(F.col("day") >= F.date_sub("month", days_back))
    sums = used.groupBy("month", "ticker").agg(F.sum("volume").alias("volume"), F.sum("oi").alias("oi"))
    order = Window.partitionBy("month").orderBy(F.col("volume").desc(), F.col("oi").desc(), "ticker")
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def node_history(nodes: DataFrame, gatekeepers: int = 3) -> DataFrame:
    """Tier rows of each batch; normal nodes are not kept as history."""
    order = Window.partitionBy("ticker", "ts").orderBy(F.abs("v").desc(), "strike")
    ranked = nodes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 7 + gatekeepers)
    tier = node_tier(F.col("rank"), gatekeepers)
    return ranked.withColumn("tier", tier).withColumn("node", F.concat_ws("_", "tier", F.col("rank").cast("string")))


def freshness_alarm(newest: DataFrame, now: Column, payload_limit_s: float = 900.0, lag_limit_s: float = 1800.0) -> DataFrame:
    """Verdict from payload times: ``t0_ts`` newest raw time, ``t1_ts`` newest bucket time per source."""
    age = (F.unix_micros(now) - F.unix_micros("t0_ts")) / 1e6
    lag = (F.unix_micros("t0_ts") - F.unix_micros("t1_ts")) / 1e6
    return newest.withColumns({
        "age_s": age, "lag_s": lag,
        "verdict": F.when(age > payload_limit_s, "stale_payload").when(lag > lag_limit_s, "rollup_lag").otherwise("ok")})
