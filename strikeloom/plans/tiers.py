"""Tier rollups, membership, history and freshness."""

from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.operators import grid, tiers
from strikeloom.plans.common import d, m_cells, n, r, t, valued
from strikeloom.plans.registry import query, view
from strikeloom.session import materialize, scratch_dir, table

view("snapshots", """
SELECT ticker, expiry, strike, ts, seq, price AS spot, size * 10 + seq % 7 AS call_oi, 1000 - size AS put_oi, seq % 1000 AS call_volume, size AS put_volume, price / 1000 AS call_gamma,
  price / 2000 AS put_gamma, 0.1::DOUBLE + size / 200.0::DOUBLE AS call_iv, 0.2::DOUBLE + size / 200.0::DOUBLE AS put_iv, price * size AS call_gex, price * (100 - size) / 2 AS put_gex,
  price * 0.5 AS call_vex, price * 0.25 AS put_vex, size / 100.0::DOUBLE AS call_delta, size / 100.0::DOUBLE - 1 AS put_delta FROM prints""")
view("t1", """
SELECT ticker, expiry, strike, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, arg_min(call_oi, row(ts, seq)) AS call_oi_first, arg_max(call_oi, row(ts, seq)) AS call_oi_last,
  arg_min(put_oi, row(ts, seq)) AS put_oi_first, arg_max(put_oi, row(ts, seq)) AS put_oi_last, arg_max(call_volume, row(ts, seq)) AS call_volume, arg_max(put_volume, row(ts, seq)) AS put_volume,
  avg(call_gamma) AS call_gamma_avg, avg(put_gamma) AS put_gamma_avg, avg(call_iv) AS call_iv_avg, avg(put_iv) AS put_iv_avg, arg_max(spot, row(ts, seq)) AS spot_close, count(*) AS samples
FROM snapshots GROUP BY ALL""")
T1_SQL = """
SELECT ticker, strftime(expiry, '%Y-%m-%d') AS expiry, strike, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, call_oi_first, call_oi_last, put_oi_first, put_oi_last, call_volume, put_volume,
  round(call_gamma_avg, 8) AS call_gamma_avg, round(put_gamma_avg, 8) AS put_gamma_avg, round(call_iv_avg, 8) AS call_iv_avg, round(put_iv_avg, 8) AS put_iv_avg, spot_close, samples FROM t1"""


def t1_out(df):
    avgs = ("call_gamma_avg", "put_gamma_avg", "call_iv_avg", "put_iv_avg")
    return df.select("ticker", d("expiry").alias("expiry"), "strike", t("bucket").alias("bucket"), "call_oi_first", "call_oi_last", "put_oi_first",
                     "put_oi_last", "call_volume", "put_volume", *[r(c, 8).alias(c) for c in avgs], "spot_close", "samples")


@query("agg_24_five_minute_buckets", T1_SQL)
def five_minutes(spark, sf):
    return t1_out(tiers.buckets(adapters.snapshots(spark, sf)))


view("t2h", """
SELECT ticker, expiry, date_trunc('hour', ts) AS hour, sum(call_gex) AS call_gex, sum(put_gex) AS put_gex, sum(call_vex) AS call_vex, sum(put_vex) AS put_vex,
  arg_min(spot, row(ts, seq)) AS spot_open, arg_max(spot, row(ts, seq)) AS spot_close FROM snapshots GROUP BY ALL""")
HOUR_SQL = """
SELECT ticker, strftime(expiry, '%Y-%m-%d') AS expiry, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, round(call_gex, 4) AS call_gex, round(put_gex, 4) AS put_gex,
  round(call_gex - put_gex, 4) + 0.0 AS net_gex, round(call_vex - put_vex, 4) + 0.0 AS net_vex, spot_open, spot_close, {version} AS schema_version FROM t2h"""


def hour_out(df):
    return df.select("ticker", d("expiry").alias("expiry"), t("hour").alias("hour"), r("call_gex", 4).alias("call_gex"), r("put_gex", 4).alias("put_gex"),
                     r("net_gex", 4).alias("net_gex"), r("net_vex", 4).alias("net_vex"), "spot_open", "spot_close", "schema_version")


@query("agg_25_hourly_expiry", HOUR_SQL.format(version="1::BIGINT"))
def hourly(spark, sf):
    return hour_out(tiers.hourly(adapters.snapshots(spark, sf)))


@query("str_2_recomputed_rollup", HOUR_SQL.format(version="CASE WHEN hour >= TIMESTAMP '2024-01-20' THEN 2 ELSE 1 END::BIGINT"))
def recomputed(spark, sf):
    """Version 1 everywhere, then the later days replaced by version 2 through partition overwrite."""
    path = scratch_dir(spark, "hourly")
    rows = adapters.snapshots(spark, sf)
    for version, part in ((1, rows), (2, rows.where("ts >= '2024-01-20'"))):
        out = tiers.hourly(part, version).withColumn("day", F.to_date("hour"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return hour_out(spark.read.parquet(path))


@query("agg_26_strike_eod", """
SELECT ticker, strftime(expiry, '%Y-%m-%d') AS expiry, strike, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, arg_max(call_oi, row(ts, seq)) AS call_oi, arg_max(put_oi, row(ts, seq)) AS put_oi,
  arg_max(call_volume, row(ts, seq)) AS call_volume, round(arg_max(call_gex - put_gex, row(ts, seq)), 4) + 0.0 AS net_gex, arg_max(spot, row(ts, seq)) AS spot_close FROM snapshots GROUP BY ticker, expiry, strike, CAST(ts AS DATE)""")
def eod(spark, sf):
    return tiers.strike_eod(adapters.snapshots(spark, sf)).select(
        "ticker", d("expiry").alias("expiry"), "strike", d("day").alias("day"), "call_oi", "put_oi", "call_volume", r("net_gex", 4).alias("net_gex"), "spot_close")


@query("agg_27_spot_bars", """
SELECT ticker, strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS bucket, arg_min(price, row(ts, seq)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, row(ts, seq)) AS "close", CAST(sum(size) AS BIGINT) AS volume FROM prints GROUP BY ticker, time_bucket(INTERVAL 5 MINUTE, ts)""")
def spot_bars(spark, sf):
    return tiers.bars(adapters.spot_ticks(spark, sf)).select("ticker", t("bucket").alias("bucket"), "open", "high", "low", "close", n("volume").alias("volume"))


view("croll", """
SELECT occ, ticker, cp, day, CAST(sum(size) AS BIGINT) AS volume, count(*) AS trade_count, sum(premium) AS premium, CASE WHEN sum(size) > 0 THEN sum(price * size) / sum(size) END AS vwap,
  CAST(sum(CASE WHEN is_sweep THEN size ELSE 0 END) AS BIGINT) AS sweep_volume FROM prints GROUP BY ALL""")


@query("agg_28_print_rollup_contract", """
SELECT occ, ticker, cp AS "right", strftime(day, '%Y-%m-%d') AS day, volume, trade_count, round(premium, 4) AS premium, round(vwap, 6) AS vwap, sweep_volume FROM croll""")
def contract_rollup(spark, sf):
    return tiers.contract_rollup(adapters.prints(spark, sf)).select(
        "occ", "ticker", "right", d("day").alias("day"), n("volume").alias("volume"), "trade_count", r("premium", 4).alias("premium"), r("vwap").alias("vwap"), n("sweep_volume").alias("sweep_volume"))


@query("agg_28_print_rollup_underlying", """
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, round(sum(CASE WHEN cp = 'C' THEN premium ELSE 0 END), 4) AS call_premium, round(sum(CASE WHEN cp = 'P' THEN premium ELSE 0 END), 4) AS put_premium,
  CAST(sum(CASE WHEN cp = 'C' THEN volume ELSE 0 END) AS BIGINT) AS call_volume, CAST(sum(CASE WHEN cp = 'P' THEN volume ELSE 0 END) AS BIGINT) AS put_volume, count(DISTINCT occ) AS contracts FROM croll GROUP BY ticker, day""")
def underlying_rollup(spark, sf):
    return tiers.underlying_rollup(tiers.contract_rollup(adapters.prints(spark, sf))).select(
        "ticker", d("day").alias("day"), r("call_premium", 4).alias("call_premium"), r("put_premium", 4).alias("put_premium"),
        n("call_volume").alias("call_volume"), n("put_volume").alias("put_volume"), "contracts")


@query("top_11_top200_membership", """
SELECT strftime(month, '%Y-%m-%d') AS month, ticker, volume, round(oi, 2) AS oi, rank FROM (
  SELECT month, ticker, count(*) AS volume, sum(o_totalprice) AS oi, row_number() OVER (PARTITION BY month ORDER BY count(*) DESC, round(sum(o_totalprice), 2) DESC, ticker) AS rank FROM (
    SELECT 'C' || o_custkey AS ticker, o_totalprice, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS month FROM orders)
  WHERE day >= month - 20 GROUP BY month, ticker) WHERE rank <= 200""")
def membership(spark, sf):
    o = table(spark, sf, "orders")
    daily = o.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("volume"), F.sum("o_totalprice").alias("oi"))
    return tiers.top_members(daily).select(d("month").alias("month"), "ticker", "volume", r("oi", 2).alias("oi"), n("rank").alias("rank"))


@query("top_13_node_history", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, node_type || '_' || rk AS node, node_type AS tier, strike, round(v, 4) + 0.0 AS value FROM mtier WHERE rk <= 10""")
def node_history(spark, sf):
    nodes = m_cells(spark, sf).groupBy("ticker", "ts", "strike").agg(F.sum("g").alias("v"))
    return tiers.node_history(nodes).select("ticker", d("ts").alias("ts"), "node", "tier", "strike", r("v", 4).alias("value"))


@query("str_6_freshness_alarms", """
SELECT ticker, round(age_s, 5) AS age_s, round(lag_s, 5) AS lag_s, CASE WHEN age_s > 900 THEN 'stale_payload' WHEN lag_s > 1800 THEN 'rollup_lag' ELSE 'ok' END AS verdict FROM (
  SELECT ticker, (epoch_us((SELECT max(ts) FROM prints)) - epoch_us(max(ts))) / 1e6::DOUBLE AS age_s, (epoch_us(max(ts)) - epoch_us(max(CASE WHEN side <> 'mid' THEN time_bucket(INTERVAL 5 MINUTE, ts) END))) / 1e6::DOUBLE AS lag_s FROM prints GROUP BY ticker)""")
def freshness(spark, sf):
    p = adapters.prints(spark, sf)
    newest = p.groupBy("ticker").agg(F.max("ts").alias("t0_ts"), F.max(F.when(F.col("side") != "mid", F.window("ts", "5 minutes")["start"])).alias("t1_ts"))
    now = p.agg(F.max("ts").alias("now"))
    out = tiers.freshness_alarm(newest.join(F.broadcast(now)), F.col("now"))
    return out.select("ticker", r("age_s", 5).alias("age_s"), r("lag_s", 5).alias("lag_s"), "verdict")
