"""Contract-day and ticker-day rows, screens and baselines."""

from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.operators import asof, contracts, ranking
from strikeloom.plans.common import d, n, r
from strikeloom.plans.registry import query, view
from strikeloom.session import table


@query("agg_9_underlying_day", """
SELECT strftime(date, '%Y-%m-%d') AS date, ticker, round(sum(CASE WHEN cp = 'C' THEN total_premium ELSE 0 END), 3) AS call_premium,
  round(sum(CASE WHEN cp = 'P' THEN total_premium ELSE 0 END), 3) AS put_premium,
  CAST(sum(CASE WHEN cp = 'C' THEN total_volume ELSE 0 END) AS BIGINT) AS call_volume,
  CAST(sum(CASE WHEN cp = 'P' THEN total_volume ELSE 0 END) AS BIGINT) AS put_volume, count(*) FILTER (cp IS NULL) AS unknown_right,
  count(DISTINCT strike) AS unique_strikes, count(DISTINCT expiration) AS unique_expirations,
  round(sum(CASE WHEN cp = 'C' THEN total_premium ELSE 0 END) / nullif(sum(CASE WHEN cp = 'P' THEN total_premium ELSE 0 END), 0), 6) AS call_put_ratio
FROM (SELECT * REPLACE (CAST(last_tape_time AS DATE) AS date) FROM mapped) GROUP BY date, ticker""")
def underlying_day(spark, sf):
    raw = adapters.raw_contracts(spark, sf)
    u = contracts.underlying_day(contracts.map_rows(raw, F.to_date("last_tape_time")))
    return u.select(d("date").alias("date"), "ticker", r("call_premium", 3).alias("call_premium"),
                    r("put_premium", 3).alias("put_premium"), n("call_volume").alias("call_volume"),
                    n("put_volume").alias("put_volume"), "unknown_right", "unique_strikes", "unique_expirations",
                    r("call_put_ratio").alias("call_put_ratio"))


def _minute_bars(spark, sf):
    p = adapters.prints(spark, sf)
    return p.select("ticker", "occ", "expiry", "right", F.date_format("ts", "yyyy-MM-dd").alias("date"),
                    F.col("size").cast("double").alias("v"), F.lit(1.0).alias("n"),
                    F.when(F.col("size") % 10 == 0, 0.0).otherwise(F.col("price")).alias("c"))


view("minute_days", """
SELECT ticker, occ, expiry, cp, day, sum(v) AS volume, count(*)::DOUBLE AS trade_count, sum(v * c * 100) AS premium,
  CASE WHEN sum(v) > 0 THEN sum(v * CASE WHEN c > 0 THEN c ELSE 0 END) / sum(v) ELSE 0 END AS close_price
FROM (SELECT *, size::DOUBLE AS v, CASE WHEN size % 10 = 0 THEN 0.0::DOUBLE ELSE price END AS c FROM prints) GROUP BY ALL""")


@query("agg_10_bars_to_contract_day", """
SELECT ticker, occ, strftime(expiry, '%Y-%m-%d') AS expiry, cp AS "right", strftime(day, '%Y-%m-%d') AS date, volume, trade_count,
  round(premium, 3) AS premium, round(close_price, 6) AS close_price FROM minute_days""")
def bars_day(spark, sf):
    b = contracts.bars_to_contract_day(_minute_bars(spark, sf))
    return b.select("ticker", "occ", d("expiry").alias("expiry"), "right", "date", "volume", "trade_count",
                    r("premium", 3).alias("premium"), r("close_price").alias("close_price"))


@query("src_7_unified_contract_day", """
SELECT source, ticker, "right", date, count(*) AS n, round(sum(volume), 2) AS volume, round(sum(premium), 1) AS premium,
  count(bid) AS n_bid, count(oi) AS n_oi FROM (
  SELECT 'eod' AS source, ticker, cp AS "right", strftime(created, '%Y-%m-%d') AS date, volume, px * volume * 100 AS premium, bid, NULL AS oi FROM archive_px
  UNION ALL SELECT 'minute', ticker, cp, strftime(day, '%Y-%m-%d'), volume, premium, NULL, NULL FROM minute_days) GROUP BY ALL""")
def unified(spark, sf):
    both = contracts.unified(contracts.eod_to_contract_day(adapters.archive_rows(spark, sf)),
                             contracts.bars_to_contract_day(_minute_bars(spark, sf)))
    return both.groupBy("source", "ticker", "right", "date").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("volume"), 2).alias("volume"), r(F.sum("premium"), 1).alias("premium"),
        F.count("bid").alias("n_bid"), F.count("oi").alias("n_oi"))


_FLAGS = """
SELECT *, base_obs >= {obs} AND base_avg >= 100 AND rvol >= 2 AS flag_rvol, coalesce(hist_obs >= {obs} AND pctile >= 0.9, false) AS flag_surprise,
  abs(oi_change) >= 500 OR oi_change_pct >= 25 AS flag_oi FROM (
  SELECT c.*, h.base_obs, h.base_avg, h.hist_obs, h.pctile,
    CASE WHEN base_avg > 0 THEN volume / base_avg WHEN volume > 0 THEN CAST('Infinity' AS DOUBLE) ELSE 0.0::DOUBLE END AS rvol,
    (c.oi - c.prev_oi)::DOUBLE AS oi_change, CASE WHEN c.prev_oi <> 0 THEN abs(c.oi - c.prev_oi) / c.prev_oi::DOUBLE * 100
      WHEN c.oi <> c.prev_oi THEN CAST('Infinity' AS DOUBLE) ELSE 0.0::DOUBLE END AS oi_change_pct
  FROM {days} c JOIN (
    SELECT a.occ, a.day, count(b.occ) FILTER (a.rn - b.rn <= 10) AS base_obs,
      coalesce(avg(b.volume) FILTER (a.rn - b.rn <= 10), 0) AS base_avg, count(b.occ) AS hist_obs,
      (count(*) FILTER (b.premium < a.premium) + 0.5::DOUBLE * count(*) FILTER (b.premium = a.premium)) / nullif(count(b.occ), 0) AS pctile
    FROM {days} a LEFT JOIN {days} b ON a.occ = b.occ AND b.rn < a.rn AND a.rn - b.rn <= 20 GROUP BY a.occ, a.day, a.rn) h
  ON c.occ = h.occ AND c.day = h.day)"""
view("flags", _FLAGS.format(obs=5, days="cday_n"))
view("cday_n", "SELECT *, row_number() OVER (PARTITION BY occ ORDER BY day) AS rn FROM cday")
# Loose baselines over all contracts, and over those that a feed of the largest contracts sees.
view("flags_loose", _FLAGS.format(obs=3, days="cday_n"))
view("cday_c", """
SELECT * EXCLUDE (pick) FROM (SELECT *, row_number() OVER (PARTITION BY underlying, day ORDER BY volume DESC, premium DESC, occ) AS pick FROM cday) WHERE pick <= 15""")
view("cday_cn", "SELECT *, row_number() OVER (PARTITION BY occ ORDER BY day) AS rn FROM cday_c")
view("flags_c", _FLAGS.format(obs=3, days="cday_cn"))


@query("win_7_contract_rvol", """
SELECT occ, strftime(day, '%Y-%m-%d') AS day, volume, base_obs, round(base_avg, 6) AS base_avg,
  CASE WHEN isinf(rvol) THEN rvol ELSE round(rvol, 6) END AS rvol, flag_rvol FROM flags""")
def rvol(spark, sf):
    f = contracts.activity(adapters.contract_day(spark, sf))
    inf = float("inf")
    return f.select("occ", d("day").alias("day"), n("volume").alias("volume"), "base_obs", r("base_avg").alias("base_avg"),
                    F.when(F.col("rvol") == inf, inf).otherwise(r("rvol")).alias("rvol"), "flag_rvol")


@query("win_8_own_history_percentile", """
SELECT occ, strftime(day, '%Y-%m-%d') AS day, round(pctile, 6) AS prem_pctile, flag_surprise FROM flags""")
def percentile(spark, sf):
    f = contracts.activity(adapters.contract_day(spark, sf), with_oi=False)
    return f.select("occ", d("day").alias("day"), r("prem_pctile").alias("prem_pctile"), "flag_surprise")


@query("win_9_oi_change", """
SELECT occ, strftime(day, '%Y-%m-%d') AS day, oi_change, CASE WHEN isinf(oi_change_pct) THEN oi_change_pct ELSE round(oi_change_pct, 6) END AS oi_change_pct,
  flag_oi FROM flags""")
def oi_change(spark, sf):
    f = contracts.oi_flags(adapters.contract_day(spark, sf))
    inf = float("inf")
    return f.select("occ", d("day").alias("day"), "oi_change",
                    F.when(F.col("oi_change_pct") == inf, inf).otherwise(r("oi_change_pct")).alias("oi_change_pct"), "flag_oi")


@query("win_10_flags_on_last_day", """
SELECT occ, flag_rvol, flag_surprise, flag_oi, volume, round(premium, 4) AS premium FROM flags WHERE day = (SELECT max(day) FROM cday)""")
def last_day_flags(spark, sf):
    f = contracts.activity(adapters.contract_day(spark, sf))
    last = adapters.prints(spark, sf).agg(F.max("day").alias("day"))
    return f.join(F.broadcast(last), "day").select("occ", "flag_rvol", "flag_surprise", "flag_oi",
                                                   n("volume").alias("volume"), r("premium", 4).alias("premium"))


view("tday", """
SELECT underlying, day, count(*) AS contracts, CAST(sum(volume) AS BIGINT) AS volume, sum(premium) AS premium, CAST(sum(oi) AS BIGINT) AS oi,
  CAST(sum(prev_oi) AS BIGINT) AS prev_oi, CAST(sum(ask_volume) AS BIGINT) AS ask_volume, CAST(sum(bid_volume) AS BIGINT) AS bid_volume,
  CAST(sum(mid_volume) AS BIGINT) AS mid_volume, count(DISTINCT strike) AS n_strikes FROM cday GROUP BY underlying, day""")


@query("agg_11_ticker_day", """
SELECT underlying, strftime(day, '%Y-%m-%d') AS day, contracts, volume, round(premium, 4) AS premium, oi, prev_oi, ask_volume, bid_volume,
  mid_volume, n_strikes FROM tday""")
def ticker_day(spark, sf):
    t_ = ranking.ticker_day(adapters.contract_day(spark, sf))
    return t_.select("underlying", d("day").alias("day"), "contracts", n("volume").alias("volume"), r("premium", 4).alias("premium"),
                     n("oi").alias("oi"), n("prev_oi").alias("prev_oi"), n("ask_volume").alias("ask_volume"),
                     n("bid_volume").alias("bid_volume"), n("mid_volume").alias("mid_volume"), "n_strikes")


view("flow_day", """
SELECT underlying, day, count(*) AS n, sum(premium) AS flow_premium, avg(size / 10.0::DOUBLE) AS score_mean, avg((size % 7)::DOUBLE) AS bonus_mean,
  avg(CASE WHEN is_sweep THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS sweep_share FROM prints GROUP BY underlying, day""")


def flow_day(spark, sf):
    p = adapters.prints(spark, sf).withColumns({
        "flow_score": F.col("size") / 10.0, "flow_bonus": (F.col("size") % 7).cast("double")})
    return ranking.flow_score_day(p)


@query("agg_12_flow_score_day", """
SELECT underlying, strftime(day, '%Y-%m-%d') AS day, n, round(flow_premium, 4) AS premium, round(score_mean, 6) AS score_mean,
  round(bonus_mean, 6) AS bonus_mean, round(sweep_share, 6) AS sweep_share FROM flow_day""")
def flow_scores(spark, sf):
    return flow_day(spark, sf).select("underlying", d("day").alias("day"), "n", r("premium", 4).alias("premium"),
                                      r("score_mean").alias("score_mean"), r("bonus_mean").alias("bonus_mean"),
                                      r("sweep_share").alias("sweep_share"))


view("based", """
SELECT * EXCLUDE (vm, vs, pm, ps), CASE WHEN base_days >= 3 THEN vm END AS vol_mean, CASE WHEN base_days >= 3 THEN vs END AS vol_std,
  CASE WHEN base_days >= 3 THEN pm END AS prem_mean, CASE WHEN base_days >= 3 THEN ps END AS prem_std FROM (
  SELECT *, count(volume) OVER w AS base_days, avg(volume) OVER w AS vm, stddev_pop(volume) OVER w AS vs, avg(premium) OVER w AS pm,
    stddev_pop(premium) OVER w AS ps FROM tday WINDOW w AS (PARTITION BY underlying ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""")


def based(spark, sf):
    return ranking.trailing_baseline(ranking.ticker_day(adapters.contract_day(spark, sf)))


@query("agg_13_trailing_baseline", """
SELECT underlying, strftime(day, '%Y-%m-%d') AS day, base_days, round(vol_mean, 5) AS vol_mean, round(vol_std, 5) AS vol_std,
  round(prem_mean, 5) AS prem_mean, round(prem_std, 5) AS prem_std FROM based""")
def baseline(spark, sf):
    return based(spark, sf).select("underlying", d("day").alias("day"), "base_days",
                                   *[r(c, 5).alias(c) for c in ("vol_mean", "vol_std", "prem_mean", "prem_std")])


view("tfeat", """
SELECT *, oi - prev_oi AS oi_change, (oi - prev_oi) / nullif(prev_oi, 0)::DOUBLE * 100 AS oi_change_pct, volume / nullif(oi, 0)::DOUBLE AS vol_oi,
  ask_volume / nullif(ask_volume + bid_volume, 0)::DOUBLE AS ask_share,
  ask_volume / nullif(ask_volume + bid_volume + mid_volume, 0)::DOUBLE AS ask_share_all,
  premium / nullif(prem_mean, 0) AS prem_vs_base, volume / nullif(vol_mean, 0) AS rvol FROM based""")


def features(spark, sf):
    return ranking.ticker_features(based(spark, sf))


_RATIOS = ("oi_change_pct", "vol_oi", "ask_share", "ask_share_all", "prem_vs_base", "rvol")


@query("agg_14_ticker_features", f"""
SELECT underlying, strftime(day, '%Y-%m-%d') AS day, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _RATIOS)},
  date_diff('day', day, report_date) AS days_to_earnings FROM tfeat LEFT JOIN sectors USING (underlying)""")
def ticker_features(spark, sf):
    f = features(spark, sf).join(adapters.sectors(spark, sf).select("underlying", "report_date"), "underlying", "left")
    return f.select("underlying", d("day").alias("day"), *[r(c).alias(c) for c in _RATIOS],
                    n(F.datediff("report_date", "day")).alias("days_to_earnings"))


@query("jn_6_enrichment", """
SELECT underlying, strftime(day, '%Y-%m-%d') AS day, round(iv_atm, 6) AS iv_atm, sector, date_diff('day', day, report_date) AS days_to_earnings,
  round(score_mean, 6) AS score_mean, round(sweep_share, 6) AS sweep_share
FROM tfeat LEFT JOIN (SELECT underlying, arg_max(strike / 100.0, row(ts, seq)) AS iv_atm FROM prints WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY underlying) USING (underlying)
LEFT JOIN sectors USING (underlying) LEFT JOIN flow_day USING (underlying, day)""")
def enrichment(spark, sf):
    p = adapters.prints(spark, sf)
    iv_rows = p.select("underlying", F.struct("ts", "seq").alias("at"), (F.col("strike") / 100.0).alias("iv_atm"), "ts")
    iv = ranking.latest_before(iv_rows.drop("at"), ["underlying"], "ts", F.lit("2024-01-20").cast("timestamp"), ["iv_atm"])
    flow = flow_day(spark, sf).select("underlying", "day", "score_mean", "sweep_share")
    e = ranking.enrich(features(spark, sf), iv, adapters.sectors(spark, sf), flow)
    return e.select("underlying", d("day").alias("day"), r("iv_atm").alias("iv_atm"), "sector",
                    n("days_to_earnings").alias("days_to_earnings"), r("score_mean").alias("score_mean"),
                    r("sweep_share").alias("sweep_share"))


@query("jn_6_asof_enrichment", """
SELECT underlying, strftime(day, '%Y-%m-%d') AS day, round(iv_atm, 6) AS iv_atm, sector, date_diff('day', day, report_date) AS days_to_earnings,
  round(score_mean, 6) AS score_mean, round(sweep_share, 6) AS sweep_share
FROM tfeat LEFT JOIN (SELECT t.underlying, t.day, arg_max(p.strike / 100.0, row(p.ts, p.seq)) AS iv_atm FROM tfeat t
  JOIN prints p ON p.underlying = t.underlying AND p.ts < t.day + INTERVAL 1 DAY GROUP BY ALL) USING (underlying, day)
LEFT JOIN sectors USING (underlying) LEFT JOIN flow_day USING (underlying, day)""")
def asof_enrichment(spark, sf):
    """The latest volatility up to the end of each row's own day."""
    p = adapters.prints(spark, sf)
    last = p.groupBy("underlying", "ts").agg(F.max_by(F.col("strike") / 100.0, "seq").alias("iv_atm"))
    f = features(spark, sf)
    ends = f.select("underlying", "day", (F.date_add("day", 1).cast("timestamp") - F.expr("interval 1 microsecond")).alias("end"))
    iv = asof.last_before(ends, last, ["underlying"], "end", "ts", ["iv_atm"], "v", 86400).select("underlying", "day", "v.iv_atm")
    flow = flow_day(spark, sf).select("underlying", "day", "score_mean", "sweep_share")
    e = f.join(iv, ["underlying", "day"], "left").join(adapters.sectors(spark, sf), "underlying", "left").join(flow, ["underlying", "day"], "left")
    return e.select("underlying", d("day").alias("day"), r("iv_atm").alias("iv_atm"), "sector",
                    n(F.datediff("report_date", "day")).alias("days_to_earnings"), r("score_mean").alias("score_mean"),
                    r("sweep_share").alias("sweep_share"))


@query("win_12_dedup_max_volume", """
SELECT occ, strftime(day, '%Y-%m-%d') AS day, size AS volume, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY occ, day ORDER BY size DESC, seq) AS rn FROM prints) WHERE rn = 1""")
def dedup(spark, sf):
    p = adapters.prints(spark, sf).select("occ", "day", F.col("size").alias("volume"), "seq")
    out = contracts.dedup_max_volume(p, ["occ", "day"], ["seq"])
    return out.select("occ", d("day").alias("day"), "volume", "seq")


@query("win_15_ticker_percentile", """
SELECT a.underlying, strftime(a.day, '%Y-%m-%d') AS day, count(b.underlying) AS baseline_days,
  round((count(*) FILTER (b.premium < a.premium) + 0.5::DOUBLE * count(*) FILTER (b.premium = a.premium)) / nullif(count(b.underlying), 0), 6) AS prem_pctile
FROM tday_n a LEFT JOIN tday_n b ON a.underlying = b.underlying AND b.rn < a.rn AND a.rn - b.rn <= 20 GROUP BY a.underlying, a.day""")
def ticker_percentile(spark, sf):
    s = ranking.ticker_surprise(ranking.ticker_day(adapters.contract_day(spark, sf)))
    return s.select("underlying", d("day").alias("day"), n("baseline_days").alias("baseline_days"), r("prem_pctile").alias("prem_pctile"))


view("tday_n", "SELECT *, row_number() OVER (PARTITION BY underlying ORDER BY day) AS rn FROM tday")
