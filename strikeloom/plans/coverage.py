"""Coverage, cadence, alignment statistics, quantile rules and histograms."""

from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.functions.quantiles import exact_quantiles
from strikeloom.operators import asof
from strikeloom.plans.common import d, n, r, t
from strikeloom.plans.joins import aligned
from strikeloom.plans.registry import query


@query("agg_17_coverage", """
SELECT strftime(day, '%Y-%m-%d') AS day, ticker, count(*) AS rows_day, count(*) FILTER (hour(ts) * 3600 + minute(ts) * 60 + second(ts) >= 48600
  AND hour(ts) * 3600 + minute(ts) * 60 + second(ts) < 72000) AS rows_session, count(DISTINCT ts) AS n_snapshots,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM prints GROUP BY day, ticker""")
def coverage(spark, sf):
    c = asof.coverage(adapters.prints(spark, sf), ["day", "ticker"], "ts")
    return c.select(d("day").alias("day"), "ticker", "rows_day", "rows_session", "n_snapshots",
                    t("first_ts").alias("first_ts"), t("last_ts").alias("last_ts"))


_DAY_STATS = """
SELECT {keys}strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n_instants, count(match_ts) AS n_aligned,
  round(list_sort(list(dist_s) FILTER (match_ts IS NOT NULL))[CAST(count(match_ts) // 2 AS BIGINT) + 1], 5) AS dist_median,
  round(list_sort(list(dist_s) FILTER (match_ts IS NOT NULL))[CAST(floor(count(match_ts) * 0.9::DOUBLE) AS BIGINT) + 1], 5) AS dist_p90,
  round(max(dist_s) FILTER (match_ts IS NOT NULL), 5) AS dist_max, count(match_ts) > 0 AS usable FROM aligned GROUP BY {keys}CAST(ts AS DATE)"""


@query("agg_18_session_availability", _DAY_STATS.format(keys=""))
def availability(spark, sf):
    out = asof.aligned_days(aligned(spark, sf), F.to_date("ts"))
    return out.select(d("day").alias("day"), "n_instants", "n_aligned", *[r(c, 5).alias(c) for c in ("dist_median", "dist_p90", "dist_max")], "usable")


@query("agg_23_fit_set_distribution", _DAY_STATS.format(keys="ticker, "))
def fit_set(spark, sf):
    out = asof.aligned_days(aligned(spark, sf), F.to_date("ts"), ["ticker"])
    return out.select("ticker", d("day").alias("day"), "n_instants", "n_aligned",
                      *[r(c, 5).alias(c) for c in ("dist_median", "dist_p90", "dist_max")], "usable")


@query("win_14_cadence", """
SELECT ticker, count(*) AS n_snapshots, round(min(gap), 5) AS gap_min, round(list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1], 5) AS gap_median,
  round(max(gap), 5) AS gap_max FROM (SELECT ticker, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY ticker ORDER BY ts)) / 1e6::DOUBLE AS gap
  FROM (SELECT DISTINCT ticker, ts FROM prints)) GROUP BY ticker""")
def cadence(spark, sf):
    c = asof.cadence(adapters.prints(spark, sf), ["ticker"], "ts")
    return c.select("ticker", "n_snapshots", *[r(x, 5).alias(x) for x in ("gap_min", "gap_median", "gap_max")])


@query("agg_19_quantile_rules", """
SELECT ticker, count(*) AS n, list_sort(list(price))[CAST(floor(count(*) * 0.5::DOUBLE) AS BIGINT) + 1] AS p50_upper,
  list_sort(list(price))[least(CAST(floor(count(*) * 0.9::DOUBLE) AS BIGINT), count(*) - 1) + 1] AS p90_upper,
  list_sort(list(price))[CAST(round_even(0.25::DOUBLE * (count(*) - 1), 0) AS BIGINT) + 1] AS p25_nearest,
  list_sort(list(price))[CAST(floor(0.9::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS p90_lower, round(quantile_cont(price, 0.75), 6) AS p75_linear
FROM prints GROUP BY ticker""")
def quantile_rules(spark, sf):
    q = exact_quantiles(adapters.prints(spark, sf), ["ticker"], "price", {
        "p50_upper": (0.5, "upper"), "p90_upper": (0.9, "upper"), "p25_nearest": (0.25, "nearest"),
        "p90_lower": (0.9, "lower"), "p75_linear": (0.75, "linear")})
    return q.select("ticker", "n", "p50_upper", "p90_upper", "p25_nearest", "p90_lower", r("p75_linear").alias("p75_linear"))


@query("agg_20_bucketize", """
SELECT ticker, bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY ticker), 6) AS frac FROM (
  SELECT ticker, CASE WHEN premium <= 1.0 THEN '<=1.0' WHEN premium <= 5.0 THEN '<=5.0' WHEN premium <= 10.0 THEN '<=10.0' WHEN premium <= 50.0 THEN '<=50.0' ELSE '>50.0' END AS bucket
  FROM prints) GROUP BY ticker, bucket""")
def bucketize(spark, sf):
    return asof.bucketize(adapters.prints(spark, sf), ["ticker"], "premium", [1.0, 5.0, 10.0, 50.0]).select(
        "ticker", "bucket", "n", r("frac").alias("frac"))


@query("top_10_most_frequent_cell", """
SELECT strike, strftime(expiry, '%Y-%m-%d') AS expiry, n FROM (SELECT strike, expiry, count(*) AS n FROM chain_m GROUP BY ALL) ORDER BY n DESC, strike, expiry LIMIT 1""")
def most_frequent(spark, sf):
    c = adapters.chain(spark, sf).groupBy("strike", "expiry").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.col("n").desc(), "strike", "expiry").limit(1).select("strike", d("expiry").alias("expiry"), "n")


@query("src_12_completeness_audit", """
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, n AS held, n + (CASE WHEN day_of = 7 THEN 1 ELSE 0 END) AS expected, day_of <> 7 AS complete
FROM (SELECT ticker, day, count(*) AS n, dayofmonth(day) AS day_of FROM prints GROUP BY ticker, day)""")
def completeness(spark, sf):
    p = adapters.prints(spark, sf)
    short = F.when(F.dayofmonth("day") == 7, 1).otherwise(0)
    expected = p.groupBy("ticker", "day").agg((F.count(F.lit(1)) + F.max(short)).alias("expected"))
    return asof.completeness(p, expected, ["ticker", "day"]).select("ticker", d("day").alias("day"), "held", "expected", "complete")
