"""Sources and sinks, each fed by a table and checked after a round trip through files."""

from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.operators import ranking
from strikeloom.plans.common import d, m_cells, n, r, t
from strikeloom.plans.registry import query, view
from strikeloom.session import materialize, scratch_dir, table
from strikeloom.sources import archive, captures, commits, sinks


def _matrix(spark, sf):
    path = scratch_dir(spark, "matrix")
    captures.write_json_gz(captures.matrix_documents(m_cells(spark, sf)), path)
    return captures.read_matrix(spark, path)


def _day(c):
    return F.substring(c, 1, 10)


@query("src_1_matrix_capture_cells", """
SELECT ticker AS symbol, strftime(ts, '%Y-%m-%d') AS day, strike, strftime(expiry, '%Y-%m-%d') AS expiry, round(g, 4) + 0.0 AS value FROM cells_m WHERE g <> 0""")
def matrix_cells(spark, sf):
    return captures.matrix_cells(_matrix(spark, sf)).select("symbol", _day("asOf").alias("day"), "strike", "expiry", r("value", 4).alias("value"))


view("mrank", """
SELECT ticker, ts, strike, v, row_number() OVER (PARTITION BY ticker, ts ORDER BY abs(v) DESC, strike) AS rk
FROM (SELECT ticker, ts, strike, sum(g) AS v FROM cells_m GROUP BY ALL)""")
view("mtier", """
SELECT *, CASE WHEN rk = 1 THEN 'king' WHEN rk <= 4 THEN 'gatekeeper' WHEN rk <= 7 THEN 'pika' WHEN rk <= 10 THEN 'barney' ELSE 'normal' END AS node_type FROM mrank""")


@query("src_1_matrix_capture_strikes", """
SELECT ticker AS symbol, strftime(ts, '%Y-%m-%d') AS day, strike, round(v, 4) + 0.0 AS value, node_type FROM mtier""")
def matrix_strikes(spark, sf):
    return captures.matrix_strikes(_matrix(spark, sf)).select("symbol", _day("asOf").alias("day"), "strike", r("value", 4).alias("value"), "node_type")


view("rframes", """
SELECT f.ticker, f.ts, f.frame, f.frame % 2 AS axis, s.strike, coalesce(c.g, 0.0::DOUBLE) AS value FROM (
  SELECT ticker, ts, expiry, row_number() OVER (PARTITION BY ticker, ts ORDER BY expiry) - 1 AS frame FROM (SELECT DISTINCT ticker, ts, expiry FROM cells_m)) f
JOIN (SELECT DISTINCT ticker, ts, strike FROM cells_m) s ON f.ticker = s.ticker AND f.ts = s.ts AND (f.frame % 2 = 1 OR s.strike <= 25)
LEFT JOIN cells_m c ON c.ticker = f.ticker AND c.ts = f.ts AND c.expiry = f.expiry AND c.strike = s.strike""")


def range_frames(spark, sf, cells):
    path = scratch_dir(spark, "range")
    captures.write_json_gz(captures.range_documents(cells), path)
    return captures.read_range(spark, path)


@query("src_2_range_capture", """
SELECT ticker AS symbol, strftime(ts, '%Y-%m-%d') AS day, frame, axis, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM rframes
WHERE (ticker, ts, strike) IN (SELECT (ticker, ts, strike) FROM cells_m WHERE expiry = DATE '2002-01-15') GROUP BY ALL""")
def range_capture(spark, sf):
    cells = materialize(m_cells(spark, sf), "cells")
    front = cells.where("expiry = '2002-01-15'").select(
        F.col("ticker").alias("symbol"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("window_from"), "strike")
    frames = captures.on_grid(range_frames(spark, sf, cells), front, ["symbol", "window_from"])
    return frames.groupBy("symbol", _day("window_from").alias("day"), n("frame").alias("frame"), n("axis").alias("axis")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"))


@query("src_3_manifest", """
SELECT CASE WHEN size % 3 = 0 THEN side ELSE ticker END AS kind, strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM prints GROUP BY ALL""")
def manifest(spark, sf):
    p = adapters.prints(spark, sf)
    path = scratch_dir(spark, "manifest")
    p.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.when(F.col("size") % 3 == 0, F.col("side")).alias("metric"),
        F.concat(F.lit("raw/matrix/"), F.col("ticker"), F.lit("/"), d("day"), F.lit("/"), F.date_format("ts", "HHmmss"), F.lit(".json.gz")).alias("file"),
    ).write.json(path)
    return captures.read_manifest(spark, path).groupBy("kind", "day").agg(F.count(F.lit(1)).alias("n"))


_ARCHIVE = {"expiration": "date", "strike": "double", "right": "string", "created": "string", "volume": "double", "close": "double", "bid": "double"}


def _archive_root(spark, sf):
    """Two layouts side by side: whole-number strikes in early years, doubles later, no bids early."""
    rows = adapters.archive_rows(spark, sf).drop("occ", "ask", "count")
    root = scratch_dir(spark, "archive")
    early = rows.where("year < '1998'").withColumn("strike", F.col("strike").cast("bigint")).drop("bid")
    early.write.mode("append").partitionBy("ticker", "year").parquet(root)
    rows.where("year >= '1998'").write.mode("append").partitionBy("ticker", "year").parquet(root)
    return root


@query("src_4_archive_scan", """
SELECT ticker AS _ticker, yr AS _year, count(*) AS n, round(sum(strike), 2) AS strikes, round(sum(volume), 2) AS volume,
  count(CASE WHEN yr >= '1998' THEN bid END) AS n_bid FROM archive WHERE ticker IN ('A', 'N') GROUP BY ALL""")
def archive_scan(spark, sf):
    a = archive.scan(spark, _archive_root(spark, sf), _ARCHIVE, tickers=["a", "n"])
    return a.groupBy("_ticker", "_year").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("strike"), 2).alias("strikes"), r(F.sum("volume"), 2).alias("volume"), F.count("bid").alias("n_bid"))


@query("src_5_time_range", """
SELECT ticker AS _ticker, count(*) AS n, strftime(min(created), '%Y-%m-%d') AS lo, strftime(max(created), '%Y-%m-%d') AS hi FROM archive
WHERE created >= TIMESTAMP '1996-03-01' AND created < TIMESTAMP '1998-07-01' GROUP BY ALL""")
def time_range(spark, sf):
    a = archive.time_range(archive.scan(spark, _archive_root(spark, sf), _ARCHIVE), "1996-03-01", "1998-06-30")
    return a.groupBy("_ticker").agg(F.count(F.lit(1)).alias("n"), _day(F.min("created")).alias("lo"), _day(F.max("created")).alias("hi"))


@query("src_6_dataset_summary", """
SELECT count(*) AS rows, strftime(min(created), '%Y-%m-%dT%H:%M:%SZ') AS time_min, strftime(max(created), '%Y-%m-%dT%H:%M:%SZ') AS time_max,
  count(DISTINCT ticker) AS n_tickers, count(DISTINCT yr) AS n_years, array_to_string(list_sort(list_distinct(list(yr))), ',') AS years FROM archive""")
def dataset_summary(spark, sf):
    return archive.summary(archive.scan(spark, _archive_root(spark, sf), _ARCHIVE))


@query("src_8_session_partitions", """
SELECT strftime(day, '%Y-%m-%d') AS dt, count(*) AS n, CAST(sum(CASE WHEN day = (SELECT max(day) FROM cday) THEN 2 * volume ELSE volume END) AS BIGINT) AS volume
FROM cday GROUP BY day""")
def session_partitions(spark, sf):
    days = materialize(adapters.contract_day(spark, sf).select(d("day").alias("dt"), "occ", "volume"), "contract-days")
    path = scratch_dir(spark, "sessions")
    sinks.write_sessions(days, path, sort=("occ",))
    last = days.agg(F.max("dt").alias("dt"))
    again = days.join(F.broadcast(last), "dt").withColumn("volume", F.col("volume") * 2)
    sinks.write_sessions(again, path, sort=("occ",))
    return spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt")).agg(
        F.count(F.lit(1)).alias("n"), n(F.sum("volume")).alias("volume"))


@query("src_9_insert_only", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, CAST(sum(CASE WHEN day < DATE '2024-01-20' THEN volume ELSE volume + 1 END) AS BIGINT) AS volume
FROM cday GROUP BY day""")
def insert_only(spark, sf):
    days = materialize(adapters.contract_day(spark, sf).select("day", "occ", "volume"), "contract-days")
    path = scratch_dir(spark, "keyed")
    commits.append(days.where("day < '2024-01-20'"), path, ["day", "occ"])
    commits.append(days.withColumn("volume", F.col("volume") + 1), path, ["day", "occ"])
    return commits.read(spark, path, days.schema).groupBy(d("day").alias("day")).agg(F.count(F.lit(1)).alias("n"), n(F.sum("volume")).alias("volume"))


@query("src_10_pending_work", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM cday WHERE NOT (trades >= 3) GROUP BY day""")
def pending(spark, sf):
    days = materialize(adapters.contract_day(spark, sf), "contract-days")
    return sinks.pending(days, days.where("trades >= 3"), ["occ", "day"]).groupBy(d("day").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("src_11_result_sinks", """
SELECT underlying, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS n, (SELECT count(*) FROM tday) AS summary_rows FROM tday GROUP BY underlying""")
def result_sinks(spark, sf):
    t = materialize(ranking.ticker_day(adapters.contract_day(spark, sf)).select("underlying", d("day").alias("day"), "volume"), "ticker-days")
    csv, js = scratch_dir(spark, "csv"), scratch_dir(spark, "summary")
    sinks.write_csv_gz(t, csv)
    sinks.write_summary(t.agg(F.count(F.lit(1)).alias("summary_rows")), js)
    rows = spark.read.schema("underlying string, day string, volume bigint").option("header", "true").csv(csv)
    total = spark.read.schema("summary_rows bigint").json(js)
    return rows.groupBy("underlying").agg(n(F.sum("volume")).alias("volume"), F.count(F.lit(1)).alias("n")).join(F.broadcast(total))


def _exported(spark, sf):
    p = adapters.prints(spark, sf)
    path = scratch_dir(spark, "export")
    p.withColumn("dt", d("day")).drop("day").write.option("maxRecordsPerFile", 5_000_000).partitionBy("dt").parquet(path)
    written = spark.read.parquet(path).withColumn("day", F.col("dt").cast("date"))
    check = materialize(sinks.verify_export(p, written, "day", "ts"), "export-check")
    return p, check, sinks.export_manifest(spark, path, "T0", check, "day", r"dt=(\d{4}-\d\d-\d\d)")


@query("src_13_export_manifest", """
SELECT strftime(day, '%Y-%m-%d') AS day, 'T0' AS tier, count(*) AS row_count, true AS verified, 64 AS digest_length, count(*) AS source_rows,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts, true AS agrees FROM prints GROUP BY day""")
def export_manifest(spark, sf):
    _, check, m = _exported(spark, sf)
    files = m.groupBy(d("day").alias("day"), "tier").agg(
        n(F.sum("row_count")).alias("row_count"), F.min("verified").alias("verified"), F.min(F.length("sha256")).cast("int").alias("digest_length"))
    return files.join(check.select(d("day").alias("day"), "source_rows", t("exported_min").alias("first_ts"), t("exported_max").alias("last_ts"), "agrees"), "day")


@query("str_9_retention_candidates", """
SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS rows, count(*) AS exported FROM prints
WHERE day < (SELECT max(day) FROM prints) - 2 GROUP BY day""")
def retention(spark, sf):
    p, _, m = _exported(spark, sf)
    today = p.agg(F.max("day").alias("_today"))
    rows = p.join(F.broadcast(today))
    return sinks.retention_candidates(rows, materialize(m, "manifest"), "day", 2, F.col("_today")).select(
        d("day").alias("day"), "rows", n("exported").alias("exported"))


@query("agg_15_node_census", """
SELECT ticker AS symbol, node_type, count(*) AS n, count(*) FILTER (k = 1 OR k = n // 2 + 1 OR k = n) AS n_sampled FROM (
  SELECT t.*, c.k, c.n FROM mtier t JOIN (SELECT ticker, ts, row_number() OVER (PARTITION BY ticker, year(ts) ORDER BY ts) AS k,
    count(*) OVER (PARTITION BY ticker, year(ts)) AS n FROM batches_m) c USING (ticker, ts)) GROUP BY ALL""")
def census(spark, sf):
    symbols = _matrix(spark, sf).withColumn("year", F.substring("asOf", 1, 4))
    full = captures.node_census(captures.matrix_strikes(symbols), ["symbol"])
    some = captures.node_census(captures.matrix_strikes(captures.sample_captures(symbols, ["symbol", "year"])), ["symbol"])
    return full.join(some.withColumnRenamed("n", "n_sampled"), ["symbol", "node_type"], "left").fillna(0, ["n_sampled"])


@query("agg_15_axis_shapes", """
SELECT axis, n_strikes, n_frames, count(*) AS n FROM (SELECT ticker, ts, axis, count(DISTINCT strike) AS n_strikes, count(DISTINCT frame) AS n_frames FROM rframes GROUP BY ALL) GROUP BY ALL""")
def axis_shapes(spark, sf):
    frames = range_frames(spark, sf, m_cells(spark, sf))
    per = frames.groupBy("symbol", "window_from", n("axis").alias("axis")).agg(
        F.countDistinct("strike").alias("n_strikes"), F.countDistinct("frame").alias("n_frames"))
    return per.groupBy("axis", "n_strikes", "n_frames").agg(F.count(F.lit(1)).alias("n"))


@query("agg_15_lag_histogram", """
SELECT CAST(greatest(least(round_even(lag, 0), 3600), -3600) AS BIGINT) AS lag_s, count(*) AS n FROM (
  SELECT 3 * (epoch_us(ts) - epoch_us(date_trunc('hour', ts) + INTERVAL 30 MINUTE)) / 1e6::DOUBLE AS lag FROM prints) GROUP BY ALL""")
def lag_histogram(spark, sf):
    p = adapters.prints(spark, sf)
    half = (F.unix_timestamp(F.date_trunc("hour", "ts")) + 1800) * 1000000
    return captures.lag_histogram(p, (F.unix_micros("ts") - half) * 3 / F.lit(1e6))


@query("agg_16_capture_kings", """
SELECT ticker AS symbol, strftime(ts, '%Y-%m-%d') AS day, max(CASE WHEN rk = 1 THEN strike END) AS king, round(max(abs(v)), 4) AS king_abs, count(*) AS n_strikes,
  count(*) FILTER (node_type = 'gatekeeper') AS n_gatekeeper, count(*) FILTER (node_type = 'normal') AS n_normal FROM mtier GROUP BY ticker, ts""")
def capture_kings(spark, sf):
    return captures.capture_kings(_matrix(spark, sf)).select(
        "symbol", _day("asOf").alias("day"), "king", r("king_abs", 4).alias("king_abs"), "n_strikes", "n_gatekeeper", "n_normal")


@query("agg_16_column_kings", """
SELECT ticker AS symbol, strftime(ts, '%Y-%m-%d') AS day, strftime(expiry, '%Y-%m-%d') AS expiry, CASE WHEN max(abs(g)) > 0 THEN arg_max(strike, row(abs(g), -strike)) END AS strike,
  round(max(abs(g)), 4) AS value_abs FROM cells_m GROUP BY ticker, ts, expiry""")
def column_kings(spark, sf):
    return captures.column_kings(_matrix(spark, sf)).select(
        "symbol", _day("asOf").alias("day"), "expiry", "strike", r(F.abs("value"), 4).alias("value_abs"))


@query("fn_json_unwrap", """
SELECT kind, CAST(sum(n) AS BIGINT) AS rows, sum(CASE WHEN kind < 4 THEN n END) IS NOT NULL AS found, round(sum(v), 2) + 0.0 AS value FROM (
  SELECT o_orderkey % 6 AS kind, CASE WHEN o_orderkey % 6 < 4 THEN 2 ELSE 0 END AS n, CASE WHEN o_orderkey % 6 < 4 THEN 2 * o_custkey ELSE 0 END AS v FROM orders) GROUP BY kind""")
def json_unwrap(spark, sf):
    """Replies in six forms, four of which hold rows."""
    o = table(spark, sf, "orders")
    kind = F.col("o_orderkey") % 6
    rows = F.to_json(F.array(*[F.struct(F.col("o_orderpriority").alias("expires"), F.col("o_custkey").alias("v")) for _ in range(2)]))
    body = (F.when(kind == 0, rows).when(kind == 1, F.concat(F.lit('{"data": '), rows, F.lit("}"))).when(kind == 2, F.concat(F.lit('{"data": {"chains": '), rows, F.lit("}}")))
            .when(kind == 3, F.concat(F.lit('{"chains": '), rows, F.lit("}"))).when(kind == 4, F.lit('{"error": "no such ticker"}')).otherwise(F.lit("not json")))
    out = o.select(kind.alias("kind"), captures.unwrap_rows(body, "struct<expires: string, v: bigint>").alias("rows"))
    out = out.select("kind", F.size("rows").alias("n"), F.aggregate("rows", F.lit(0).cast("bigint"), lambda a, x: a + x["v"]).alias("v"))
    return out.groupBy("kind").agg(n(F.sum("n")).alias("rows"), (F.sum("n") > 0).alias("found"), r(F.sum("v"), 2).alias("value"))
