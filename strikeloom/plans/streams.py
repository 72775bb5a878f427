"""Streaming jobs run to the end of their source and compared with the batch meaning."""

from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.operators import flow
from strikeloom.plans.common import DAY_S, MONTH_GAP_S, d, n, r, t
from strikeloom.plans.registry import query, view
from strikeloom.plans.rows import alert_rules
from strikeloom.plans.tiers import HOUR_SQL, T1_SQL, hour_out, t1_out
from strikeloom.session import scratch_dir, table
from strikeloom.streaming import chains, freshness, jobs
from strikeloom.streaming.rollup import HourlyRollup


def events_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return jobs.file_stream(spark, sf, schema, "events.parquet")


def events_to_end(spark, sf):
    """The events stream with a folder for its end mark, and that folder."""
    schema = table(spark, sf, "events").schema
    ends = jobs.new_folder(spark, "end")
    return events_stream(spark, sf).union(jobs.file_stream(spark, ends, schema)), ends, schema


@query("str_1_bucket_stream", T1_SQL)
def bucket_stream(spark, sf):
    """Every row comes twice; the windows open when the source ends are emitted too."""
    rows, ends, schema = events_to_end(spark, sf)
    twice = rows.union(events_stream(spark, sf))
    out, _ = jobs.run_to_end(jobs.bucket_stream(adapters.snapshots(spark, sf, twice)), "buckets", ends, schema)
    return t1_out(out)


@query("str_2_stream_rollup", HOUR_SQL.format(version="CASE WHEN hour >= TIMESTAMP '2024-01-20' THEN 2 ELSE 1 END::BIGINT"))
def rollup_stream(spark, sf):
    """Version 1 of all hours in several micro-batches, then version 2 of the later ones from a stream of its own."""
    rows = adapters.snapshots(spark, sf)
    kept, hours = scratch_dir(spark, "kept"), scratch_dir(spark, "hours")
    for version, part in ((1, rows), (2, rows.where("ts >= '2024-01-20'"))):
        source = scratch_dir(spark, "snapshots")
        files = jobs.land(part, source, "ts", 2, FILES)
        stream = jobs.file_stream(spark, source, rows.schema, files_per_trigger=files)
        q = (stream.writeStream.foreachBatch(HourlyRollup(kept, hours, version)).option("checkpointLocation", scratch_dir(spark, "hours-checkpoint"))
             .trigger(availableNow=True).start())
        q.awaitTermination()
    return hour_out(spark.read.parquet(hours))


#: Files that a landing writes at once and a trigger takes at once, at least.
FILES = 4
#: How long rows of a batch may come after rows of a later one.
DELAY = "1 day"


def raw_chain(spark, sf, pieces: int = 3):
    """Monthly chain rows landed in time order, batches cut across landings: the stream, its folder and schema."""
    rows = adapters.chain(spark, sf, "month")
    path = scratch_dir(spark, "chain")
    files = jobs.land(rows, path, "ts", pieces, FILES)
    return jobs.file_stream(spark, path, rows.schema, files_per_trigger=files), path, rows.schema


@query("str_3_weight_stream", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, CAST(sign(a) AS BIGINT) AS a_sign, round(ln(1 + abs(a)), 6) AS log_a FROM weights_m""")
def weight_stream(spark, sf):
    """From raw rows: batches close by the watermark, a clock per ticker follows, then the weight of each expiry."""
    stream, path, schema = raw_chain(spark, sf)
    out, _ = jobs.run_to_end(chains.weights(stream, DELAY, MONTH_GAP_S), "weights", path, schema)
    return out.select("ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), n(F.signum("a")).alias("a_sign"), r(F.log1p(F.abs("a"))).alias("log_a"))


@query("str_5_late_rows", """
SELECT count(*) AS rows_in, count(*) FILTER (late) AS late, count(*) FILTER (NOT late) AS kept FROM (
  SELECT row_a % 7 = 0 AND ts <= (SELECT max(ts) FROM chain_m WHERE row_a % 7 > 1) - INTERVAL 400 DAY AS late FROM chain_m)""")
def late_rows(spark, sf):
    """Every seventh order lands after all others: its rows for batches that are closed by then are late, and counted.

    A trigger closes batches by what earlier triggers have seen, and what comes after that trigger is late: hence three landings.
    """
    rows = adapters.chain(spark, sf, "month")
    path = scratch_dir(spark, "chain")
    files = jobs.files_of(rows.count(), FILES)
    for part in ("row_a % 7 > 1", "row_a % 7 = 1", "row_a % 7 = 0"):
        rows.where(part).repartition(files).write.mode("append").parquet(path)
    stream = jobs.file_stream(spark, path, rows.schema, files_per_trigger=files)
    out, progress = jobs.run_to_end(chains.closed_counts(stream, "400 days"), "closed", path, rows.schema)
    total = jobs.rows_in(progress)
    return out.agg(F.lit(total).cast("bigint").alias("rows_in"), (F.lit(total) - F.sum("n_rows")).alias("late"), F.sum("n_rows").alias("kept"))


view("beat", """
SELECT ticker, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 0 ELSE 1 END AS part, max(ts) AS ts FROM prints
WHERE ts < TIMESTAMP '2024-01-15' OR ticker <> (SELECT min(ticker) FROM prints) GROUP BY ALL""")


@query("str_6_silence_stream", """
SELECT ticker AS source, 'silent' AS event, strftime(ts, '%Y-%m-%d %H:%M:%S') AS payload_ts FROM beat
UNION ALL SELECT ticker, 'recovered', strftime(ts, '%Y-%m-%d %H:%M:%S') FROM beat WHERE part = 1""")
def silence_stream(spark, sf):
    """Sources fall silent, some recover and fall silent again; timers say so without any input. The limit is 3 s here."""
    p = adapters.prints(spark, sf)
    first = p.agg(F.min("ticker")).first()[0]
    beats = [x.groupBy(F.col("ticker").alias("source"), F.lit("t0").alias("tier")).agg(F.max("ts").alias("payload_ts"))
             for x in (p.where("ts < '2024-01-15'"), p.where((F.col("ts") >= "2024-01-15") & (F.col("ticker") != first)))]
    wanted = [x.count() for x in beats]
    path, sink = jobs.new_folder(spark, "beats"), scratch_dir(spark, "alarms")
    q = jobs.start(freshness.alarms(jobs.file_stream(spark, path, freshness.HEARTBEAT), 3.0), sink, scratch_dir(spark, "alarms-checkpoint"), processingTime="500 milliseconds")
    out = spark.read.schema(freshness.ALARM)
    try:
        for k, beat in enumerate(beats):
            beat.coalesce(1).write.mode("append").parquet(path)  # a row per source
            jobs.wait_for(q, lambda: out.parquet(sink).where("event = 'silent'").count() >= sum(wanted[:k + 1]))
    finally:
        q.stop()
    return out.parquet(sink).select("source", "event", t("payload_ts").alias("payload_ts"))


view("qstep_m", """
SELECT c.*, call_oi - call_prev_oi + put_oi - put_prev_oi AS f, row_number() OVER (PARTITION BY c.ticker, c.strike, c.expiry ORDER BY c.ts) - 1 AS k,
  coalesce(greatest(date_diff('second', b.prev_ts, c.ts), 1), 2592000) / 2592000.0::DOUBLE * ln(0.99::DOUBLE) AS lnl FROM cells_m c JOIN batches_m b USING (ticker, ts)""")
view("qcum_m", "SELECT *, sum(CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE lnl END) OVER (PARTITION BY ticker, strike, expiry ORDER BY ts) AS cum FROM qstep_m")
view("touch_m", """
SELECT *, CAST(sum(now::INT) OVER w AS BIGINT) AS n_tch, CAST(sum(crossed::INT) OVER w AS BIGINT) AS n_del, CAST(sum((bef AND NOT now AND NOT crossed)::INT) OVER w AS BIGINT) AS n_rej FROM (
  SELECT b.ticker, b.ts, b.strike, coalesce(abs(p.spot - strike) <= band AND p.ps IS NOT NULL, false) AS now, coalesce(abs(p.ps - strike) <= band, false) AS bef,
    coalesce((p.ps - strike) * (p.spot - strike) < 0, false) AS crossed
  FROM (SELECT *, coalesce(least(strike - lag(strike) OVER w, lead(strike) OVER w - strike) / 2, 2.5) AS band FROM (SELECT DISTINCT ticker, ts, strike FROM cells_m) WINDOW w AS (PARTITION BY ticker, ts ORDER BY strike)) b
  JOIN (SELECT ticker, ts, spot, lag(spot) OVER (PARTITION BY ticker ORDER BY ts) AS ps FROM batches_m) p USING (ticker, ts)) WINDOW w AS (PARTITION BY ticker, strike ORDER BY ts)""")


@query("str_4_node_stream", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strike, strftime(expiry, '%Y-%m-%d') AS expiry, round(q_g, 3) + 0.0 AS q_g, round(q_f, 3) + 0.0 AS q_f, n_tch, n_del, n_rej FROM (
  SELECT s.ticker, s.ts, s.strike, s.expiry, sum(q.g * CASE WHEN q.k = 0 THEN 1 ELSE 1 - exp(q.lnl) END * exp(s.cum - q.cum)) AS q_g,
    sum(q.f * CASE WHEN q.k = 0 THEN 1 ELSE 1 - exp(q.lnl) END * exp(s.cum - q.cum)) AS q_f
  FROM qcum_m s JOIN qcum_m q ON s.ticker = q.ticker AND s.strike = q.strike AND s.expiry = q.expiry AND q.k <= s.k GROUP BY s.ticker, s.ts, s.strike, s.expiry) JOIN touch_m USING (ticker, ts, strike)""")
def node_stream(spark, sf):
    """From raw rows: cells of closed batches, bands and spots from the ticker's clock, state of each strike."""
    stream, path, schema = raw_chain(spark, sf)
    out, _ = jobs.run_to_end(chains.node_state(stream, DELAY, 0.99, 30 * DAY_S), "nodes", path, schema)
    return out.select("ticker", d("ts").alias("ts"), "strike", d("expiry").alias("expiry"), r("q_g", 3).alias("q_g"), r("q_f", 3).alias("q_f"), "n_tch", "n_del", "n_rej")


@query("str_4_range_stream", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, round(max(gmag) OVER w, 4) AS ceil, round(min(gmag) OVER w, 4) AS floor FROM cols_m
WINDOW w AS (PARTITION BY ticker, expiry, date_trunc('year', ts) ORDER BY ts)""")
def range_stream(spark, sf):
    stream, path, schema = raw_chain(spark, sf)
    out, _ = jobs.run_to_end(chains.ranges(stream, DELAY, F.date_trunc("year", "ts")), "ranges", path, schema)
    return out.select("ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), r("ceil", 4).alias("ceil"), r("floor", 4).alias("floor"))


@query("str_5_stale_rows_dropped", """
SELECT count(*) AS rows_in, count(*) FILTER (size * 10 > 482) AS dropped, count(*) FILTER (size * 10 <= 482) AS kept FROM prints""")
def stale_rows(spark, sf):
    p = adapters.prints_of(events_stream(spark, sf))
    marked = jobs.mark_stale(p, F.col("size") * 10 > 482).select("seq", "ts", "stale")
    return jobs.stale_counts(jobs.collected(marked, "kept"))


@query("str_7_alert_stream", """
SELECT r.rule_id::BIGINT AS rule_id, strftime(m.ts, '%Y-%m-%d %H:%M:%S') AS ts, m.ticker, round(m.value, 4) AS value FROM (
  SELECT ticker, ts, 'premium' AS metric, premium * 20 AS value FROM prints) m JOIN alert_rules r ON m.metric = r.metric AND (r.ticker IS NULL OR r.ticker = m.ticker)
WHERE r.enabled AND CASE r.op WHEN '>' THEN m.value > r.threshold WHEN '<=' THEN m.value <= r.threshold ELSE m.value >= r.threshold END""")
def alert_stream(spark, sf):
    p = adapters.prints_of(events_stream(spark, sf))
    metrics = p.select("ticker", "ts", F.lit("premium").alias("metric"), (F.col("premium") * 20).alias("value"))
    out = jobs.collected(jobs.alert_stream(metrics, alert_rules(spark, sf)), "alerts")
    return out.select(n("rule_id").alias("rule_id"), t("ts").alias("ts"), "ticker", r("value", 4).alias("value"))


view("sweep_ids", """
SELECT *, sum(brk) OVER (PARTITION BY occ ORDER BY ts, seq) AS sid FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY occ ORDER BY ts, seq) <= 600000000 THEN 0 ELSE 1 END AS brk FROM prints)""")
view("sweeps", "SELECT occ, sid, count(*) AS n, CAST(sum(size) AS BIGINT) AS size, sum(premium) AS premium, min(ts) AS first_ts, max(ts) AS last_ts FROM sweep_ids GROUP BY ALL")
_SWEEP = "SELECT occ, n, size, round(premium, 4) AS premium, strftime(first_ts, '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(last_ts, '%Y-%m-%d %H:%M:%S') AS last_ts FROM sweeps"


def _sweep_out(df):
    return df.select("occ", "n", n("size").alias("size"), r("premium", 4).alias("premium"), t("first_ts").alias("first_ts"), t("last_ts").alias("last_ts"))


@query("str_8_sweeps", _SWEEP)
def sweeps(spark, sf):
    return _sweep_out(flow.sweeps(adapters.prints(spark, sf), 600.0))


@query("str_8_sweep_stream", _SWEEP)
def sweep_stream(spark, sf):
    rows, ends, schema = events_to_end(spark, sf)
    out, _ = jobs.run_to_end(jobs.sweep_stream(adapters.prints_of(rows), "10 minutes"), "sweeps", ends, schema)
    return _sweep_out(out)


@query("src_10_incremental_stream", "SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n FROM prints GROUP BY day")
def incremental(spark, sf):
    """Two runs of one query over a growing folder; the checkpoint keeps loaded files from loading again."""
    p = adapters.prints(spark, sf).select("seq", "ts", "day")
    src, sink, check = (scratch_dir(spark, x) for x in ("incoming", "loaded", "loaded-checkpoint"))
    for part in (p.where("day < '2024-01-15'"), p.where("day >= '2024-01-15'")):
        part.write.mode("append").parquet(src)
        q = (jobs.file_stream(spark, src, p.schema).writeStream.format("parquet").option("path", sink)
             .option("checkpointLocation", check).trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(p.schema).parquet(sink).groupBy(d("day").alias("day")).agg(F.count(F.lit(1)).alias("n"))
