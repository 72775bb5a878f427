"""Row hygiene, projections and predicates."""

from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.functions import scalar as S
from strikeloom.operators import contracts, grid, rows
from strikeloom.plans.common import d, n, r, t
from strikeloom.plans.registry import query, view
from strikeloom.session import table


@query("prj_1_parse_times", """
SELECT event_id, CAST(CASE WHEN event_id % 4 = 3 THEN epoch_us(ts) // 1000000 * 1000000 ELSE epoch_us(ts) END AS BIGINT) AS micros
FROM events""")
def parse_times(spark, sf):
    ev = table(spark, sf, "events")
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.date_format("ts", iso), F.lit("Z")))
        .when(F.col("event_id") % 4 == 1,
              F.concat(F.date_format(F.timestamp_micros(F.unix_micros("ts") + 7200 * 1000000), iso), F.lit("+02:00")))
        .when(F.col("event_id") % 4 == 2, F.date_format("ts", iso))
        .otherwise(F.unix_timestamp("ts").cast("string"))
    )
    return ev.select("event_id", F.unix_micros(S.parse_ts(text)).alias("micros"))


@query("prj_2_coerce_numbers", """
SELECT l_linenumber AS line, count(*) AS n, round(sum(coalesce(TRY_CAST(CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'n/a'
  ELSE l_extendedprice::VARCHAR END AS DOUBLE), 0)), 2) AS total FROM lineitem GROUP BY ALL""")
def coerce(spark, sf):
    li = table(spark, sf, "lineitem")
    text = F.when(F.col("l_orderkey") % 4 == 0, F.lit(None).cast("string")).when(
        F.col("l_orderkey") % 4 == 1, "n/a").otherwise(F.col("l_extendedprice").cast("string"))
    return li.groupBy(F.col("l_linenumber").alias("line")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum(S.num(text)), 2).alias("total"))


view("raw_chain", """
SELECT l_returnflag AS ticker, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts,
  CASE WHEN l_partkey % 101 = 0 OR l_partkey % 103 = 0 THEN NULL ELSE l_quantity END AS strike,
  CASE WHEN l_suppkey % 53 <> 0 THEN make_date(2002, l_linenumber, 15) END AS expiry,
  CASE WHEN l_orderkey % 7 = 0 OR l_orderkey % 11 = 0 THEN NULL ELSE l_partkey % 600 END AS lag_s,
  CASE WHEN l_orderkey % 5 = 0 THEN 0.0::DOUBLE ELSE l_extendedprice END AS call_gex,
  CASE WHEN l_partkey % 13 <> 0 THEN l_quantity + 100 END AS spot_price FROM lineitem""")
view("raw_kept", """
SELECT *, NOT (coalesce(lag_s > 482, false) OR strike IS NULL OR expiry IS NULL) AS keep FROM raw_chain""")


def _normalized(spark, sf):
    raw = adapters.raw_chain(spark, sf).withColumn("fetched_at", S.parse_ts("fetched_text"))
    return grid.normalize(raw, ["call_gex"])


@query("prj_5_normalize_batch", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, count(*) FILTER (keep) AS n_rows, count(*) FILTER (NOT keep) AS n_dropped,
  round(coalesce(sum(call_gex) FILTER (keep), 0), 2) AS kept_gex FROM raw_kept GROUP BY ALL""")
def normalize(spark, sf):
    return _normalized(spark, sf).groupBy("ticker", d("ts").alias("ts")).agg(
        F.count_if("keep").alias("n_rows"), F.count_if(~F.col("keep")).alias("n_dropped"),
        r(F.coalesce(F.sum(F.when(F.col("keep"), F.col("call_gex"))), F.lit(0.0)), 2).alias("kept_gex"))


@query("prj_6_batch_spot", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, nullif(list_sort(list(spot_price))[count(*) // 2 + 1], 0) AS spot
FROM raw_kept WHERE keep AND spot_price IS NOT NULL GROUP BY ticker, ts""")
def batch_spot(spark, sf):
    return grid.upper_median_spot(_normalized(spark, sf).where("keep")).select("ticker", d("ts").alias("ts"), "spot")


@query("prj_7_stale_capture", """
SELECT o_orderkey, (o_orderkey % 86400) % 5 > 2 AS stale FROM orders""")
def stale(spark, sf):
    o = table(spark, sf, "orders")
    sec = F.unix_timestamp("o_orderdate") + F.col("o_orderkey") % 86400
    as_of = F.timestamp_seconds(sec)
    start = F.timestamp_seconds(sec - F.col("o_orderkey") % 86400 % 5)
    return o.select("o_orderkey", S.is_stale_capture(
        as_of, F.date_format(start, "yyyy-MM-dd"), F.date_format(start, "HHmmss")).alias("stale"))


@query("prj_8_contract_key", """
SELECT upper(replace(replace(lower(l_returnflag) || '__' || l_partkey || ' ' || l_linenumber, '_', ''), ' ', '')) AS occ, count(*) AS n
FROM lineitem GROUP BY ALL""")
def contract_key(spark, sf):
    return adapters.raw_contracts(spark, sf).groupBy(S.contract_key("option_symbol").alias("occ")).agg(
        F.count(F.lit(1)).alias("n"))


@query("prj_9_contract_id", """
SELECT l_returnflag || '02' || lpad(l_linenumber::VARCHAR, 2, '0') || '15' || CASE WHEN l_suppkey % 2 = 0 THEN 'C' ELSE 'P' END
  || printf('%08d', CAST(round_even((l_quantity * 1000 + (l_partkey % 4) * 0.5::DOUBLE) / 1000 * 1000, 0) AS BIGINT)) AS occ, count(*) AS n
FROM lineitem GROUP BY ALL""")
def contract_id(spark, sf):
    li = table(spark, sf, "lineitem")
    strike = (F.col("l_quantity") * 1000 + F.col("l_partkey") % 4 * F.lit(0.5)) / 1000
    occ = S.contract_id(F.col("l_returnflag"), F.make_date(F.lit(2002), F.col("l_linenumber"), F.lit(15)),
                        F.when(F.col("l_suppkey") % 2 == 0, "call").otherwise("put"), strike)
    return li.groupBy(occ.alias("occ")).agg(F.count(F.lit(1)).alias("n"))


view("mapped", """
SELECT upper(l_returnflag) || l_partkey || l_linenumber AS occ, l_returnflag AS ticker, DATE '2001-06-01' AS date,
  make_date(2002, l_linenumber, 15) AS expiration, l_quantity AS strike,
  CASE l_suppkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'P' END AS cp,
  CASE WHEN l_partkey % 17 = 0 THEN 0.0::DOUBLE ELSE l_partkey % 1000 / 4.0::DOUBLE END AS px,
  l_partkey % 90 AS total_volume, l_partkey % 500 AS open_interest,
  CASE WHEN l_orderkey % 23 <> 0 THEN l_orderkey % 500 ELSE 0 END AS prev_oi,
  l_orderkey % 41 AS bid_volume, l_partkey % 37 AS ask_volume, l_suppkey % 29 AS mid_volume,
  CASE WHEN l_partkey % 19 = 0 THEN 0.0::DOUBLE ELSE l_orderkey % 100 / 8.0::DOUBLE END AS lastpx,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE l_tax + 0.1::DOUBLE END AS iv, l_shipdate AS last_tape_time,
  (CASE WHEN l_partkey % 17 = 0 THEN 0.0::DOUBLE ELSE l_partkey % 1000 / 4.0::DOUBLE END) * (l_partkey % 90) * 100 AS total_premium
FROM lineitem""")


@query("prj_10_map_contract_rows", """
SELECT occ, ticker, strftime(expiration, '%Y-%m-%d') AS expiration, strike, cp AS "right", date_diff('day', date, expiration) AS dte,
  round(total_premium, 4) AS total_premium, total_volume, open_interest, prev_oi,
  open_interest - prev_oi AS oi_change, bid_volume, ask_volume, mid_volume, nullif(px, 0) AS vwap, nullif(lastpx, 0) AS last_price,
  round(iv, 6) AS iv, CAST(NULL AS BIGINT) AS sweep_volume FROM mapped""")
def map_rows(spark, sf):
    m = contracts.map_rows(adapters.raw_contracts(spark, sf), F.lit("2001-06-01").cast("date"))
    return m.select("occ", "ticker", d("expiration").alias("expiration"), "strike", "right", n("dte").alias("dte"),
                    r("total_premium", 4).alias("total_premium"), "total_volume", "open_interest", "prev_oi",
                    "oi_change", "bid_volume", "ask_volume", "mid_volume", "vwap", "last_price", r("iv").alias("iv"),
                    "sweep_volume")


@query("prj_11_session_relabel", """
SELECT strftime(CAST(m AS DATE), '%Y-%m-%d') AS date, CAST(m AS DATE) <> DATE '2001-06-01' AS relabelled,
  date_diff('day', CAST(m AS DATE), expiration) AS dte, count(*) AS n
FROM mapped, (SELECT max(last_tape_time) AS m FROM mapped) GROUP BY ALL""")
def relabel(spark, sf):
    raw = adapters.raw_contracts(spark, sf)
    typed = raw.select(F.lit("2001-06-01").cast("date").alias("date"),
                       F.col("expires").cast("date").alias("expiration"), "last_tape_time")
    out = contracts.relabel_session(typed)
    return out.groupBy(d("date").alias("date"), "relabelled", n("dte").alias("dte")).agg(F.count(F.lit(1)).alias("n"))


view("archive", """
SELECT l_returnflag AS ticker, strftime(l_shipdate, '%Y') AS yr, make_date(2002, l_linenumber, 15) AS expiration, l_quantity AS strike,
  CASE WHEN l_suppkey % 2 = 0 THEN 'C' ELSE 'P' END AS cp, l_shipdate AS created, (l_partkey % 90)::DOUBLE AS volume,
  (l_partkey % 9)::DOUBLE AS cnt, CASE WHEN l_partkey % 7 = 0 THEN 0.0::DOUBLE ELSE l_extendedprice / 100 END AS "close",
  l_extendedprice / 128 AS bid, l_extendedprice / 64 AS ask,
  l_returnflag || '02' || lpad(l_linenumber::VARCHAR, 2, '0') || '15' || CASE WHEN l_suppkey % 2 = 0 THEN 'C' ELSE 'P' END
  || printf('%08d', (l_quantity * 1000)::BIGINT) AS occ FROM lineitem""")
view("archive_px", """
SELECT *, CASE WHEN "close" <= 0 AND volume > 0 THEN (bid + ask) / 2 ELSE "close" END AS px FROM archive""")


@query("prj_12_eod_price", """
SELECT ticker, yr AS year, count(*) FILTER ("close" <= 0 AND volume > 0) AS n_mid, round(sum(px), 3) AS sum_px,
  round(sum(px * volume * 100), 1) AS premium FROM archive_px GROUP BY ALL""")
def eod_price(spark, sf):
    a = adapters.archive_rows(spark, sf)
    px = contracts.effective_price(F.col("close"), F.col("bid"), F.col("ask"), F.col("volume"))
    return a.groupBy("ticker", "year").agg(
        F.count_if((F.col("close") <= 0) & (F.col("volume") > 0)).alias("n_mid"), r(F.sum(px), 3).alias("sum_px"),
        r(F.sum(px * F.col("volume") * 100), 1).alias("premium"))


@query("prj_13_basis_family", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, round(sum(call_gex - put_gex), 4) + 0.0 AS net, round(sum(call_gex + put_gex), 4) AS gross,
  round(sum(fc * abs(call_gex) - fp * abs(put_gex)), 4) + 0.0 AS flip,
  round(sum(fc * (call_volume + 0.5 * call_oi) - fp * (put_volume + 0.5 * put_oi)), 4) + 0.0 AS oi_size
FROM (SELECT *, CASE WHEN call_ask_vol > call_bid_vol THEN 1 ELSE -1 END AS fc,
  CASE WHEN put_ask_vol > put_bid_vol THEN 1 ELSE -1 END AS fp FROM chain_m) GROUP BY ticker, ts""")
def basis_family(spark, sf):
    return adapters.chain(spark, sf).groupBy("ticker", d("ts").alias("ts")).agg(
        *[r(F.sum(rows.basis(b)), 4).alias(b) for b in rows.BASES])


@query("prj_14_freshness", """
SELECT a.ticker, strftime(a.ts, '%Y-%m-%d') AS ts, n_expired, CAST(sum_oi AS BIGINT) AS sum_oi,
  CASE WHEN n_expired > 0 THEN 'stale' ELSE 'fresh' END AS verdict, round(sum_oi / other_oi, 6) AS oi_ratio,
  coalesce(abs(sum_oi / other_oi - 1) > 0.2, false) AS oi_off, abs(off_s) <= 90 AS usable
FROM (SELECT ticker, ts, count(*) FILTER (make_date(1998, row_l, 15) < CAST(ts AS DATE)) AS n_expired, sum(call_oi + put_oi) AS sum_oi
      FROM chain_m GROUP BY ticker, ts) a
JOIN (SELECT ticker, ts, sum(call_prev_oi + put_prev_oi) AS other_oi, CAST(sum(row_a) AS BIGINT) % 200 AS off_s FROM chain_m GROUP BY ticker, ts) b
USING (ticker, ts)""")
def freshness(spark, sf):
    c = adapters.chain(spark, sf).withColumn("oi", F.col("call_oi") + F.col("put_oi")).withColumn(
        "old_expiry", F.make_date(F.lit(1998), F.month("expiry"), F.lit(15))).withColumn("captured", F.to_date("ts"))
    other = c.groupBy("ticker", "ts").agg(
        F.sum(F.col("call_prev_oi") + F.col("put_prev_oi")).alias("other_oi"), (F.sum("row_a") % 200).alias("off_s"))
    out = rows.freshness(c, ["ticker", "ts"], "captured", "old_expiry", "oi", other, "off_s")
    return out.select("ticker", d("ts").alias("ts"), "n_expired", n("sum_oi").alias("sum_oi"), "verdict",
                      r("oi_ratio").alias("oi_ratio"), "oi_off", "usable")


@query("prj_16_parse_money", """
SELECT o_orderkey, round(o_totalprice * CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1e3 WHEN 2 THEN 1e6 ELSE 1e9 END
  * CASE WHEN o_custkey % 2 = 0 THEN -1 ELSE 1 END, 0) AS value FROM orders""")
def money(spark, sf):
    o = table(spark, sf, "orders")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("", "K", "M", "B")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    sign = F.when(F.col("o_custkey") % 2 == 0, "-$").otherwise("$")
    text = F.concat(sign, F.format_number("o_totalprice", 2), unit)
    return o.select("o_orderkey", r(S.parse_money(text), 0).alias("value"))


view("alert_rules", """
SELECT n_nationkey AS rule_id, CASE n_nationkey % 4 WHEN 1 THEN 'click' WHEN 2 THEN 'view' WHEN 3 THEN 'error' END AS ticker,
  CASE WHEN n_nationkey % 2 = 0 THEN 'premium' ELSE 'volume' END AS metric,
  CASE n_nationkey % 3 WHEN 0 THEN '>' WHEN 1 THEN '<=' ELSE '>=' END AS op, n_nationkey * 100.0::DOUBLE AS threshold,
  n_nationkey % 5 <> 0 AS enabled FROM nation""")
view("alert_metrics", """
SELECT ticker, day, 'premium' AS metric, sum(premium) AS value FROM prints GROUP BY ALL
UNION ALL SELECT ticker, day, 'volume', sum(size)::DOUBLE FROM prints GROUP BY ALL""")


def alert_rules(spark, sf):
    na = table(spark, sf, "nation")
    k = F.col("n_nationkey")
    return na.select(
        k.alias("rule_id"),
        F.when(k % 4 == 1, "click").when(k % 4 == 2, "view").when(k % 4 == 3, "error").alias("ticker"),
        F.when(k % 2 == 0, "premium").otherwise("volume").alias("metric"),
        F.when(k % 3 == 0, ">").when(k % 3 == 1, "<=").otherwise(">=").alias("op"),
        (k * 100.0).alias("threshold"), (k % 5 != 0).alias("enabled"))


def alert_metrics(spark, sf):
    p = adapters.prints(spark, sf).groupBy("ticker", "day").agg(
        F.sum("premium").alias("premium"), F.sum("size").cast("double").alias("volume"))
    return p.unpivot(["ticker", "day"], ["premium", "volume"], "metric", "value")


@query("prj_18_alert_predicate", """
SELECT r.rule_id::BIGINT AS rule_id, m.ticker, strftime(m.day, '%Y-%m-%d') AS day, m.metric, round(m.value, 4) AS value
FROM alert_metrics m JOIN alert_rules r ON m.metric = r.metric AND (r.ticker IS NULL OR r.ticker = m.ticker)
WHERE r.enabled AND CASE r.op WHEN '>' THEN m.value > r.threshold WHEN '<=' THEN m.value <= r.threshold ELSE m.value >= r.threshold END""")
def alert_predicate(spark, sf):
    return rows.alerts(alert_metrics(spark, sf), alert_rules(spark, sf)).select(
        n("rule_id").alias("rule_id"), "ticker", d("day").alias("day"), "metric", r("value", 4).alias("value"))
