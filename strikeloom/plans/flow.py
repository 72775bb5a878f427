"""Flow analytics over prints, contract days and bars."""

from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.operators import contracts, flow, grid, tiers
from strikeloom.plans.common import d, m_cells, n, r, t, valued
from strikeloom.plans.registry import query, view
from strikeloom.session import materialize

view("today", "SELECT max(day) AS today FROM prints")
view("sessions", "SELECT day, row_number() OVER (ORDER BY day DESC) - 1 AS back FROM (SELECT DISTINCT day FROM prints) QUALIFY back <= 20")


view("tod", """
SELECT ticker, day, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) // 3600 AS slot, CAST(sum(CASE WHEN cp = 'C' THEN size ELSE 0 END) AS BIGINT) AS call_volume,
  CAST(sum(CASE WHEN cp = 'P' THEN size ELSE 0 END) AS BIGINT) AS put_volume, sum(CASE WHEN cp = 'C' THEN premium ELSE 0 END) AS call_premium,
  sum(CASE WHEN cp = 'P' THEN premium ELSE 0 END) AS put_premium, count(*) AS trades, sum(premium) AS premium FROM prints GROUP BY ALL""")


@query("flw_1_relative_volume_bars", """
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, slot, call_volume, put_volume, round(call_premium, 4) AS call_premium, round(put_premium, 4) AS put_premium,
  round(avg(call_volume + put_volume) OVER w, 5) AS avg_volume, round((call_volume + put_volume) / nullif(avg(call_volume + put_volume) OVER w, 0), 5) AS rvol,
  round(avg(call_volume) OVER w, 5) AS avg_call_volume, round(avg(put_volume) OVER w, 5) AS avg_put_volume, round(avg(call_premium + put_premium) OVER w, 4) AS avg_premium,
  round(call_volume / nullif(avg(call_volume) OVER w, 0), 5) AS call_rvol, round(put_volume / nullif(avg(put_volume) OVER w, 0), 5) AS put_rvol, count(*) OVER w AS days
FROM tod WINDOW w AS (PARTITION BY ticker, slot ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def volume_bars(spark, sf):
    b = flow.relative_volume_bars(adapters.prints(spark, sf))
    return b.select("ticker", d("day").alias("day"), n("slot").alias("slot"), n("call_volume").alias("call_volume"), n("put_volume").alias("put_volume"),
                    r("call_premium", 4).alias("call_premium"), r("put_premium", 4).alias("put_premium"), r("avg_volume", 5).alias("avg_volume"), r("rvol", 5).alias("rvol"),
                    *[r(c, 5).alias(c) for c in ("avg_call_volume", "avg_put_volume", "call_rvol", "put_rvol")], r("avg_premium", 4).alias("avg_premium"), "days")


@query("flw_1_day_rvol", """
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, volume, round(volume / nullif(avg(volume) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), 6) AS rvol
FROM (SELECT ticker, day, CAST(sum(size) AS BIGINT) AS volume FROM prints GROUP BY ALL)""")
def day_rvol(spark, sf):
    return flow.day_rvol(flow.relative_volume_bars(adapters.prints(spark, sf))).select("ticker", d("day").alias("day"), n("volume").alias("volume"), r("rvol").alias("rvol"))


@query("flw_2_time_of_day_baseline", """
SELECT ticker, slot, count(*) FILTER (back > 0) AS n_days, round(avg(x) FILTER (back > 0), 5) AS trades_avg, round(stddev_samp(x) FILTER (back > 0), 5) AS trades_std,
  round(avg(y) FILTER (back > 0), 4) AS premium_avg, round((max(x) FILTER (back = 0) - avg(x) FILTER (back > 0)) / nullif(stddev_samp(x) FILTER (back > 0), 0), 5) AS trades_z,
  round((max(y) FILTER (back = 0) - avg(y) FILTER (back > 0)) / nullif(stddev_samp(y) FILTER (back > 0), 0), 5) AS premium_z FROM (
  SELECT g.ticker, g.slot, s.back, coalesce(trades, 0) AS x, coalesce(premium, 0) AS y FROM (SELECT DISTINCT ticker, slot FROM tod JOIN sessions USING (day)) g CROSS JOIN sessions s
  LEFT JOIN tod t ON t.ticker = g.ticker AND t.slot = g.slot AND t.day = s.day) GROUP BY ticker, slot""")
def tod_baseline(spark, sf):
    b = flow.time_of_day_baseline(adapters.prints(spark, sf))
    return b.select("ticker", n("slot").alias("slot"), "n_days", r("trades_avg", 5).alias("trades_avg"), r("trades_std", 5).alias("trades_std"),
                    r("premium_avg", 4).alias("premium_avg"), r("trades_z", 5).alias("trades_z"), r("premium_z", 5).alias("premium_z"))


@query("flw_3_volume_oi_bands", """
SELECT strftime(day, '%Y-%m-%d') AS day, cp AS "right", band, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(oi) AS BIGINT) AS oi, count(*) AS contracts, round(sum(volume) / sum(oi), 6) AS vol_oi FROM (
  SELECT *, CASE WHEN m >= 0.10 THEN 'otm_10plus' WHEN m >= 0.05 THEN 'otm_5_10' WHEN m >= 0.03 THEN 'otm_3_5' ELSE 'atm_itm' END AS band FROM (
    SELECT *, CASE WHEN cp = 'C' THEN (strike - 75.0::DOUBLE) / 75.0::DOUBLE ELSE (75.0::DOUBLE - strike) / 75.0::DOUBLE END AS m FROM cday WHERE oi >= 100)) GROUP BY day, cp, band""")
def oi_bands(spark, sf):
    return flow.volume_oi_bands(adapters.contract_day(spark, sf), F.lit(75.0)).select(
        d("day").alias("day"), "right", "band", n("volume").alias("volume"), n("oi").alias("oi"), "contracts", r("vol_oi").alias("vol_oi"))


@query("flw_4_market_overview", """
SELECT strftime(day, '%Y-%m-%d') AS day, round(cp, 4) AS call_premium, round(pp, 4) AS put_premium, round(cp - pp, 4) + 0.0 AS net_premium, round(cp / nullif(pp, 0), 6) AS ratio, active,
  round((cp + pp) / avg(cp + pp) OVER (ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 6) AS vs_base FROM (
  SELECT day, sum(CASE WHEN p.cp = 'C' THEN premium ELSE 0 END) AS cp, sum(CASE WHEN p.cp = 'P' THEN premium ELSE 0 END) AS pp, count(DISTINCT underlying) AS active FROM prints p GROUP BY day)""")
def overview(spark, sf):
    o = flow.market_overview(adapters.prints(spark, sf))
    return o.select(d("day").alias("day"), r("call_premium", 4).alias("call_premium"), r("put_premium", 4).alias("put_premium"), r("net_premium", 4).alias("net_premium"),
                    r("ratio").alias("ratio"), "active", r("vs_base").alias("vs_base"))


@query("flw_4_premium_so_far", """
SELECT strftime(day, '%Y-%m-%d') AS day, slot, round(so_far, 4) AS so_far, round(avg(so_far) OVER w, 4) AS base, round(so_far / nullif(avg(so_far) OVER w, 0), 5) AS rvol FROM (
  SELECT g.day, g.slot, sum(coalesce(premium, 0)) OVER (PARTITION BY g.day ORDER BY g.slot) AS so_far FROM (SELECT day, unnest(range(24)) AS slot FROM (SELECT DISTINCT day FROM prints)) g
  LEFT JOIN (SELECT day, slot, sum(premium) AS premium FROM tod GROUP BY ALL) t ON t.day = g.day AND t.slot = g.slot)
WINDOW w AS (PARTITION BY slot ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def premium_so_far(spark, sf):
    o = flow.premium_so_far(adapters.prints(spark, sf))
    return o.select(d("day").alias("day"), n("slot").alias("slot"), r("so_far", 4).alias("so_far"), r("base", 4).alias("base"), r("rvol", 5).alias("rvol"))


@query("flw_4_bull_bear", """
SELECT strftime(day, '%Y-%m-%d') AS day, round(sum(CASE WHEN (cp = 'C') = (side = 'ask') AND side <> 'mid' THEN premium ELSE 0 END), 4) AS bull,
  round(sum(CASE WHEN (cp = 'C') <> (side = 'ask') AND side <> 'mid' THEN premium ELSE 0 END), 4) AS bear FROM prints GROUP BY day""")
def overview_bull_bear(spark, sf):
    return flow.bull_bear(adapters.prints(spark, sf), ["day"]).select(d("day").alias("day"), r("bull", 4).alias("bull"), r("bear", 4).alias("bear"))


@query("flw_5_daily_history", """
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, round(sum(premium), 4) AS premium, CAST(sum(size) AS BIGINT) AS volume, count(*) AS trades,
  round(sum(CASE WHEN cp = 'C' THEN premium ELSE -premium END), 4) + 0.0 AS net_premium FROM prints WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ticker, day""")
def history(spark, sf):
    h = flow.daily_history(adapters.prints(spark, sf), "2024-01-05", "2024-01-20")
    return h.select("ticker", d("day").alias("day"), r("premium", 4).alias("premium"), n("volume").alias("volume"), "trades", r("net_premium", 4).alias("net_premium"))


@query("flw_6_daily_statistics", """
SELECT ticker, strftime(yr, '%Y-%m-%d') AS day, arg_min(spot, ts) AS open, max(spot) AS high, min(spot) AS low, arg_max(spot, ts) AS "close", round(min(lo), 4) AS min_cell, round(max(hi), 4) AS max_cell,
  round(avg(greatest(abs(lo), abs(hi))), 4) AS peak_mean, round(max(greatest(abs(lo), abs(hi))), 4) AS peak_max, count(*) AS frames, count(*) >= 12 AS complete FROM (
  SELECT ticker, ts, date_trunc('year', ts) AS yr, max(spot) AS spot, min(v) AS lo, max(v) AS hi FROM (SELECT ticker, ts, strike, sum(g) AS v, max(spot) AS spot FROM cells_m GROUP BY ALL) GROUP BY ALL) GROUP BY ticker, yr""")
def statistics(spark, sf):
    nodes = m_cells(spark, sf).groupBy("ticker", "ts", "strike").agg(F.sum("g").alias("v"), F.max("spot").alias("spot"))
    s = flow.daily_statistics(nodes, F.date_trunc("year", "ts"), 12)
    return s.select("ticker", d("day").alias("day"), "open", "high", "low", "close", *[r(c, 4).alias(c) for c in ("min_cell", "max_cell", "peak_mean", "peak_max")], "frames", "complete")


@query("flw_7_top_tickers", """
SELECT strftime(day, '%Y-%m-%d') AS day, underlying, round(premium, 4) AS premium, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY day ORDER BY premium DESC, underlying) AS rank FROM (SELECT day, underlying, sum(premium) AS premium FROM prints GROUP BY ALL)) WHERE rank <= 10""")
def top_tickers(spark, sf):
    p = adapters.prints(spark, sf).groupBy("day", "underlying").agg(F.sum("premium").alias("premium"))
    return flow.top_by(p, ["day"], "premium", ["underlying"], 10).select(d("day").alias("day"), "underlying", r("premium", 4).alias("premium"), n("rank").alias("rank"))


view("ranked_orders", """
  SELECT day, 'ticker' AS kind, underlying AS name, * EXCLUDE (day, underlying) FROM (
    SELECT day, underlying, sum(premium) AS premium, sum(size)::DOUBLE AS volume, sum(CASE WHEN cp = 'C' THEN premium ELSE -premium END) AS net_premium,
      sum(CASE WHEN cp = 'C' THEN size END) / nullif(sum(CASE WHEN cp = 'P' THEN size END), 0)::DOUBLE AS call_put_ratio FROM prints GROUP BY ALL)
  UNION ALL SELECT day, 'contract', occ, sum(premium), sum(size)::DOUBLE, sum(CASE WHEN cp = 'C' THEN premium ELSE -premium END),
      sum(CASE WHEN cp = 'C' THEN size END) / nullif(sum(CASE WHEN cp = 'P' THEN size END), 0)::DOUBLE FROM prints GROUP BY day, occ""")


@query("flw_7_ranked_orders", """
SELECT strftime(day, '%Y-%m-%d') AS day, kind, board, name, round(v, 4) + 0.0 AS value, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY day, kind, board ORDER BY v DESC, name) AS rank FROM (UNPIVOT (SELECT * FROM ranked_orders) ON premium, volume, net_premium, call_put_ratio INTO NAME board VALUE v)) WHERE rank <= 10""")
def ranked_orders(spark, sf):
    p = adapters.prints(spark, sf)
    out = None
    for kind, key in (("ticker", "underlying"), ("contract", "occ")):
        call = F.col("right") == "C"
        sums = p.groupBy("day", F.col(key).alias("name")).agg(
            F.sum("premium").alias("premium"), F.sum("size").alias("volume"), F.sum(F.when(call, F.col("premium")).otherwise(-F.col("premium"))).alias("net_premium"),
            F.try_divide(F.sum(F.when(call, F.col("size"))), F.sum(F.when(~call, F.col("size")))).alias("call_put_ratio")).withColumn("kind", F.lit(kind))
        out = sums if out is None else out.unionByName(sums)
    top = flow.ranked_boards(out, ["day", "kind"], {c: c for c in ("premium", "volume", "net_premium", "call_put_ratio")}, ["name"], 10)
    return top.select(d("day").alias("day"), "kind", "board", "name", r("by", 4).alias("value"), n("rank").alias("rank"))


@query("flw_8_unusual_lists", """
SELECT strftime(day, '%Y-%m-%d') AS day, list, occ, rank FROM (
  SELECT day, 'volume' AS list, occ, row_number() OVER (PARTITION BY day ORDER BY rvol DESC, occ) AS rank FROM flags WHERE flag_rvol
  UNION ALL SELECT day, CASE WHEN oi_change > 0 THEN 'oi_opening' ELSE 'oi_closing' END, occ, row_number() OVER (PARTITION BY day, oi_change > 0 ORDER BY abs(oi_change) DESC, occ) FROM flags WHERE flag_oi) WHERE rank <= 20""")
def unusual(spark, sf):
    f = materialize(contracts.activity(adapters.contract_day(spark, sf)), "flags")
    vol = flow.top_by(f.where("flag_rvol").withColumn("list", F.lit("volume")), ["day", "list"], "rvol", ["occ"], 20)
    oi = f.where("flag_oi").withColumns({"list": F.when(F.col("oi_change") > 0, "oi_opening").otherwise("oi_closing"), "_abs": F.abs("oi_change")})
    oi = flow.top_by(oi, ["day", "list"], "_abs", ["occ"], 20)
    cols = ["day", "list", "occ", "rank"]
    return vol.select(cols).unionByName(oi.select(cols)).select(d("day").alias("day"), "list", "occ", n("rank").alias("rank"))


@query("flw_9_net_flow_tide", """
SELECT ticker, strftime(mn, '%Y-%m-%d %H:%M:%S') AS minute, round(ncp, 4) + 0.0 AS ncp, round(npp, 4) + 0.0 AS npp, round(sum(ncp - npp) OVER (PARTITION BY ticker, day ORDER BY mn), 4) + 0.0 AS tide FROM (
  SELECT ticker, day, date_trunc('minute', ts) AS mn, sum(CASE WHEN cp = 'C' THEN sg * premium ELSE 0 END) AS ncp, sum(CASE WHEN cp = 'P' THEN sg * premium ELSE 0 END) AS npp
  FROM (SELECT *, CASE side WHEN 'ask' THEN 1 WHEN 'bid' THEN -1 ELSE 0 END AS sg FROM prints) GROUP BY ALL)""")
def net_flow(spark, sf):
    f = flow.net_flow(adapters.prints(spark, sf))
    return f.select("ticker", t("at").alias("minute"), r("ncp", 4).alias("ncp"), r("npp", 4).alias("npp"), r("tide_net_impact", 4).alias("tide"))


@query("flw_9_side_from_quote", """
SELECT side, count(*) AS n FROM (SELECT CASE WHEN price >= ask THEN 'ask' WHEN price <= bid THEN 'bid' WHEN price > (bid + ask) / 2 THEN 'ask' WHEN price < (bid + ask) / 2 THEN 'bid' ELSE 'mid' END AS side
  FROM (SELECT price, price * (90 + seq % 11) / 100 AS bid, price * (95 + seq % 17) / 100 AS ask FROM prints)) GROUP BY side""")
def sides(spark, sf):
    p = adapters.prints(spark, sf)
    side = flow.side_of(F.col("price"), F.col("price") * (90 + F.col("seq") % 11) / 100, F.col("price") * (95 + F.col("seq") % 17) / 100)
    return p.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


@query("flw_10_bull_bear", """
SELECT occ, strftime(day, '%Y-%m-%d') AS day, round(bull, 4) AS bull, round(bear, 4) AS bear, round(bull / nullif(bull + bear, 0), 6) AS bull_share FROM (
  SELECT occ, day, sum(CASE WHEN (cp = 'C' AND side = 'ask') OR (cp = 'P' AND side = 'bid') THEN premium ELSE 0 END) AS bull,
    sum(CASE WHEN (cp = 'C' AND side = 'bid') OR (cp = 'P' AND side = 'ask') THEN premium ELSE 0 END) AS bear FROM prints GROUP BY ALL)""")
def bull_bear(spark, sf):
    return flow.bull_bear(adapters.prints(spark, sf), ["occ", "day"]).select("occ", d("day").alias("day"), r("bull", 4).alias("bull"), r("bear", 4).alias("bear"), r("bull_share").alias("bull_share"))


@query("flw_11_strike_ladder", """
SELECT ticker, strftime(day, '%Y-%m-%d') AS day, strike, round(sum(CASE WHEN cp = 'C' AND side = 'ask' THEN premium ELSE 0 END), 4) AS calls_bought, round(sum(CASE WHEN cp = 'C' AND side = 'bid' THEN premium ELSE 0 END), 4) AS calls_sold,
  round(sum(CASE WHEN cp = 'P' AND side = 'ask' THEN premium ELSE 0 END), 4) AS puts_bought, round(sum(CASE WHEN cp = 'P' AND side = 'bid' THEN premium ELSE 0 END), 4) AS puts_sold FROM prints GROUP BY ticker, day, strike""")
def ladder(spark, sf):
    return flow.strike_ladder(adapters.prints(spark, sf), ["ticker", "day"]).select(
        "ticker", d("day").alias("day"), "strike", *[r(c, 4).alias(c) for c in ("calls_bought", "calls_sold", "puts_bought", "puts_sold")])


@query("flw_12_opening_size", """
SELECT strftime(day, '%Y-%m-%d') AS day, seq, occ, size, rank FROM (
  SELECT p.day, p.seq, p.occ, p.size, row_number() OVER (PARTITION BY p.day ORDER BY p.size DESC, p.seq) AS rank FROM prints p JOIN cday c ON p.occ = c.occ AND p.day = c.day WHERE p.size * 20 > c.prev_oi) WHERE rank <= 50""")
def opening(spark, sf):
    p = adapters.prints(spark, sf)
    days = adapters.contract_day(spark, sf).select("occ", "day", "prev_oi")
    big = p.join(days, ["occ", "day"]).where(F.col("size") * 20 > F.col("prev_oi"))
    return flow.top_by(big, ["day"], "size", ["seq"], 50).select(d("day").alias("day"), "seq", "occ", "size", n("rank").alias("rank"))


@query("flw_12_volume_over_oi", """
SELECT strftime(day, '%Y-%m-%d') AS day, occ, volume, rank FROM (SELECT day, occ, volume, row_number() OVER (PARTITION BY day ORDER BY volume DESC, occ) AS rank FROM cday WHERE volume > oi / 10) WHERE rank <= 50""")
def volume_over_oi(spark, sf):
    days = adapters.contract_day(spark, sf).where(F.col("volume") > F.col("oi") / 10)
    return flow.top_by(days, ["day"], "volume", ["occ"], 50).select(d("day").alias("day"), "occ", n("volume").alias("volume"), n("rank").alias("rank"))


@query("flw_13_repeated_hits", """
SELECT a.seq, a.occ, a.band, count(*) AS hits FROM (SELECT *, size // 25 AS band FROM prints WHERE side = 'ask') a JOIN (SELECT *, size // 25 AS band FROM prints WHERE side = 'ask') b
ON a.occ = b.occ AND a.band = b.band AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 7 DAY GROUP BY a.seq, a.occ, a.band HAVING count(*) >= 3""")
def repeated(spark, sf):
    h = flow.repeated_hits(adapters.prints(spark, sf), F.floor(F.col("size") / 25))
    return h.select("seq", "occ", n("band").alias("band"), n("hits").alias("hits"))


@query("flw_14_contract_boards", """
SELECT span, occ, CAST(sum(volume) AS BIGINT) AS volume, round(sum(premium), 4) AS premium, arg_max(oi, day) AS oi, round(sum(volume) / nullif(arg_max(oi, day), 0), 6) AS vol_oi, round(sum(sweep_volume) / nullif(sum(volume), 0), 6) AS sweep_share
FROM cday CROSS JOIN today CROSS JOIN (VALUES ('1D', 1), ('7D', 7), ('1M', 30)) v(span, k) WHERE day > today - k AND day <= today GROUP BY span, occ""")
def boards(spark, sf):
    b = _boards(spark, sf)
    return b.select("span", "occ", n("volume").alias("volume"), r("premium", 4).alias("premium"), n("oi").alias("oi"), r("vol_oi").alias("vol_oi"), r("sweep_share").alias("sweep_share"))


def _boards(spark, sf):
    days = adapters.contract_day(spark, sf)
    latest = adapters.prints(spark, sf).agg(F.max("day").alias("_today"))  # one row
    return flow.contract_boards(days.join(F.broadcast(latest)), F.col("_today"), {"1D": 1, "7D": 7, "1M": 30})


view("board_sums", """
  SELECT span, occ, sum(volume)::DOUBLE AS volume, sum(premium) AS premium, arg_max(oi, day)::DOUBLE AS open_interest, sum(volume) / nullif(arg_max(oi, day), 0)::DOUBLE AS unusual, sum(sweep_premium) AS sweeps,
    round(sum(sweep_volume) / nullif(sum(volume), 0), 6) AS sweep_share
  FROM cday CROSS JOIN today CROSS JOIN (VALUES ('1D', 1), ('7D', 7), ('1M', 30)) v(span, k) WHERE day > today - k AND day <= today GROUP BY span, occ""")


@query("flw_14_ranked_boards", """
SELECT span, board, occ, round(v, 4) AS value, sweep_share, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY span, board ORDER BY v DESC, occ) AS rank FROM (UNPIVOT (SELECT * FROM board_sums) ON volume, premium, open_interest, unusual, sweeps INTO NAME board VALUE v)) WHERE rank <= 25""")
def ranked_boards(spark, sf):
    top = flow.ranked_boards(_boards(spark, sf), ["span"], flow.BOARDS, ["occ"], 25)
    return top.select("span", "board", "occ", r("by", 4).alias("value"), r("sweep_share").alias("sweep_share"), n("rank").alias("rank"))


@query("flw_15_dark_pool", """
SELECT p.seq, p.ticker, round(price * size, 4) AS notional, round(size / adv, 8) AS adv_share FROM prints p JOIN (
  SELECT ticker, day, avg(v) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS adv FROM (SELECT ticker, day, sum(size) AS v FROM prints GROUP BY ALL)) a USING (ticker, day) WHERE price * size >= 1000""")
def dark_pool(spark, sf):
    return flow.dark_pool(adapters.prints(spark, sf), 1000.0).select("seq", "ticker", r("notional", 4).alias("notional"), r("adv_share", 8).alias("adv_share"))


@query("flw_16_gated_overlays", """
SELECT strftime(g.day, '%Y-%m-%d') AS day, g.underlying, g.rank, coalesce(v.hit, false) AS unusual_volume, coalesce(o.hit, false) AS unusual_oi, coalesce(x.vol_gt_oi, false) AS vol_gt_oi,
  coalesce(x.sweep_heavy, false) AS sweep_heavy, coalesce(h.hit, false) AS repeat_hits FROM (
  SELECT day, underlying, row_number() OVER (PARTITION BY day ORDER BY premium DESC, underlying) AS rank FROM tday WHERE volume >= 100) g
LEFT JOIN (SELECT DISTINCT day, underlying, true AS hit FROM flags WHERE flag_rvol) v USING (day, underlying) LEFT JOIN (SELECT DISTINCT day, underlying, true AS hit FROM flags WHERE flag_oi) o USING (day, underlying)
LEFT JOIN (SELECT day, underlying, bool_or(volume > oi / 10) AS vol_gt_oi, sum(sweep_volume) >= 0.25 * sum(volume) AS sweep_heavy FROM cday GROUP BY day, underlying) x USING (day, underlying)
LEFT JOIN (SELECT DISTINCT a.day, a.underlying, true AS hit FROM prints a JOIN (
  SELECT p.seq FROM (SELECT *, size // 25 AS band FROM prints WHERE side = 'ask') p JOIN (SELECT *, size // 25 AS band FROM prints WHERE side = 'ask') q
  ON p.occ = q.occ AND p.band = q.band AND q.ts <= p.ts AND q.ts > p.ts - INTERVAL 7 DAY GROUP BY p.seq HAVING count(*) >= 3) r USING (seq)) h USING (day, underlying) WHERE g.rank <= 25""")
def overlays(spark, sf):
    from strikeloom.operators import ranking
    f = materialize(contracts.activity(adapters.contract_day(spark, sf)), "flags")
    gate = ranking.ticker_day(f).where("volume >= 100").select("day", "underlying", "premium")
    top = flow.top_by(gate, ["day"], "premium", ["underlying"], 25)
    for name, flag in (("unusual_volume", "flag_rvol"), ("unusual_oi", "flag_oi")):
        hits = f.where(flag).select("day", "underlying").distinct().withColumn(name, F.lit(True))
        top = top.join(hits, ["day", "underlying"], "left").fillna(False, [name])
    day = adapters.contract_day(spark, sf).groupBy("day", "underlying").agg(
        F.expr("bool_or(volume > oi / 10)").alias("vol_gt_oi"), (F.sum("sweep_volume") >= 0.25 * F.sum("volume")).alias("sweep_heavy"))
    again = flow.repeated_hits(adapters.prints(spark, sf), F.floor(F.col("size") / 25)).select("day", "underlying").distinct().withColumn("repeat_hits", F.lit(True))
    top = top.join(day, ["day", "underlying"], "left").join(again, ["day", "underlying"], "left").fillna(False, ["vol_gt_oi", "sweep_heavy", "repeat_hits"])
    return top.select(d("day").alias("day"), "underlying", n("rank").alias("rank"), "unusual_volume", "unusual_oi", "vol_gt_oi", "sweep_heavy", "repeat_hits")


view("bars5", """
SELECT ticker, CAST(time_bucket(INTERVAL 5 MINUTE, ts) AS DATE) AS day, time_bucket(INTERVAL 5 MINUTE, ts) AS ts, max(price) AS high, min(price) AS low, arg_max(price, row(ts, seq)) AS close FROM prints GROUP BY ticker, time_bucket(INTERVAL 5 MINUTE, ts)""")
view("asks", "SELECT ticker, day, seq AS alert_id, ts FROM prints WHERE is_sweep")


@query("flw_17_alert_outcomes", """
SELECT a.alert_id, b0.close AS price_0, b5.close AS price_5, b15.close AS price_15, b30.close AS price_30, round(x.price_eod, 6) AS price_eod, round(x.hi - b0.close, 6) AS mfe, round(x.lo - b0.close, 6) AS mae
FROM (SELECT *, ts + INTERVAL 5 MINUTE AS t5, ts + INTERVAL 15 MINUTE AS t15, ts + INTERVAL 30 MINUTE AS t30 FROM asks) a
ASOF JOIN bars5 b0 ON a.ticker = b0.ticker AND a.day = b0.day AND a.ts >= b0.ts ASOF JOIN bars5 b5 ON a.ticker = b5.ticker AND a.day = b5.day AND a.t5 >= b5.ts
ASOF JOIN bars5 b15 ON a.ticker = b15.ticker AND a.day = b15.day AND a.t15 >= b15.ts
ASOF JOIN bars5 b30 ON a.ticker = b30.ticker AND a.day = b30.day AND a.t30 >= b30.ts
JOIN (SELECT p.alert_id, max(b.high) AS hi, min(b.low) AS lo, arg_max(b.close, b.ts) AS price_eod FROM asks p JOIN bars5 b ON p.ticker = b.ticker AND p.day = b.day AND b.ts >= time_bucket(INTERVAL 5 MINUTE, p.ts) GROUP BY p.alert_id) x ON a.alert_id = x.alert_id""")
def outcomes(spark, sf):
    p = adapters.prints(spark, sf)
    bars = tiers.bars(adapters.spot_ticks(spark, sf)).withColumnRenamed("bucket", "ts").withColumn("day", F.to_date("ts"))
    alerts = p.where("is_sweep").select("ticker", "day", F.col("seq").alias("alert_id"), "ts")
    o = flow.alert_outcomes(alerts, materialize(bars, "bars"))
    return o.select("alert_id", "price_0", "price_5", "price_15", "price_30", r("price_eod").alias("price_eod"), r("mfe").alias("mfe"), r("mae").alias("mae"))


@query("flw_17_hit_rates", """
SELECT a.ticker, count(*) AS alerts, round(avg(CASE WHEN b0.close > 0 THEN (b30.close >= 1.5 * b0.close)::INT END), 6) AS up_half_30m,
  round(avg(CASE WHEN b0.close > 0 THEN (e.price >= 2 * b0.close)::INT END), 6) AS doubled_eod
FROM (SELECT *, ts + INTERVAL 30 MINUTE AS t30 FROM asks) a ASOF JOIN bars5 b0 ON a.ticker = b0.ticker AND a.day = b0.day AND a.ts >= b0.ts
ASOF JOIN bars5 b30 ON a.ticker = b30.ticker AND a.day = b30.day AND a.t30 >= b30.ts JOIN (SELECT ticker, day, arg_max("close", ts) AS price FROM bars5 GROUP BY ALL) e ON e.ticker = a.ticker AND e.day = a.day
GROUP BY a.ticker""")
def alert_hit_rates(spark, sf):
    p = adapters.prints(spark, sf)
    bars = tiers.bars(adapters.spot_ticks(spark, sf)).withColumnRenamed("bucket", "ts").withColumn("day", F.to_date("ts"))
    alerts = p.where("is_sweep").select("ticker", "day", F.col("seq").alias("alert_id"), "ts")
    rates = flow.hit_rates(flow.alert_outcomes(alerts, materialize(bars, "bars")), ["ticker"])
    return rates.select("ticker", "alerts", r("up_half_30m").alias("up_half_30m"), r("doubled_eod").alias("doubled_eod"))


@query("flw_18_sector_breadth", """
SELECT s.sector, strftime(day, '%Y-%m-%d') AS day, round(avg(up), 6) AS breadth, count(*) AS names FROM (
  SELECT underlying, day, CASE WHEN premium > avg(premium) OVER (PARTITION BY underlying ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) THEN 1.0 ELSE 0.0 END AS up FROM (
    SELECT underlying, day, max(price) AS premium FROM prints GROUP BY ALL)) b JOIN sectors s USING (underlying) GROUP BY s.sector, day""")
def breadth(spark, sf):
    bars = adapters.prints(spark, sf).groupBy(F.col("underlying").alias("ticker"), "day").agg(F.max("price").alias("close"))
    sectors = adapters.sectors(spark, sf).select(F.col("underlying").alias("ticker"), "sector")
    return flow.breadth(bars, sectors).select("sector", d("day").alias("day"), r("breadth").alias("breadth"), "names")


@query("flw_19_put_call_ratio", """
SELECT underlying, strftime(day, '%Y-%m-%d') AS day, CAST(sum(CASE WHEN cp = 'C' THEN volume ELSE 0 END) AS BIGINT) AS calls, CAST(sum(CASE WHEN cp = 'P' THEN volume ELSE 0 END) AS BIGINT) AS puts,
  round(sum(CASE WHEN cp = 'P' THEN volume ELSE 0 END) / nullif(sum(CASE WHEN cp = 'C' THEN volume ELSE 0 END), 0), 6) AS put_call FROM cday GROUP BY underlying, day""")
def put_call(spark, sf):
    return flow.put_call_ratio(adapters.contract_day(spark, sf), ["underlying", "day"]).select(
        "underlying", d("day").alias("day"), n("calls").alias("calls"), n("puts").alias("puts"), r("put_call").alias("put_call"))


@query("flw_19_max_pain", """
SELECT ticker, strftime(ts, '%Y-%m-%d') AS ts, strftime(expiry, '%Y-%m-%d') AS expiry, strike AS max_pain, round(pain, 2) AS payout FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, ts, expiry ORDER BY pain, strike) AS rn FROM (
    SELECT k.ticker, k.ts, k.expiry, k.strike, sum(CASE WHEN s.strike < k.strike THEN s.call_oi * (k.strike - s.strike) ELSE s.put_oi * (s.strike - k.strike) END) AS pain
    FROM cells_m k JOIN cells_m s ON k.ticker = s.ticker AND k.ts = s.ts AND k.expiry = s.expiry GROUP BY ALL)) WHERE rn = 1""")
def max_pain(spark, sf):
    return flow.max_pain(m_cells(spark, sf), ["ticker", "ts", "expiry"]).select(
        "ticker", d("ts").alias("ts"), d("expiry").alias("expiry"), "max_pain", r("payout", 2).alias("payout"))
