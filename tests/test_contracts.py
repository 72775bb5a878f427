import datetime as dt

from pyspark.sql import functions as F

from strikeloom.operators import contracts, flow, ranking

RAW = ("option_symbol string, underlying_symbol string, option_type string, strike string, expires string, avg_price string, last_price string, volume string, "
       "open_interest string, prev_oi string, bid_volume string, ask_volume string, mid_volume string, iv double, last_tape_time timestamp")
CALL = ("SPY 261016C00580000", "spy", "call", "580", "2026-10-16", "2.5", "2.6", "1234", "900", "400", "100", "200", "50", 0.31, dt.datetime(2026, 10, 1, 19, 59))
PUT = ("SPY__261016P00580000", "spy", "put", "580", "2026-10-16", "0", "0", "600", "10", None, "1", "2", "3", 0.0, dt.datetime(2026, 10, 1, 19, 0))


def mapped(spark):
    return contracts.map_rows(spark.createDataFrame([CALL, PUT], RAW), F.lit("2026-10-01").cast("date"))


def test_map_rows(spark):
    rows = {r["right"]: r for r in mapped(spark).collect()}
    c, p = rows["C"], rows["P"]
    assert (c["occ"], c["ticker"], c["dte"], c["oi_change"], c["total_premium"]) == ("SPY261016C00580000", "SPY", 15, 500, 2.5 * 1234 * 100)
    assert p["occ"] == "SPY261016P00580000" and p["vwap"] is None and p["total_premium"] == 0.0 and p["iv"] is None and p["prev_oi"] == 0
    assert c["sweep_volume"] is None and c["trade_count"] is None


def test_underlying_day(spark):
    u = contracts.underlying_day(mapped(spark)).first()
    assert (u["call_volume"], u["put_volume"], u["total_volume"], u["unique_strikes"], u["unique_expirations"]) == (1234, 600, 1834, 1, 1)
    assert u["call_put_ratio"] is None


def test_activity_flags(spark):
    days = [("A", dt.date(2026, 1, 1) + dt.timedelta(days=i), 100 if i < 10 else 250, 10.0 + i, 1000, 1000) for i in range(11)]
    days += [("B", dt.date(2026, 1, 5), 7, 1.0, 0, 0), ("C", dt.date(2026, 1, 5), 7, 1.0, 5, 0)]
    df = spark.createDataFrame(days, "occ string, day date, volume bigint, premium double, oi bigint, prev_oi bigint")
    got = {(r["occ"], r["day"]): r for r in contracts.activity(df, 10).collect()}
    last = got[("A", dt.date(2026, 1, 11))]
    assert last["rvol"] == 2.5 and last["flag_rvol"] and last["prem_pctile"] == 1.0 and last["flag_surprise"] and not last["flag_oi"]
    assert got[("B", dt.date(2026, 1, 5))]["rvol"] == float("inf") and not got[("B", dt.date(2026, 1, 5))]["flag_oi"]
    assert got[("C", dt.date(2026, 1, 5))]["oi_change_pct"] == float("inf") and got[("C", dt.date(2026, 1, 5))]["flag_oi"]


def test_section_rank_single_row(spark):
    df = spark.createDataFrame([("d1", "a", 1.0), ("d2", "a", 1.0), ("d2", "b", None), ("d3", "b", 1.0), ("d3", "a", 1.0)], "day string, underlying string, v double")
    got = {(r["day"], r["underlying"]): r["p"] for r in ranking.section_rank(df, ["day"], "p", "v").collect()}
    assert got == {("d1", "a"): 0.5, ("d2", "a"): 0.5, ("d3", "a"): 0.0, ("d3", "b"): 1.0}


def test_sweeps_chain(spark):
    base = dt.datetime(2026, 1, 1, 10)
    times = [0.0, 0.8, 1.5, 4.0, 5.2]
    df = spark.createDataFrame([("X", base + dt.timedelta(seconds=t), 1, 2.0) for t in times], "occ string, ts timestamp, size bigint, premium double")
    assert sorted(r["n"] for r in flow.sweeps(df, 1.0).collect()) == [1, 1, 3]


def test_max_pain_matches_pairs(spark):
    rows = [("X", float(s), float(c), float(p)) for s, c, p in ((90, 5, 40), (95, 10, 30), (100, 50, 20), (105, 30, 10), (110, 40, 5))]
    df = spark.createDataFrame(rows, "k string, strike double, call_oi double, put_oi double")
    got = flow.max_pain(df, ["k"]).first()
    pain = {k: sum(c * max(k - s, 0) + p * max(s - k, 0) for _, s, c, p in rows) for _, k, _, _ in rows}
    best = min(pain, key=lambda k: (pain[k], k))
    assert got["max_pain"] == best and abs(got["payout"] - pain[best]) < 1e-9
