import datetime as dt
import gzip
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq

from strikeloom.operators import asof
from strikeloom.sources import archive, captures

T0 = dt.datetime(2026, 1, 1, 12, tzinfo=dt.timezone.utc)


def at(s):
    return T0 + dt.timedelta(seconds=s)


def test_nearest_asof_brute_force(spark):
    rng = random.Random(1)
    left = [(i, "hot" if i % 3 else "b", at(rng.randrange(0, 90000))) for i in range(600)] + [(1000, "alone", at(5))]
    right = [("hot", at(rng.randrange(0, 90000))) for _ in range(60)] + [("b", at(40000)), ("b", at(100))]
    a = spark.createDataFrame(left, "id bigint, k string, ts timestamp")
    b = spark.createDataFrame(right, "k string, sts timestamp")
    got = {r["id"]: r for r in asof.nearest_asof(a, b, ["k"], "ts", "sts", 600.0).collect()}
    assert len(got) == len(left)
    for i, k, ts in left:
        times = sorted(t for kk, t in right if kk == k)
        if not times:
            assert got[i]["match_ts"] is None and got[i]["dist_s"] is None
            continue
        best = min(times, key=lambda t: (abs((t - ts).total_seconds()), t))
        dist = abs((best - ts).total_seconds())
        assert got[i]["dist_s"] == dist
        assert got[i]["match_ts"] == (best.replace(tzinfo=None) if dist <= 600 else None)


def test_tie_takes_the_earlier(spark):
    a = spark.createDataFrame([("x", at(3600))], "k string, ts timestamp")
    b = spark.createDataFrame([("x", at(3500)), ("x", at(3700))], "k string, sts timestamp")
    assert asof.nearest_asof(a, b, ["k"], "ts", "sts", 100.0).first()["match_ts"] == at(3500).replace(tzinfo=None)
    assert asof.nearest_asof(a, b, ["k"], "ts", "sts", 99.0).first()["match_ts"] is None


def test_completeness_raises(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    expected = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "k string, expected bigint")
    audit = asof.completeness(rows, expected, ["k"])
    assert {r["k"]: r["complete"] for r in audit.collect()} == {"a": True, "b": False, "c": False}
    try:
        asof.assert_complete(audit)
    except ValueError:
        return
    raise AssertionError("incomplete snapshot passed")


def test_archive_types_junk_and_filters(spark, tmp_path):
    root = tmp_path / "options"
    for ticker, year, strike in (("SPY", "2022", pa.array([100, 101])), ("SPY", "2024", pa.array([100.5, 101.5])), ("QQQ", "2024", pa.array([7.0, 8.0]))):
        folder = root / f"ticker={ticker}"
        folder.mkdir(parents=True, exist_ok=True)
        t = pa.table({"strike": strike, "t": pa.array([f"{year}-01-02T10:00:00Z", f"{year}-03-04T23:59:59Z"])})
        pq.write_table(t, folder / f"year={year}.parquet")
    (root / "ticker=SPY" / "._year=2022.parquet").write_bytes(b"junk")
    (root / "ticker=SPY" / "year=2022.parquet.lock").write_bytes(b"")
    a = archive.scan(spark, str(root), {"strike": "double", "t": "string"})
    assert sorted((r["_ticker"], r["_year"], r["strike"]) for r in a.collect()) == [
        ("QQQ", "2024", 7.0), ("QQQ", "2024", 8.0), ("SPY", "2022", 100.0), ("SPY", "2022", 101.0), ("SPY", "2024", 100.5), ("SPY", "2024", 101.5)]
    assert archive.scan(spark, str(root), {"strike": "double"}, ["spy"], ["2024"]).count() == 2
    assert archive.time_range(a, "2024-01-02", "2024-03-04").count() == 4
    assert archive.time_range(a, None, "2024-03-03").count() == 4
    one = archive.summary(a).first()
    assert (one["rows"], one["n_tickers"], one["n_years"]) == (6, 2, 2)


def test_capture_files(spark, tmp_path):
    doc = {"meta": {"metric": "gamma"}, "data": {"symbols": [{
        "symbol": "SPX", "asOf": "2026-09-30T14:30:00Z", "spot": 100.0, "expirations": ["2026-10-01", "2026-10-02"],
        "strikes": [{"strike": 99.5, "value": 3.0, "nodeType": "king"}, {"strike": 100, "value": -1.0, "nodeType": "normal"}],
        "matrix": [[3.0, 0.0], [-1.0, 0.0]]}]}}
    day = tmp_path / "matrix" / "gamma" / "2026-09-30"
    day.mkdir(parents=True)
    with gzip.open(day / "143000.json.gz", "wt") as fh:
        json.dump(doc, fh)
    (day / "._143000.json.gz").write_bytes(b"junk")
    s = captures.read_matrix(spark, str(tmp_path / "matrix"))
    assert sorted((r["strike"], r["expiry"], r["value"]) for r in captures.matrix_cells(s).collect()) == [(99.5, "2026-10-01", 3.0), (100.0, "2026-10-01", -1.0)]
    assert captures.matrix_strikes(s).count() == 2
    k = {r["expiry"]: (r["strike"], r["value"]) for r in captures.column_kings(s).collect()}
    assert k == {"2026-10-01": (99.5, 3.0), "2026-10-02": (None, 0.0)}
    assert captures.capture_kings(s).first()["king"] == 99.5


def test_range_values_follow_their_axis(spark, tmp_path):
    doc = {"data": {"from": "2026-09-30T14:30:00Z", "to": "x", "symbols": [{"symbol": "SPX", "axes": [{"id": 0, "strikes": [1, 2]}, {"id": 1, "strikes": [2, 3, 4]}],
           "frames": [{"asOf": "a", "axis": 1, "values": [10, 20, 30]}, {"asOf": "b", "values": [5, 6]}]}]}}
    with gzip.open(tmp_path / "r.json.gz", "wt") as fh:
        json.dump(doc, fh)
    got = sorted((r["frame"], r["strike"], r["value"]) for r in captures.read_range(spark, str(tmp_path)).collect())
    assert got == [(0, 2.0, 10.0), (0, 3.0, 20.0), (0, 4.0, 30.0), (1, 1.0, 5.0), (1, 2.0, 6.0)]
