"""Constant tenors and rankings held against truth sets, on small rows worked by hand."""

import math

import pytest

from strikeloom.operators import ranking, volatility


def test_constant_tenors(spark):
    rows = spark.createDataFrame([
        ("both", 4, 0.4), ("both", 16, 0.3), ("both", 40, 0.2), ("both", 0, 9.0), ("both", -3, 9.0), ("both", 30, None),
        ("exact", 9, 0.25), ("exact", 30, 0.5), ("late", 12, 0.3), ("late", 20, 0.6), ("early", 2, 0.7), ("none", 5, None)], "ticker string, dte int, iv double")
    out = {r["ticker"]: r for r in volatility.constant_tenors(rows, ["ticker"], {"near": 9, "far": 30}).collect()}
    near = 0.16 * 4 + (0.09 * 16 - 0.16 * 4) * 5 / 12
    far = 0.09 * 16 + (0.04 * 40 - 0.09 * 16) * 14 / 24
    assert out["both"]["near"] == pytest.approx(math.sqrt(near / 9)) and out["both"]["far"] == pytest.approx(math.sqrt(far / 30))
    assert (out["exact"]["near"], out["exact"]["far"]) == (0.25, 0.5)
    assert (out["late"]["near"], out["late"]["far"]) == (0.3, 0.6) and (out["early"]["near"], out["early"]["far"]) == (0.7, 0.7)
    assert "none" not in out


def test_evaluation_against_several_truths(spark):
    ranks = spark.createDataFrame([("a", "x", d, f"T{i}", i) for d in (1, 2) for i in range(1, 8)], "track string, ranking string, day int, underlying string, rank int")
    truth = spark.createDataFrame([("a", "x", "all", 1, t) for t in ("T1", "T4", "T9", "T1")] + [("a", "x", "few", 1, "T7"), ("a", "y", "all", 1, "T1")],
                                  "track string, ranking string, truth string, day int, underlying string")
    got = {(r["truth"], r["day"], r["k"]): (r["n_truth"], r["n"], r["hits"], r["precision"], round(r["recall"], 6)) for r in ranking.evaluate(ranks, truth, (3, 10)).collect()}
    assert got == {("all", 1, 3): (3, 3, 1, pytest.approx(1 / 3), 0.333333), ("all", 1, 10): (3, 7, 2, pytest.approx(2 / 7), 0.666667),
                   ("few", 1, 3): (1, 3, 0, 0.0, 0.0), ("few", 1, 10): (1, 7, 1, pytest.approx(1 / 7), 1.0)}


def test_all_rankings_by_one_window(spark):
    rows = [(1, f"T{i}", float(i % 4), float(i % 3), i % 2, i % 5, float(i % 2), None if i % 3 else i / 10) for i in range(20)]
    summary = spark.createDataFrame(rows, "day int, underlying string, premium double, rvol_max double, n_flag_rvol int, n_flag_oi int, oi_max double, pctile_max double")
    got = {(r["ranking"], r["underlying"]): r["rank"] for r in ranking.ticker_ranks(summary).collect()}
    for name in ranking.RANKINGS:
        for r in ranking.ticker_rank(summary, name).collect():
            assert got[name, r["underlying"]] == r["rank"]


def test_captured_contracts(spark):
    days = spark.createDataFrame([("A", 1, f"c{i}", v, p) for i, (v, p) in enumerate([(5, 1.0), (9, 1.0), (5, 2.0), (5, 1.0)])] + [("B", 1, "d", 0, 0.0)],
                                 "underlying string, day int, occ string, volume int, premium double")
    assert sorted(r["occ"] for r in ranking.captured(days, 3).collect()) == ["c0", "c1", "c2", "d"]


def test_rich_scores_rank_surprise_and_flags(spark):
    import os
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    os.environ.setdefault("SF_DIR", "/root/testdata/sf0.001")
    import __spark_entry__ as entry_points
    import compare

    name = "top_5_rich_scores"
    status, note, _, _ = compare.check(spark, compare.duck(), name, entry_points.queries()[name], entry_points.oracle_sql()[name])
    assert status == "ok", note
