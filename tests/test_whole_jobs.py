"""Queries over the whole job, against the narrower ones of the same inventory id."""

import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
os.environ.setdefault("SF_DIR", "/root/testdata/sf0.001")

import __spark_entry__ as entry_points
import compare


def run(spark, name):
    return entry_points.queries()[name](spark, os.environ["SF_DIR"]).collect()


def test_all_variants(spark):
    wide, narrow = run(spark, "fit_12_all_variants"), run(spark, "fit_12_variant_sweep")
    assert {r["variant"] for r in wide} - {r["variant"] for r in narrow} == {"pow_0.7", "clip_3740", "basis_flip_pow_0.5", "basis_oi_size_pow_0.5"}
    assert set(narrow) <= set(wide)


def test_bounds_on_the_flip_basis(spark):
    flip, net = run(spark, "fit_13_flip_bounds"), run(spark, "fit_13_upper_bounds")
    assert {(r["bound"], r["ticker"], r["n"]) for r in flip} == {(r["bound"], r["ticker"], r["n"]) for r in net} and set(flip) != set(net)


def test_rank_measures(spark):
    rows, narrow = run(spark, "fit_21_rank_measures"), run(spark, "fit_21_rank_validation")
    got = {(r["day"], r["ranking"], r["truth"], r["k"]): r for r in rows}
    for r in narrow:
        for name in ("prem", "unusual", "attention"):
            assert got[r["day"], "score", name, 10]["hits"] == r[f"hits_{name}"]
    assert {k for *_, k in got} == {0, 10, 25, 50, 100, 150}
    assert all(-1 <= r["spearman"] <= 1 for r in rows if r["k"] == 0)
    assert all(r["precision"] is None or abs(r["precision"] - r["hits"] / r["n"]) < 1e-6 for r in rows if r["k"])


def test_volatility_as_of_each_row(spark):
    name = "jn_6_asof_enrichment"
    status, note, _, _ = compare.check(spark, compare.duck(), name, entry_points.queries()[name], entry_points.oracle_sql()[name])
    assert status == "ok", note
