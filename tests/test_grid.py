import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from chains import E1, E2, SCHEMA, T1, cells, grid_rows, psi_rows, row, second_rows
from strikeloom.constants import FEATURES
from strikeloom.operators import grid, state

X = (2.70805020110221, 2.4849066497880004, 0.6931471805599453, 0.16, -1.0986122886681098, 0.004329004329004317, 0.6041666666666666)


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)


def test_features_and_psi(spark):
    feats = grid.features(grid.columns(cells(spark, psi_rows())))
    one = feats.first()
    assert all(close(one[f], x) for f, x in zip(FEATURES, X))
    assert close(grid.psi(feats, 1.0).first()["psi"], 1658622864.7173474)
    assert close(grid.psi(feats, 0.7).first()["psi"], 2843304.37699525)


def test_zero_column_weighs_nothing(spark):
    z = grid.psi(grid.features(grid.columns(cells(spark, [row(T1, 100, E1), row(T1, 110, E1)])))).first()
    assert z["psi"] == 0.0


@pytest.mark.parametrize("gap,restarts", [(300, False), (482, False), (500, True)])
def test_gap_rule(spark, gap, restarts):
    before = T1 - dt.timedelta(seconds=gap)
    p = grid.psi(grid.features(grid.columns(cells(spark, psi_rows(before) + psi_rows(T1)))))
    p = p.withColumn("psi", F.when(F.col("ts") != F.lit(T1), 2.0).otherwise(F.col("psi")))
    got = {r["ts"]: r["a"] for r in grid.smoothed_weights(p).collect()}
    psi = p.where(F.col("ts") == F.lit(T1)).first()["psi"]
    a = got[max(got)]
    assert close(a, psi if restarts else 0.79 * 2.0 + 0.21 * psi)
    if gap == 300:
        assert close(a, 597095.4991690024)


def test_missing_expiry_restarts_and_fold_agrees(spark):
    rows = []
    for i in range(40):
        at = T1 + dt.timedelta(seconds=240 * i)
        rows += [row(at, 100, E1, call_gex=5 + i % 7, put_gex=2)]
        if i % 9 != 4:
            rows += [row(at, 100, E2, call_gex=3, put_gex=1 + i % 5)]
    p = grid.psi(grid.features(grid.columns(cells(spark, rows))))
    a = {(r["ts"], r["expiry"]): r["a"] for r in grid.smoothed_weights(p).collect()}
    b = {(r["ts"], r["expiry"]): r["a"] for r in grid.fold_weights(p).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-10) for k in a)
    psi = {(r["ts"], r["expiry"]): r["psi"] for r in p.collect()}
    naive = lambda i: (T1 + dt.timedelta(seconds=240 * i)).replace(tzinfo=None)
    assert close(a[(naive(5), E2)], psi[(naive(5), E2)])


def test_shape_values_and_selection(spark):
    c = cells(spark, grid_rows())
    w = spark.createDataFrame([("X", T1, E1, 1.5), ("X", T1, E2, -2.0)], "ticker string, ts timestamp, expiry date, a double")
    v1 = {r["strike"]: r["v"] for r in grid.node_values(grid.cell_values(grid.shaped(c, 1.0), w)).collect()}
    assert v1 == {100.0: 5.0, 110.0: -1.5}
    valued = grid.cell_values(grid.shaped(c), w)
    h = {(r["strike"], r["expiry"]): r["h"] for r in valued.collect()}
    assert close(h[(110.0, E1)], -4.777213961021834) and close(h[(100.0, E2)], 1.8072040072196895)
    v = {r["strike"]: r["v"] for r in grid.node_values(valued).collect()}
    assert close(v[100.0], 5.385591985560621) and close(v[110.0], -1.1658209415327514)
    assert grid.kings(grid.node_values(valued)).first()["king"] == 100.0
    s = {r["expiry"]: r for r in grid.stars(grid.cell_values(grid.shaped(c, 1.0), w)).collect()}
    assert s[E1]["star"] == 100.0 and s[E2]["star"] == 110.0
    assert s[E1]["global_star"] and s[E1]["star_value"] == 9.0 and not s[E2]["global_star"]


def test_display_weights(spark):
    w = spark.createDataFrame([("X", T1, E1, 3.0), ("X", T1, E2, -1.0)], "ticker string, ts timestamp, expiry date, a double")
    assert {r["expiry"]: r["w"] for r in grid.display_weights(w).collect()} == {E1: 1.5, E2: -0.5}


def test_normalize_and_spot(spark):
    late = (T1 - dt.timedelta(seconds=1000)).replace(tzinfo=None)
    data = [("X", T1, "100", E1, None, 100.0), ("X", T1, "105", E1, T1, 105.0), ("X", T1, "110", E1, late, 110.0),
            ("X", T1, None, E1, None, 1.0), ("X", T1, "120", None, None, 1.0)]
    df = spark.createDataFrame(data, "ticker string, ts timestamp, strike string, expiry date, fetched_at timestamp, spot_price double")
    flagged = grid.normalize(df, [])
    one = grid.batch_counts(flagged).first()
    assert (one["n_rows"], one["n_dropped"]) == (2, 3)
    assert grid.upper_median_spot(df.where("spot_price > 1")).first()["spot"] == 105.0
    even = df.where("spot_price in (100, 105)")
    assert grid.upper_median_spot(even).first()["spot"] == 105.0


def test_cell_state_step(spark):
    c = cells(spark, psi_rows() + second_rows(T1 + dt.timedelta(seconds=241)))
    st = state.cell_state(c, grid.batches(grid.columns(c)), lam=0.79)
    got = {(r["ts"] > T1.replace(tzinfo=None), r["strike"]): (r["q_g"], r["q_f"]) for r in st.collect()}
    assert got[(False, 100.0)] == (6.0, 0.0) and got[(False, 110.0)] == (-5.0, -2.0)
    assert close(got[(True, 100.0)][0], 3.48) and close(got[(True, 100.0)][1], 1.05) and close(got[(True, 110.0)][0], -5.0)


def test_gap_decays_without_reset(spark):
    c = cells(spark, psi_rows() + second_rows(T1 + dt.timedelta(seconds=3600)))
    st = state.cell_state(c, grid.batches(grid.columns(c)), lam=0.79)
    q = {(r["ts"], r["strike"]): r["q_g"] for r in st.collect()}
    keep = 0.79 ** (3600 / 241)
    assert close(q[(max(k[0] for k in q), 100.0)], keep * 6 + (1 - keep) * -6)


@pytest.mark.parametrize("spots,strike,expected", [((104.0, 109.0), 100.0, (0, 0, 1)), ((104.0, 109.0), 110.0, (1, 0, 0)), ((98.0, 103.0), 100.0, (1, 1, 0))])
def test_interactions(spark, spots, strike, expected):
    rows = [row(T1 + dt.timedelta(seconds=241 * i), s, E1, spot=spot, call_gex=1) for i, spot in enumerate(spots) for s in (100, 110)]
    c = cells(spark, rows)
    counts = state.scores(state.interactions(c, grid.batches(grid.columns(c))))
    last = counts.where(F.col("strike") == strike).orderBy(F.col("ts").desc()).first()
    assert (last["n_tch"], last["n_del"], last["n_rej"]) == expected
    if expected == (1, 1, 0):
        assert last["s_del"] == 0.5


def test_session_restart(spark):
    day2 = T1 + dt.timedelta(days=1)
    c = cells(spark, psi_rows() + [row(day2, 100, E1, call_gex=3)])
    r = {x["ts"]: (x["ceil"], x["floor"], x["rho"]) for x in state.session_range(grid.columns(c)).collect()}
    assert r[max(r)] == (3.0, 3.0, 0.0) and r[min(r)][:2] == (11.0, 11.0)


def test_state_model_reduces_to_base(spark):
    c = cells(spark, grid_rows())
    cols = grid.columns(c)
    w = spark.createDataFrame([("X", T1, E1, 1.5), ("X", T1, E2, -2.0)], "ticker string, ts timestamp, expiry date, a double")
    rows = state.state_cells(state.cell_state(c, grid.batches(cols)), w, state.session_range(cols))
    scores = state.scores(state.interactions(c, grid.batches(cols)))
    beta = (1.0, 0, 0, 0, 0, 0, 0, 0)
    node = {r["strike"]: r["v"] for r in state.node_design(rows, scores).withColumn("v", state.linear_value(beta)).collect()}
    assert node == {100.0: 5.0, 110.0: -1.5}
    full = state.state_cell_values(rows, scores).groupBy("strike").agg(F.sum("c").alias("v"))
    nodes = {r["strike"]: r["v"] for r in state.node_design(rows, scores).withColumn("v", state.linear_value()).collect()}
    assert all(close(r["v"], nodes[r["strike"]]) for r in full.collect())
