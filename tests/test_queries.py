"""Registered queries against their SQL on DuckDB.

The default run takes one or two queries per family; ALL_QUERIES=1 runs all.
"""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
os.environ.setdefault("SF_DIR", "/root/testdata/sf0.001")

import __spark_entry__ as entry_points  # noqa: E402
import compare  # noqa: E402

_SOME = [
    "top_1_king_top6", "win_1_gap_reset_ewma", "prj_5_normalize_batch", "prj_10_map_contract_rows", "win_2_cell_ewma", "agg_8_state_design",
    "prj_15_cell_features", "src_1_matrix_capture_cells", "src_2_range_capture", "src_4_archive_scan", "src_8_session_partitions", "src_13_export_manifest",
    "jn_1_nearest_asof", "agg_18_session_availability", "agg_19_quantile_rules", "win_7_contract_rvol", "top_3_ticker_ranks", "top_7_score_variants",
    "set_2_universe", "fit_4_king_star_scorecard", "fit_14_miss_taxonomy", "fit_7_leave_one_day_out", "fit_12_variant_sweep", "agg_24_five_minute_buckets",
    "str_1_bucket_stream", "str_3_weight_stream", "str_4_range_stream", "str_8_sweep_stream", "flw_13_repeated_hits", "flw_17_alert_outcomes",
    "flw_19_max_pain", "exp_4_rolling_levels", "vol_5_streaks", "vol_8_anchored_vwap",
]
_NAMES = list(entry_points.queries()) if os.environ.get("ALL_QUERIES") else _SOME


@pytest.fixture(scope="module")
def duck():
    return compare.duck()


@pytest.mark.parametrize("name", _NAMES)
def test_query(spark, duck, name):
    fn, sql = entry_points.queries()[name], entry_points.oracle_sql().get(name)
    status, note, _, _ = compare.check(spark, duck, name, fn, sql)
    assert status in ("ok", "rows"), note


def test_every_sql_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry_returns_rows(spark):
    assert entry_points.entry(spark).count() > 0
