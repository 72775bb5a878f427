"""Lines that share order and line number: the batch spot is the least quantity among the first ones, in batches and in streams."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
os.environ.setdefault("SF_DIR", "/root/testdata/sf0.001")

import __spark_entry__ as entry_points  # noqa: E402
import compare  # noqa: E402


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """Every line twice under its key, with another quantity and price, in an order of its own."""
    path = tmp_path_factory.mktemp("tied")
    source = "/root/testdata/sf0.001/lineitem.parquet"
    duckdb.sql(f"""COPY (SELECT * FROM (SELECT * FROM '{source}' UNION ALL
      SELECT * REPLACE (l_quantity % 50 + 1 AS l_quantity, l_partkey + 7 AS l_partkey, l_extendedprice * 1.37 AS l_extendedprice) FROM '{source}')
      ORDER BY hash(l_orderkey, l_quantity, l_partkey)) TO '{path}/lineitem.parquet' (FORMAT parquet)""")
    return str(path)


@pytest.mark.parametrize("name", ["agg_2_features", "agg_5_cell_values", "agg_21_scorecard", "fit_14_miss_taxonomy", "exp_4_rolling_levels", "exp_6_presets_and_range",
                                  "str_3_weight_stream", "str_4_node_stream"])
def test_first_row_of_equal_keys(spark, tied, monkeypatch, name):
    monkeypatch.setattr(compare, "SF", tied)
    status, note, _, _ = compare.check(spark, compare.duck(), name, entry_points.queries()[name], entry_points.oracle_sql()[name])
    assert status == "ok", note
