"""Contract-day queries against their SQL on events without a premium, a size, a user or a time."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
os.environ.setdefault("SF_DIR", "/root/testdata/sf0.001")

import __spark_entry__ as entry_points  # noqa: E402
import compare  # noqa: E402

SOURCE = "/root/testdata/sf0.01/events.parquet"


def same_as_sql(spark, path, monkeypatch, name, column, share):
    """The query and its SQL agree on events of which one in ``share`` lacks the column."""
    duckdb.sql(f"""COPY (SELECT * REPLACE (CASE WHEN hash(event_id) % {share} = 0 THEN NULL ELSE {column} END AS {column}) FROM '{SOURCE}')
      TO '{path}/events.parquet' (FORMAT parquet)""")
    monkeypatch.setattr(compare, "SF", str(path))
    status, note, _, _ = compare.check(spark, compare.duck(), name, entry_points.queries()[name], entry_points.oracle_sql()[name])
    assert status == "ok", note


@pytest.mark.parametrize("name", ["win_8_own_history_percentile", "fit_20_backtest_report"])
def test_no_premium(spark, tmp_path, monkeypatch, name):
    same_as_sql(spark, tmp_path, monkeypatch, name, "value", 3)


@pytest.mark.parametrize("column", ["props", "user_id", "ts"])
@pytest.mark.parametrize("name", ["win_7_contract_rvol", "fit_20_backtest_report"])
def test_no_size_user_or_time(spark, tmp_path, monkeypatch, name, column):
    same_as_sql(spark, tmp_path, monkeypatch, name, column, 3 if column == "props" else 30)
