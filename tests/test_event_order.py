"""Premiums of a contract's day are added in event order, whatever tasks read them: sums that tie in an own history tie as in the SQL.

The SQL runs on one thread: on several, DuckDB adds in an order of its own, and the SQL differs from itself.
"""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
os.environ.setdefault("SF_DIR", "/root/testdata/sf0.001")

import __spark_entry__ as entry_points  # noqa: E402
import compare  # noqa: E402
from strikeloom import adapters  # noqa: E402


@pytest.fixture(scope="module")
def cut(spark, tmp_path_factory):
    """Tenths as premiums, the prints of each day spread over ten row groups, each group read by a task of its own."""
    path = tmp_path_factory.mktemp("cut")
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(hash(i + 7) % 2592000) AS ts, (hash(i) % 20)::BIGINT AS user_id, 'view' AS event_type,
      (hash(i + 13) % 9 + 1) / 10.0::DOUBLE AS value, '{{"k": ' || i % 100 || '}}' AS props FROM range(20480) t(i) ORDER BY i)
      TO '{path}/events.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)""")
    settings = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield str(path)
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["win_8_own_history_percentile", "fit_20_backtest_report"])
def test_ties_of_sums(spark, cut, monkeypatch, name):
    monkeypatch.setattr(compare, "SF", cut)
    con = compare.duck()
    con.execute("SET threads = 1")
    status, note, _, _ = compare.check(spark, con, name, entry_points.queries()[name], entry_points.oracle_sql()[name])
    assert status == "ok", note


def test_sums_in_event_order(spark, cut):
    held = {}
    for e in sorted(spark.read.parquet(f"{cut}/events.parquet").select("event_id", "user_id", F.to_date("ts").alias("day"), "value").collect()):
        held[e["user_id"], e["day"]] = held.get((e["user_id"], e["day"]), 0.0) + e["value"]
    got = {(r["contract"], r["day"]): r["premium"] for r in adapters.contract_day(spark, cut).select("contract", "day", "premium").collect()}
    assert got == held
