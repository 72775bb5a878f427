"""The alert stream against its SQL on events that share their ticker and time, and on events that come late."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
os.environ.setdefault("SF_DIR", "/root/testdata/sf0.001")

import __spark_entry__ as entry_points  # noqa: E402
import compare  # noqa: E402
from strikeloom import adapters  # noqa: E402
from strikeloom.plans.rows import alert_rules  # noqa: E402
from strikeloom.streaming import jobs  # noqa: E402

SOURCE = "/root/testdata/sf0.001/events.parquet"
NAME = "str_7_alert_stream"


def folder(path, events):
    """A table folder whose events are the rows of the given SQL."""
    duckdb.sql(f"COPY ({events}) TO '{path}/events.parquet' (FORMAT parquet)")
    os.symlink("/root/testdata/sf0.001/nation.parquet", f"{path}/nation.parquet")
    return str(path)


@pytest.mark.parametrize("kind", ["same_value", "other_value"])
def test_events_of_one_ticker_and_time(spark, tmp_path, monkeypatch, kind):
    """Every event twice under ids of its own, with the same value or another one."""
    value = {"same_value": "value", "other_value": "value * 1.5 + 1"}[kind]
    path = folder(tmp_path, f"SELECT * FROM '{SOURCE}' UNION ALL SELECT * REPLACE (event_id + 1000000 AS event_id, {value} AS value) FROM '{SOURCE}'")
    monkeypatch.setattr(compare, "SF", path)
    status, note, _, _ = compare.check(spark, compare.duck(), NAME, entry_points.queries()[NAME], entry_points.oracle_sql()[NAME])
    assert status == "ok", note


def test_late_events(spark, tmp_path):
    """A file per trigger, the newest events first: all others are older than any watermark."""
    events = spark.read.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(SOURCE)
    source = str(tmp_path / "source")
    for part in ("ts >= '2024-01-20'", "ts < '2024-01-10'", "ts >= '2024-01-10' and ts < '2024-01-20'"):
        events.where(part).coalesce(1).write.mode("append").parquet(source)
    rules = alert_rules(spark, "/root/testdata/sf0.001")

    def alerts(rows):
        p = adapters.prints_of(rows)
        return jobs.alert_stream(p.selectExpr("ticker", "ts", "'premium' AS metric", "premium * 20 AS value"), rules)

    got = jobs.collected(alerts(jobs.file_stream(spark, source, events.schema, files_per_trigger=1)), "alerts")
    want = alerts(events)
    columns = ["rule_id", "ts", "ticker", "value"]
    assert want.count() > 0 and sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
