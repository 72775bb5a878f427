"""Streams from raw rows against their batch meaning, under cuts, replays, silence and late rows."""

import os

import pytest
from pyspark.sql import functions as F

from strikeloom import adapters
from strikeloom.operators import grid, state, tiers
from strikeloom.session import scratch_dir
from strikeloom.streaming import chains, jobs
from strikeloom.streaming.rollup import HourlyRollup

SF = os.environ.get("STREAM_SF_DIR", "/root/testdata/sf0.001")
MONTH_S = 30 * 86400.0


@pytest.fixture(scope="module")
def few(spark):
    """Each stateful operator costs a task per shuffle partition and trigger."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def chain(few):
    return adapters.chain(few, SF, "month").where("ts >= '1996-01-01'")


def streamed(chain, how, pieces):
    spark = chain.sparkSession
    path = scratch_dir(spark, "raw")
    jobs.land(chain, path, "ts", pieces, 1)
    stream = jobs.file_stream(spark, path, chain.schema, files_per_trigger=1)
    return jobs.run_to_end(how(stream), "out", path, chain.schema)


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_weights_of_cut_batches(chain):
    cells = grid.with_first_spot(grid.cells(chain))
    want = rows(grid.smoothed_weights(grid.psi(grid.features(grid.columns(cells)), 0.7), 31 * 86400.0), "ticker", "ts", "expiry")
    out, progress = streamed(chain, lambda s: chains.weights(s, "1 day", 31 * 86400.0), 3)
    got = rows(out, "ticker", "ts", "expiry")
    assert sum(p["numInputRows"] > 0 for p in progress) == 4  # a file per trigger, and the end mark
    assert got.keys() == want.keys() and out.count() == len(want)
    assert all(got[k]["a"] == pytest.approx(want[k]["a"], rel=1e-9) for k in want)


def test_node_state_of_cut_batches(chain):
    cells = grid.with_first_spot(grid.cells(chain)).cache()
    batches = grid.batches(grid.columns(cells))
    cell = rows(state.cell_state(cells, batches, 0.99, MONTH_S), "ticker", "ts", "strike", "expiry")
    node = rows(state.interactions(cells, batches), "ticker", "ts", "strike")
    out, _ = streamed(chain, lambda s: chains.node_state(s, "1 day", 0.99, MONTH_S), 2)
    got = rows(out, "ticker", "ts", "strike", "expiry")
    cells.unpersist()
    assert got.keys() == cell.keys() and out.count() == len(cell)
    for k, r in got.items():
        assert r["q_g"] == pytest.approx(cell[k]["q_g"], rel=1e-9, abs=1e-6) and r["q_f"] == pytest.approx(cell[k]["q_f"], rel=1e-9, abs=1e-6)
        assert (r["n_tch"], r["n_del"], r["n_rej"]) == tuple(node[k[:3]][c] for c in ("n_tch", "n_del", "n_rej"))


def test_a_replayed_micro_batch_changes_nothing(few):
    snaps = adapters.snapshots(few, SF).where("ts < '2024-01-06'")
    kept, hours = scratch_dir(few, "kept"), scratch_dir(few, "hours")
    one, two = HourlyRollup(kept, hours, 1), HourlyRollup(kept, hours, 2)
    # Both halves touch every hour.
    parts = [snaps.where("seq % 2 = 0"), snaps.where("seq % 2 = 1")]
    for i, part in enumerate(parts):
        one(part, i)

    def held():
        return sorted(map(tuple, few.read.parquet(hours).select("ticker", "expiry", "hour", F.round("call_gex", 4), "spot_open", "spot_close", "schema_version").collect()))

    first = held()
    want = tiers.hourly(snaps).select("ticker", "expiry", "hour", F.round("call_gex", 4), "spot_open", "spot_close", "schema_version").collect()
    assert first == sorted(map(tuple, want))
    one(parts[1], 1)
    assert held() == first
    two(snaps.where("ts >= '2024-01-05 12:00:00'"), 0)
    second = held()
    assert {r[-1] for r in second} == {1, 2} and [r for r in second if r[-1] == 1] == [r for r in first if str(r[2]) < "2024-01-05 12:00:00"]
    one(parts[0], 0)  # an older version replayed after a newer one
    assert held() == second
    one(snaps.where("false"), 2)
    assert held() == second


def test_silence_late_rows_and_open_windows(few):
    from strikeloom.plans import load_all

    queries = load_all().QUERIES
    p = adapters.prints(few, SF).cache()
    alarms = queries["str_6_silence_stream"](few, SF).collect()
    sources = sorted(r[0] for r in p.select("ticker").distinct().collect())
    by = {s: sorted(r["event"] for r in alarms if r["source"] == s) for s in sources}
    assert by.pop(sources[0]) == ["silent"] and all(x == ["recovered", "silent", "silent"] for x in by.values())
    assert max(r["payload_ts"] for r in alarms) == str(p.where(F.col("ticker") != sources[0]).agg(F.max("ts")).first()[0])[:19]
    assert queries["str_1_bucket_stream"](few, SF).count() == tiers.buckets(adapters.snapshots(few, SF)).count()
    late = queries["str_5_late_rows"](few, SF).first()
    p.unpersist()
    assert late["late"] > 0 and late["rows_in"] == late["late"] + late["kept"]
