"""Steps whose cost per row must not grow with the rows of a group or landing."""

import datetime as dt
import os
import random

from strikeloom import adapters
from strikeloom.operators import asof
from strikeloom.session import scratch_dir
from strikeloom.streaming import chains, jobs

SF = os.environ.get("STREAM_SF_DIR", "/root/testdata/sf0.001")


def test_nearest_times_of_a_busy_hour_without_frames_to_the_end(spark):
    rng = random.Random(5)
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)
    left = [("x", i, rng.randrange(4 * 3600)) for i in range(400)] + [("y", 0, 5)]
    right = sorted(rng.sample(range(4 * 3600), 60))
    near = asof.nearest_asof(spark.createDataFrame([(k, i, at(s)) for k, i, s in left], "k string, i int, ts timestamp"),
                             spark.createDataFrame([("x", at(s)) for s in right], "k string, rts timestamp"), ["k"], "ts", "rts")
    assert "unboundedfollowing" not in near._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {(r["k"], r["i"]): (r["match_ts"], r["dist_s"]) for r in near.collect()}
    for k, i, s in left:
        want = min(right, key=lambda x: (abs(x - s), x)) if k == "x" else None
        match, dist = got[k, i]
        assert (match and match.replace(tzinfo=None)) == (want is not None and at(want).astimezone().replace(tzinfo=None) or None)
        assert dist == (abs(want - s) if want is not None else None)


def test_files_of_a_landing_follow_its_rows(spark, monkeypatch):
    monkeypatch.setattr(jobs, "FILE_ROWS", 500)
    rows = adapters.chain(spark, SF, "month")
    path = scratch_dir(spark, "landed")
    files = jobs.land(rows, path, "ts", 3, 2)
    assert files > 2
    landed = spark.read.schema(rows.schema).parquet(path)
    assert len(landed.inputFiles()) == 3 * files and sorted(map(tuple, landed.select("row_a", "ts", "strike").collect())) == sorted(map(tuple, rows.select("row_a", "ts", "strike").collect()))
    stream = jobs.file_stream(spark, path, rows.schema, files_per_trigger=files)
    out, progress = jobs.run_to_end(chains.closed_counts(stream, "1 day"), "closed", path, rows.schema)
    assert out.agg({"n_rows": "sum"}).first()[0] == rows.count() == jobs.rows_in(progress)
