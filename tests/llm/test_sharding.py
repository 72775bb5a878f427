import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strikeloom.llm import sharding


def check(df, shards=16, **how):
    """Every record once, shards whose counts differ by one at most, slots without gaps, sizes and checksums."""
    rows = sharding.digest(sharding.shuffle_into_shards(df, shards, **how)).collect()
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    by = {s: [] for s in range(shards)}
    for r in rows:
        assert r["law"] == "rows" and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
    sizes = [len(x) for x in by.values()]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    return rows


def test_whole_table(documents):
    rows = check(documents)
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.digest(sharding.shuffle_into_shards(documents)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in rows}


def test_many_buckets_and_hot_rows(frame):
    rows = [(i, f"text {i}", "a") for i in range(700)] + [(7, "the same row", "a")] * 500 + [(None, f"no id {i}", None) for i in range(300)]
    df = frame(rows).repartition(5)
    out = check(df, bucket_rows=40)
    # Equal rows do not stay together: they reach all shards.
    assert len({r["shard"] for r in out if r["doc_id"] == 7}) == 16
    records, per = sharding.scatter(df, [], 16 << 20, 40, 1)
    assert per.agg(F.max("_rows")).first()[0] <= sharding.OVERFULL * 40
    assert per.agg(F.sum("_rows")).first()[0] == 1500 and records.count() == 1500


def test_orders_are_uniform(frame):
    n = 3000
    df = frame([(i, f"t{i}", "a") for i in range(n)])
    for rows in (None, 100):
        out = sharding.shuffle_into_shards(df, 1, bucket_rows=rows or sharding.BUCKET_ROWS).select("doc_id", "slot").collect()
        place = [r["slot"] for r in sorted(out)]
        assert abs(np.corrcoef(place, range(n))[0, 1]) < 0.08
        assert abs(np.mean([abs(a - b) for a, b in zip(place, place[1:])]) / (n / 3) - 1) < 0.1
        fixed = sum(a == i for i, a in enumerate(place))
        assert fixed < 10


def test_odd_empty_columns_and_files(spark, odd, empty, tmp_path):
    check(odd)
    check(odd, shards=3, bucket_rows=2)
    assert check(empty) == []
    out = sharding.shuffle_into_shards(odd, 4, columns=("score", "batch"))
    assert out.columns == ["doc_id", "text", "score", "batch", "size", "shard", "slot"]
    with pytest.raises(ValueError):
        sharding.shuffle_into_shards(odd, 4, columns=("size",))
    sharding.write(out, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == odd.count() and back.select("shard").distinct().count() == 4


def test_no_python_in_the_plan(documents):
    plan = sharding.digest(sharding.shuffle_into_shards(documents))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Broadcast" not in plan.split("Optimized Logical Plan")[1].split("Physical")[0]
