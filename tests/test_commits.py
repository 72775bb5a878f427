"""Keyed tables by commits, digests of large files, and listing of archive folders."""

import datetime
import hashlib
import os

import pandas as pd
import pytest

from strikeloom.sources import archive, commits, sinks

KEYED = "k int, v string"


def held(spark, path):
    return {r["k"]: r["v"] for r in commits.read(spark, path, KEYED).collect()}


def folders(path):
    return sorted(os.listdir(f"{path}/data"))


def test_insert_only_never_overwrites(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert commits.read(spark, path, KEYED).count() == 0
    assert commits.append(spark.createDataFrame([(1, "old"), (2, "old")], KEYED), path, ["k"]) == (2, 1)
    new = spark.createDataFrame([(2, "new"), (3, "new"), (3, "again")], KEYED)
    assert commits.append(new, path, ["k"]) == (1, 2)
    now = held(spark, path)
    assert now[1] == now[2] == "old" and now[3] in ("new", "again") and len(now) == 3
    assert commits.append(new, path, ["k"]) == (0, 2) and len(folders(path)) == 2


def test_two_writers_with_one_key_leave_one_row(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    commit, other = commits._commit, []

    def slow(*args):
        if not other:  # another writer commits between this one's look at the table and its commit
            other.append(True)
            commits.append(spark.createDataFrame([(1, "other"), (2, "other")], KEYED), path, ["k"])
        return commit(*args)

    monkeypatch.setattr(commits, "_commit", slow)
    assert commits.append(spark.createDataFrame([(1, "mine"), (3, "mine")], KEYED), path, ["k"]) == (1, 2)
    assert held(spark, path) == {1: "other", 2: "other", 3: "mine"} and len(folders(path)) == 2


def test_a_failed_load_leaves_no_trace(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    commits.append(spark.createDataFrame([(1, "old")], KEYED), path, ["k"])
    with monkeypatch.context() as m:
        m.setattr(commits, "insert_only", lambda new, old, keys: new)  # lets repeated keys through
        with pytest.raises(ValueError):
            commits.append(spark.createDataFrame([(4, "a"), (4, "b")], KEYED), path, ["k"])
        with pytest.raises(ValueError):
            commits.append(spark.createDataFrame([(1, "a")], KEYED), path, ["k"])
    # A writer that dies before its commit leaves files that no reader follows.
    spark.createDataFrame([(9, "dead")], KEYED).write.parquet(f"{path}/data/dead")
    assert held(spark, path) == {1: "old"} and len(folders(path)) == 2


def test_digests_of_files_beyond_two_gigabytes(tmp_path):
    size = (2 << 30) + 5
    with open(f"{tmp_path}/big.parquet", "wb") as f:
        f.truncate(size)
    want = hashlib.sha256()
    for _ in range(2 << 30 >> 24):
        want.update(bytes(1 << 24))
    want.update(bytes(5))
    row = next(sinks._digests(iter([pd.DataFrame({"path": [f"file:{tmp_path}/big.parquet"]})]))).iloc[0]
    assert row["sha256"] == want.hexdigest() and row["byte_size"] == size and pd.isna(row["row_count"])


def test_manifest_is_verified_against_the_source(spark, tmp_path):
    path = f"{tmp_path}/out"
    rows = spark.createDataFrame([(i % 3, datetime.datetime(2024, 1, 1 + i // 24, i % 24)) for i in range(30)], "part int, ts timestamp")
    rows.write.partitionBy("part").parquet(path)
    read = spark.read.parquet(path)
    more = rows.unionByName(rows.where("part = 1").limit(1))  # the source has a row the export lacks
    found = sinks.export_manifest(spark, path, "T0", sinks.verify_export(more, read, "part", "ts"), "part", r"part=(\d+)").collect()
    assert {r["part"]: r["verified"] for r in found} == {0: True, 1: False, 2: True}
    for r in found:
        with open(r["file_path"], "rb") as f:
            content = f.read()
        assert r["sha256"] == hashlib.sha256(content).hexdigest() and r["byte_size"] == len(content)
    assert sum(r["row_count"] for r in found) == 30
    assert not any(r["verified"] for r in sinks.export_manifest(spark, path, "T0").collect())


def test_only_wanted_folders_are_listed(spark, tmp_path):
    for ticker in ("AAA", "bb", "C*"):
        for year in ("2020", "2021"):
            spark.range(3).selectExpr("id AS x" if year == "2020" else "CAST(id AS DOUBLE) AS x").write.parquet(f"{tmp_path}/a/ticker={ticker}/year={year}")
    root = f"{tmp_path}/a"
    assert archive.folders(root, ["aa"], [2020]) == [f"{root}/ticker=[Aa][Aa]/year=2020*"]
    listed = {(r["ticker"], r["year"]) for r in archive.list_files(spark, root, ["aaa", "c*"], [2021]).collect()}
    assert listed == {("AAA", "2021"), ("C*", "2021")}
    assert archive.list_files(spark, root, ["none"]).count() == 0
    assert archive.scan(spark, root, {"x": "double"}, ["BB"]).count() == 6
    with pytest.raises(ValueError):
        archive.scan(spark, root, {"x": "double"}, years=[1999])
