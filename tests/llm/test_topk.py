import math

import numpy as np
import pyarrow as pa

from strikeloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, rank string, score string"


def brute(rows, k):
    vectors = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = set()
    asked = {}
    for i, v in vectors:
        if i % 100 == 0:
            asked[i] = max(asked.get(i, v), v)
    for i, q in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i)[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    return out


def found(df, k=10):
    v = topk.integer_vectors(df)
    return {tuple(r) for r in topk.top_k(v, v.where("vec_id % 100 = 0"), k).collect()}


def test_against_all_products(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=12).astype(np.float32)]) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(300)]  # one very common vector: ties
    rows += [(None, rows[0][1]), (901, None), (902, [None] * 12), (903, [float("nan")] * 12), (904, [float("inf")] * 12), (905, []), (906, [1.0]), (8, rows[8][1])]
    df = spark.createDataFrame([(i, e, "x", "y") for i, e in rows], SCHEMA)
    want = brute(rows, 10)
    assert found(df) == want
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    assert found(df) == want


def test_bounds_leave_every_winner():
    rng = np.random.default_rng(2)
    for spread in (1.0, 0.05):
        x = np.floor(1024 * (np.outer(rng.normal(size=400), [3, -2, 1, 0]) + spread * rng.normal(size=(400, 4))))
        for q in np.floor(1024 * rng.normal(size=(20, 4))):
            for kind in (float, object):
                left = topk.Lists(x.astype(kind)).nra(q.astype(kind), 5, np.zeros(400, bool))
                assert set(np.argsort(-(x @ q), kind="stable")[:5]) <= set(left)


def test_lists_are_read_as_far_as_needed():
    rng = np.random.default_rng(4)
    x = np.floor(1024 * rng.normal(size=(4000, 2)))
    lists = topk.Lists(x)
    left = lists.nra(np.array([900.0, 0.0]), 3, np.zeros(4000, bool))
    assert lists.read == 500 and set(np.argsort(-x[:, 0])[:3]) <= set(left)  # one list of two, one step of eight
    lists.read = 0
    left = lists.nra(np.array([900.0, -300.0]), 3, np.zeros(4000, bool))
    assert lists.read < 8000 / 2 and len(left) <= 48


def test_few_large_and_no_vectors(spark):
    rows = [(0, [2e6, 1.0]), (100, [-2e6, 3.0]), (1, [2e6, 2.5]), (2, [2e6, 2.0])]  # sums beyond 2^53
    large = spark.createDataFrame([(i, e, "", "") for i, e in rows], SCHEMA)
    assert found(large, 2) == brute(rows, 2)
    huge = spark.createDataFrame([(i, [1e15], "", "") for i in (0, 1)], SCHEMA)  # scores stop at the ends of a long
    assert found(huge) == {(0, 1, 1, 2**63 - 1)}
    assert found(spark.createDataFrame([(0, [1.0], "", "")], SCHEMA)) == set()
    assert found(spark.createDataFrame([], SCHEMA)) == set()


def test_queries_read_together(monkeypatch):
    rng = np.random.default_rng(6)
    x, q = np.floor(256 * rng.normal(size=(800, 16))).astype(np.int64), np.floor(256 * rng.normal(size=(60, 16))).astype(np.int64)
    made = []

    class Kept(topk.Lists):
        def __init__(self, x):
            super().__init__(x)
            made.append(self)

    monkeypatch.setattr(topk, "Lists", Kept)
    table = pa.table({"asked": [False] * 800 + [True] * 60, "vec_id": list(range(1, 801)) + list(range(1000, 1060)), "v": pa.array([*x, *q], pa.list_(pa.int64()))})
    found = topk._search(3)(table).to_pydict()
    want = []
    for i, one in enumerate(q):
        scores = x @ one
        want += [(1000 + i, int(r) + 1, int(scores[r])) for r in sorted(range(800), key=lambda r: (-scores[r], r))[:3]]
    assert list(zip(found["query_id"], found["vec_id"], found["score"])) == want
    assert made[0].read <= 2 * x.size  # either end of a list once at most, not once a query
