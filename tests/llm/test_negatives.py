import random

import numpy as np
import pytest
from pyspark.sql import types as T

from strikeloom.llm import negatives

ROWS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("score", T.StringType()), T.StructField("rank", T.StringType()), T.StructField("block", T.StringType()), T.StructField("v", T.StringType())])


@pytest.fixture(scope="module")
def vectors(spark):
    def make(rows):
        return spark.createDataFrame([(i, label, v, "x", "x", "x", "x") for i, label, v in rows], ROWS)

    return make


def plain(rows, positives=5, k=10, scale=256):
    """Every product, sorted."""
    kept = [(i, label, [int(np.floor(x * scale)) for x in v]) for i, label, v in rows
            if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, label, v in kept:
        if i % 100 == 0:
            anchors[i] = max(anchors.get(i, (v, label)), (v, label))
    out = []
    for a, (q, label) in anchors.items():
        scored = sorted(((-sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in kept if i != a))
        near = [(s, i) for s, i, other in scored if other == label][:positives]
        for place, (p, pid) in enumerate(near, 1):
            inside = [(i, -s) for s, i, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p][:k]
            out += [(a, pid, r, i, -p, s, place) for r, (i, s) in enumerate(inside, 1)]
    return sorted(out)


def mined(df, **how):
    rows = negatives.participants(df)
    return sorted(tuple(r) for r in negatives.mine(rows, rows.where("vec_id % 100 = 0"), **how).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank").collect())


def some(n, width, labels, seed=1, levels=None):
    rng = random.Random(seed)
    draw = (lambda: rng.choice(levels)) if levels else (lambda: rng.gauss(0, 0.2))
    return [(i, rng.randrange(labels), [draw() for _ in range(width)]) for i in range(n)]


def test_against_all_products(vectors):
    rows = some(1500, 8, 4)
    want = plain(rows)
    assert want and mined(vectors(rows), block_rows=400, anchor_rows=5) == want
    assert mined(vectors(rows).repartition(3)) == want


def test_many_ties_and_a_hot_label(vectors):
    rows = [(i, 0 if i % 3 else 1 + i % 2, v) for i, _, v in some(900, 4, 3, levels=[-1.0, 0.0, 0.5, 1.0])]
    rows += [(950, 2, [1.0, 0.5, 0.0, 1.0])] * 30  # copies of one row fill no block and count each for itself
    want = plain(rows)
    assert len(want) > 100 and mined(vectors(rows), block_rows=100, anchor_rows=3) == want


def test_lists_are_read_from_favourable_ends_only_as_far_as_needed():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 60, (20_000, 3)).astype(np.int64)
    lists = negatives.Lists(x, np.arange(20_000), np.zeros(20_000), np.ones(20_000))
    q = np.array([200, -150, 0])
    found = lists.search(q, np.ones(20_000, bool), [(None, None), (20_000, 30_000)], 10)
    scores = x @ q
    best = np.lexsort((np.arange(20_000), -scores))
    assert found[0][0].tolist() == best[:10].tolist()
    assert found[1][0].tolist() == [i for i in best.tolist() if 20_000 <= scores[i] <= 30_000][:10]
    assert lists.read < 2 * 20_000 * 0.75  # the list of the zero component is not read, the others not to their end


def test_odd_vectors(vectors):
    nan, inf = float("nan"), float("inf")
    rows = some(300, 3, 2) + [
        (None, 1, [1.0, 1.0, 1.0]), (301, None, [1.0, 1.0, 1.0]), (302, 1, None), (303, 1, [nan, 1.0, 1.0]), (304, 0, [inf, 0.0, 0.0]),
        (305, 0, [None, 1.0, 1.0]), (100, 1, [0.9, 0.9, 0.9]), (400, 0, [0.0, 0.0, 0.0]), (500, 7, [1.0, 2.0, 3.0])]
    assert mined(vectors(rows)) == plain(rows)
    assert mined(vectors([])) == []
    assert mined(vectors([(100, 1, [1.0]), (200, 2, [2.0])])) == []
    # Of different lengths: missing components count as 0.
    assert mined(vectors([(100, 1, [1.0, 1.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.9])])) == [(100, 1, 1, 2, 256 * 256 + 128 * 256, 230 * 256, 1)]


def test_scores_beyond_64_bits(vectors):
    big = 2.0**40
    rows = [(100, 1, [big, big]), (1, 1, [big, big]), (2, 2, [big / 2, big / 2]), (3, 2, [big / 2, big / 2 + 1024])]
    out = mined(vectors(rows))
    assert [(r[1], r[2], r[3]) for r in out] == [(1, 1, 3), (1, 2, 2)] and out[0][4] == 2**63 - 1


def test_labels_move(vectors):
    out = negatives.relabelled(vectors([(7, 9, [1.0]), (8, 9, [1.0]), (None, 3, [1.0]), (14, None, [1.0])])).select("vec_id", "label").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(7, 0), (8, 9), (None, 3), (14, None)], key=str)
