import math

import numpy as np
import pyarrow as pa

from strikeloom.llm import queries, resampling


def test_keeps_good_documents(spark, sf):
    chosen = {r["doc_id"] for r in queries.op5_quality_resampling(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r["doc_id"] in chosen for r in labels if r["quality"] == 1]
    bad = [r["doc_id"] in chosen for r in labels if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_weights_against_loops(documents):
    good = documents.where("doc_id % 3 = 0").select("doc_id")
    ratios = resampling.log_ratios(documents, good)
    raw, target = np.zeros(1 << resampling.BITS), np.zeros(1 << resampling.BITS)
    rows = documents.collect()
    grams = {}
    for r in rows:
        b, _ = resampling.ngrams(pa.array([r["text"]]))
        words = r["text"].split()
        assert len(b) == max(0, 2 * len(words) - 1)
        grams[r["doc_id"]] = b
        np.add.at(raw, b, 1)
        if r["doc_id"] % 3 == 0:
            np.add.at(target, b, 1)
    prior = (raw + 1) / (raw.sum() + raw.size)
    want = np.log(target + raw.size * prior) - np.log(target.sum() + raw.size) - np.log(raw + raw.size * prior) + np.log(raw.sum() + raw.size)
    assert np.allclose(ratios, want)
    for effective in (None, 100):
        for r in resampling.weigh(documents, ratios, effective=effective).collect():
            b = grams[r["doc_id"]]
            assert math.isclose(r["log_weight"], want[b].mean() * min(len(b), effective or len(b)), abs_tol=1e-9)


def test_kth_key(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(int(i), float(x)) for i, x in enumerate(np.concatenate([rng.normal(size=700), np.repeat(1.25, 300), [1e9, -1e9]]))] + [(None, 1.25)]
    df = spark.createDataFrame(rows, "doc_id long, key double")
    order = sorted(rows, key=lambda r: (-r[1], math.inf if r[0] is None else r[0]))
    for few in (4096, 20):
        monkeypatch.setattr(resampling, "FEW", few)
        for k in (1, 2, 50, 260, 300, 999):
            assert resampling.kth(df, k) == (order[k - 1][1], order[k - 1][0])
    assert resampling.kth(df, len(rows)) is None and resampling.kth(df, 0) is None


def test_gumbel_draws_by_weight(spark):
    """Of two documents, the one with twice the weight comes first in two of three draws."""
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    ratios = np.zeros(1 << resampling.BITS)
    ratios[resampling.ngrams(pa.array(["b"]))[0]] = math.log(2)
    first = 0
    for seed in range(60):
        keys = {r["doc_id"]: r["key"] for r in resampling.weigh(df, ratios, seed).collect()}
        first += keys[2] > keys[1]
    assert 27 <= first <= 53


def test_odd_documents(odd, empty):
    none = odd.limit(0).select("doc_id")
    assert resampling.resample(odd, none, 100).count() == odd.count()
    assert resampling.resample(odd, odd.select("doc_id"), 0).count() == 0
    rows = resampling.resample(odd, odd.select("doc_id"), 3).collect()
    assert 3 <= len(rows) <= 4 and all(r["log_weight"] > resampling.EMPTY for r in rows)
    assert resampling.resample(empty, none, 5).count() == 0
