import math
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strikeloom.llm import queries, toxicity


def quadratic(scores):
    """All maximal segments by their definition: take the best one (the shortest of equal ones), go on left and right of it."""
    best, at = 0, None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > best or s == best and at and b - a < at[1] - at[0]:
                best, at = s, (a, b)
    if at is None:
        return []
    a, b = at
    left = quadratic(scores[:a])
    right = [(x + b, y + b, s) for x, y, s in quadratic(scores[b:])]
    return [*left, (a, b, best), *right]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-3, -2, -1, 1, 2, 4]), max_size=14))
def test_segments(scores):
    found = toxicity.segments(np.array(scores, float))
    want = quadratic(scores)
    assert sorted(s for _, _, s in found) == sorted(s for _, _, s in want)
    assert sum(b - a for a, b, _ in found) <= len(scores)
    for a, b, s in found:
        assert sum(scores[a:b]) == s > 0


def test_gumbel_parameters_are_found_again():
    rng = np.random.default_rng(1)
    n = rng.integers(50, 2000, 4000)
    best = (np.log(0.02 * n) + rng.gumbel(size=4000)) / 1.7
    lam, log_k = toxicity.gumbel(np.maximum(best, 0), np.log(n))
    assert abs(lam - 1.7) < 0.1 and abs(log_k - np.log(0.02)) < 0.3


def test_learns_words_and_beginnings(frame, spark):
    rng = np.random.default_rng(0)
    plain = [f"wort{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows, marks = [], []
    for i in range(400):
        words = list(rng.choice(plain, 60))
        if i % 8 == 0:
            words[5:5] = [str(rng.choice(["trash", "idiot", "scum"])), f"gemein{rng.choice(list('abcdef'))}x"]
        rows.append((i, " ".join(words), "s"))
        marks.append((i, int(i % 8 == 0)))
    docs, labels = frame(rows), spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    new = frame([(1000, "wortak trash gemeinzz wortbl " + " ".join(plain), "s"), (1001, " ".join(plain), "s"), (1002, "", "s"), (1003, None, "s"), (None, "trash idiot", "s")])
    out = {r["doc_id"]: r for r in toxicity.score(new, model).collect()}
    assert out[1000]["score"] > 0.5 > out[1001]["score"] >= out[1002]["score"] == out[1003]["score"]
    a, b = map(int, out[1000]["passages"].split(",")[0].split(":"))
    assert "trash" in "wortak trash gemeinzz wortbl"[a:b]
    kept = toxicity.score(new, model, keep=new.columns)
    assert "text" in kept.columns and kept.where("doc_id = 1000").first()["size"] == "x"


def test_query(spark, sf, documents):
    rows = queries.op4_toxicity(spark, sf).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(labels[r["doc_id"]], r["predicted"]) for r in queries.op4_toxicity(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    caught = sum(p for y, p in out if y == 1) / sum(y for y, _ in out)
    alarms = sum(p for y, p in out if y == 0) / sum(1 - y for y, _ in out)
    assert caught > 0.85 and alarms < 0.01


def test_odd_tables(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(4, 1), (6, 1)], "doc_id long, toxic int")
    for labels in (none, one):
        out = toxicity.score(odd, toxicity.train(odd, labels)).collect()
        assert len(out) == odd.count() and all(r["score"] == 0 for r in out)
    assert toxicity.score(empty, toxicity.train(empty, one)).count() == 0
    both = spark.createDataFrame([(4, 1), (6, 0), (9, 0), (5, 0)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.train(odd, both)).count() == odd.count()


def summed_tail(t, r):
    """P(T_r > t) by summing over T_r = -r ln Gamma(r) + Gamma(r - 1) on a fine grid."""
    w = np.linspace(min(math.log(r) - 12 / math.sqrt(r), -t / r) - 20 / r, math.log(r) + 12 / math.sqrt(r), 40_001)
    p = np.exp(r * w - np.exp(w) - math.lgamma(r)) * (w[1] - w[0])
    z = np.maximum(t + r * w, 0.0)
    log_z = np.log(np.maximum(z, 1e-300))
    q = sum(np.exp(k * log_z - z - math.lgamma(k + 1)) for k in range(r - 1))
    return float((p * np.where(z > 0, q, 1.0)).sum())


def test_tail_of_the_sum_against_integration():
    r = np.array([2, 3, 5, 12, 40, 150])
    mean = np.array([-sum(1 / k for k in range(1, x)) * x + 0.5772156649 * x + x - 1 for x in r])
    for above in (0.5, 2.0, 6.0, 15.0):
        t = mean + above * np.sqrt(2 * r)
        want = np.log([summed_tail(*x) for x in zip(t, r.tolist())])
        assert np.allclose(toxicity.log_tail(t, r), want, atol=0.02), above
    one = toxicity.log_tail(np.array([-3.0, 0.0, 40.0]), np.array([1, 1, 1]))
    assert np.allclose(one, [0.0, math.log(1 - math.exp(-1)), -40.0], atol=1e-8)
    # Far out the tail is that of the known formula.
    t, r = np.full(3, 4e4), np.array([2, 4, 9])
    known = [-x + (k - 1) * math.log(x) - math.lgamma(k + 1) - math.lgamma(k) for x, k in zip(t, r.tolist())]
    assert np.allclose(toxicity.log_tail(t, r), known, atol=0.05)


def test_clean_long_documents_have_no_evidence():
    """Segments by the fitted law: expectations are arrivals of a unit Poisson process up to K n."""
    rng = np.random.default_rng(5)
    zero = np.zeros(1)
    model = toxicity.Model(zero, zero, zero, zero, 0.1, lam=1.3, log_k=math.log(1e-3))
    for tokens in (10_000, 16_000, 100_000, 1_000_000):
        kn = 1e-3 * tokens
        seen = []
        for _ in range(300):
            arrivals = rng.uniform(0, kn, rng.poisson(kn))
            seen.append(toxicity.evidence(model, np.log(kn / arrivals) / model.lam, tokens))
        seen = np.array(seen)
        # Over all r the chance of an evidence above e is at most 2 exp(-e).
        assert np.median(seen) < 1.5 and np.mean(seen > 3) <= 0.1 + 0.06, (tokens, np.median(seen))
        planted = np.append(np.log(kn / arrivals), np.full(60, math.log(kn) + 1.5)) / model.lam
        assert toxicity.evidence(model, planted, tokens) > 40


def test_every_segment_enters_the_evidence():
    zero = np.zeros(1)
    model = toxicity.Model(zero, zero, zero, zero, 0.1)
    some, more = (toxicity.evidence(model, np.full(k, 3.0), 1) for k in (32, 200))
    assert more > 5 * some


def test_a_million_segments_take_linear_time():
    falling = np.tile([1.0, -2.0], 1_000_000)
    start = time.perf_counter()
    assert len(toxicity.segments(falling)) == 1_000_000
    rising = np.tile([2.0, -1.0], 200_000)
    assert toxicity.segments(rising) == [(0, 399_999, 200_001.0)]
    # Rising and falling sums in turn: candidates pile up, join and are given out.
    wave = np.concatenate([np.tile([1.0, -1.5], 50_000), np.tile([2.0, -1.0], 50_000)] * 3)
    assert toxicity.segments(wave)
    assert time.perf_counter() - start < 30
