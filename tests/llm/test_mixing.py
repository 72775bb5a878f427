import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from strikeloom.llm import mixing


def targets(sizes: dict) -> dict:
    """Share out all words by weight, stop at three times a source's words, share the excess again, until none is above."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return stopped | {s: left * weight[s] / w for s in free}
        stopped |= {s: 3.0 * sizes[s] for s in over}


def check(df):
    rows = mixing.mix_sources(df).collect()
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        sizes[r["source"]] += r["size"]
    want = targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
        assert math.floor(r["rate"]) <= r["copies"] <= min(3, math.floor(r["rate"]) + 1)
    return rows


def test_targets_and_copies(documents):
    rows = check(documents)
    taken, target = sum(r["size"] * r["copies"] for r in rows), sum(r["size"] for r in rows)
    assert abs(taken / target - 1) < 0.3


def test_hot_small_and_odd_sources(frame, odd, empty):
    rows = [(i, "a b c d " * (1 + i % 7), "hot" if i % 3 else f"s{i % 40:02d}") for i in range(1200)]
    out = check(frame(rows))
    by = defaultdict(lambda: [0, 0.0])
    for r in out:
        by[r["source"]][0] += r["size"] * r["copies"]
        by[r["source"]][1] = r["target"]
    assert abs(by["hot"][0] / by["hot"][1] - 1) < 0.1
    check(odd)
    assert mixing.mix_sources(empty).count() == 0


def test_reruns_agree_and_copies_are_emitted(documents):
    mixed = mixing.mix_sources(documents)
    a = {(r["doc_id"], r["copies"]) for r in mixed.collect()}
    assert a == {(r["doc_id"], r["copies"]) for r in mixing.mix_sources(documents.repartition(7)).collect()}
    emitted = {r["doc_id"]: r["n"] for r in mixing.emit(mixed, documents.columns).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert emitted == {d: c for d, c in a if c}
