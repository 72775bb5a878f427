import random
from collections import Counter

import numpy as np
import pyarrow as pa

from strikeloom.llm import neardup
from strikeloom.llm.common import utf8
from strikeloom.llm.components import connected


def bag(text):
    w = (text or "").split()
    return Counter([tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def similar(a, b):
    both, every = sum((a & b).values()), sum((a | b).values())
    return both * 5 >= every * 4 and every > 0


def brute(rows):
    """Classes of (id, text) rows by all pairs."""
    ids = [i for i, t in rows if i is not None and bag(t)]
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    bags = [(i, bag(t)) for i, t in rows if i is not None and bag(t)]
    for n, (i, a) in enumerate(bags):
        for j, b in bags[:n]:
            if similar(a, b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return sorted(((i, find(i) if i in label and bag(t) else i) for i, t in rows), key=str)


def found(df, **how):
    return sorted(((r["doc_id"], r["class_id"]) for r in neardup.classes(df, **how).collect()), key=str)


def near_copies(seed, groups, size):
    random.seed(seed)
    rows = []
    for g in range(groups):
        base = [f"v{random.randint(0, 5000)}" for _ in range(random.randint(8, 160))]
        for _ in range(size):
            words = list(base)
            for _ in range(random.choice([0, 0, 1, 2, 3, 6])):
                words[random.randrange(len(words))] = f"n{random.randint(0, 10**6)}"
            rows.append(" ".join(words))
    random.shuffle(rows)
    return list(enumerate(rows))


def test_all_links_are_found(frame, monkeypatch):
    rows = near_copies(1, 25, 9) + [(900 + i, "a b c d e " * (3 + i)) for i in range(12)]
    assert found(frame([(i, t, "s") for i, t in rows])) == brute(rows)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    assert found(frame([(i, t, "s") for i, t in rows])) == brute(rows)


def test_links_behind_names_that_agree_by_chance(frame, monkeypatch):
    """With names of one bit nearly every pair of a set looks like a link and fails its verification."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(8)
    rows = []
    for g in range(3):
        base = [f"g{g}_{i}" for i in range(120)]
        for c in range(9):  # members share the base for 0.8 with the least one only, or are copies of each other
            words = list(base)
            for k in range(c // 3 * 2):
                at = rng.randrange(0, 110, 10)
                words[at:at + 2] = [f"c{g}_{c // 3}_{k}_{i}" for i in range(2)]
            words[rng.randrange(120)] = f"n{g}_{c}"
            rows.append(" ".join(words))
    rows = list(enumerate(rows))
    assert found(frame([(i, t, "s") for i, t in rows]), name_bits=1) == brute(rows)


def test_an_id_with_several_texts_joins_their_classes(frame):
    base = [f"w{i}" for i in range(100)]
    one, two = " ".join(base), " ".join(f"z{i}" for i in range(100))
    near = " ".join([*base[:50], "other", *base[51:]])
    for first, second in ((one, two), (two, one)):
        rows = [(3, first), (3, second), (7, one), (9, near)]
        assert found(frame([(i, t, "s") for i, t in rows])) == brute(rows) == [(3, 3), (3, 3), (7, 3), (9, 3)]
    rows = [(3, two), (7, one), (9, near), (8, two), (8, near), (2, "")]
    assert found(frame([(i, t, "s") for i, t in rows])) == brute(rows)


def test_words_that_collide_under_sums_of_powers(frame):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    twin = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} b c d e"), (2, f"{twin} b c d e"), (3, f"{word} b c d e")]
    assert found(frame([(i, t, "s") for i, t in rows])) == brute(rows) == [(1, 1), (2, 2), (3, 1)]


def test_real_documents(documents):
    assert found(documents) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_odd_documents(odd, empty):
    assert found(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert found(empty) == []
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([None, None, 1, 2, 3, 4, 6, 8, 9], key=str)
    assert neardup.keep_one(empty).count() == 0


def test_signatures_estimate_weighted_similarity_without_bias():
    rng = np.random.default_rng(2)
    hits, expected = [], []
    for _ in range(300):
        names = np.sort(rng.integers(1, 2**63, 12).astype(np.uint64))
        a, b = rng.integers(0, 7, 12), rng.integers(0, 7, 12)
        a[0] = b[0] = 3
        sig = [neardup.signatures(np.zeros((w > 0).sum(), np.int64), names[w > 0], w[w > 0], 1, 512)[0] for w in (a, b)]
        hits.append((sig[0] == sig[1]).mean())
        expected.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(hits) - np.mean(expected)) < 0.01
    assert np.corrcoef(hits, expected)[0, 1] > 0.9


def test_bags_count_shingles():
    texts = ["a b c d e f", "a b", "", None, "x x x x x x x x"]
    owner, _, counts = neardup.bags(*utf8(pa.array(texts)))
    assert [sorted(counts[owner == i].tolist()) for i in range(5)] == [[1, 1], [1], [], [], [4]]


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 1), (20, 21), *((100 + i, 101 + i) for i in range(40))]
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 8, 9, 10], 1), 20: 20, 21: 20, **dict.fromkeys(range(100, 141), 100)}


def test_links_of_many_stars_are_thinned_to_about_one_a_node(spark):
    from strikeloom.llm import neardup

    links = [(a, b) for b in range(100, 400) for a in range(10) if (a + b) % 3] + [(a, b) for a in (50, 51) for b in (60, 61, 62)] + [(70, 71)]
    frame = spark.createDataFrame(links, "a long, b long")
    thin = neardup.thinned(frame)
    assert thin.count() < 400 < len(links)

    def parts(df):
        return {(r["node"], r["label"]) for r in connected(df).collect()}

    assert parts(thin) == parts(frame)
