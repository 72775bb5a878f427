import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strikeloom.llm import substring


def brute(docs, window):
    """Definition of the result, on (id, text) rows."""
    rows = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least = {}
    for i, w in rows:
        for p in range(len(w) - window + 1):
            key = tuple(w[p:p + window])
            least[key] = min(least.get(key, float("inf")), float("inf") if i is None else i)
    out = []
    for i, w in rows:
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p:p + window])] < (float("inf") if i is None else i):
                gone |= set(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def found(df, window=13, rounds=2):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in substring.remove_repeats(df, window, rounds).collect()), key=str)


def test_planted_runs_and_periods(frame, monkeypatch):
    monkeypatch.setattr(substring, "BATCH_DOCS", 20)
    random.seed(5)
    few, many = "ab", [f"w{i}" for i in range(400)]
    shared = [[random.choice(many) for _ in range(random.randint(13, 40))] for _ in range(12)] + [["x"] * 30, ["x", "y"] * 20]
    rows = []
    for i in range(150):
        words = [random.choice(few if i % 5 == 0 else many) for _ in range(random.randint(0, 60))]
        for _ in range(random.randint(0, 3)):
            at = random.randint(0, len(words))
            words[at:at] = random.choice(shared)
        rows.append((i, " ".join(words) if i % 2 else "\n".join(words), "s"))
    rows += [(None, rows[3][1], "s"), (None, rows[3][1], "s"), (7, rows[7][1], "s"), (8, rows[9][1], "s"), (-5, rows[11][1], "s")]
    for window in (13, 5):
        assert found(frame(rows), window) == brute([(i, t) for i, t, _ in rows], window)
    assert found(frame(rows), 13, 3) == brute([(i, t) for i, t, _ in rows], 13)


def test_real_documents(documents):
    assert found(documents) == brute([(r["doc_id"], r["text"]) for r in documents.collect()], 13)


def test_odd_documents(odd, empty):
    assert found(odd) == brute([(r["doc_id"], r["text"]) for r in odd.collect()], 13)
    assert found(empty) == []


def test_symbols_depend_on_their_reach_only():
    """A window's chosen symbol is the same wherever the window occurs."""
    rng = np.random.default_rng(3)
    for alphabet in (2, 3, 30):
        base = rng.integers(0, alphabet, 40).astype(np.uint64)
        names = {}
        for _ in range(12):
            row = np.concatenate([rng.integers(0, alphabet, rng.integers(0, 9)).astype(np.uint64), base, rng.integers(0, alphabet, rng.integers(0, 9)).astype(np.uint64)])
            windows = np.arange(len(row) - 12)
            chosen = substring.choose(substring.levels(row, np.array([0, len(row)])), (row % 7 + 1).astype(np.int64), windows, 13)
            for p in windows:
                assert names.setdefault(tuple(row[p:p + 13]), chosen[p]) == chosen[p]


def thue_morse(n, a="a", b="b"):
    word = a
    while len(word) < n:
        word += word.translate(str.maketrans(a + b, b + a))
    return word


def test_words_that_collide_under_sums_of_powers(frame):
    """Sums of letters times powers of an odd base are equal for a Thue-Morse word and its complement."""
    for n in (1024, 2048):
        one, two = thue_morse(n), thue_morse(n, "b", "a")
        twelve = " ".join(f"w{i}" for i in range(12))
        rows = [(1, f"{twelve} {one}", "s"), (2, f"{twelve} {two}", "s"), (3, f"x {twelve} {one} y", "s")]
        assert found(frame(rows)) == brute([(i, t) for i, t, _ in rows], 13)


def locally(rows, batches, window=13, ranges=3):
    """The three rounds without Spark, so that parts of them can be replaced."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("batch", pa.int64())])
    tables = [pa.table({"doc_id": [i for i, _ in part], "text": [t for _, t in part], "batch": [k] * len(part)}, schema=schema) for k, part in enumerate(rows[k::batches] for k in range(batches))]

    def answers(round_no, packed):
        table = pa.concat_tables(packed)
        found = [substring._gather(round_no)(table.filter(pc.equal(table["range"], r))) for r in sorted(set(table["range"].to_pylist()))]
        return pa.concat_tables(found)

    def mine(table, k):
        return table.filter(pc.equal(table["batch"], k))

    one = answers(1, [substring._symbols(window, 2, ranges)(t) for t in tables])
    two = answers(2, [substring._windows(window, 2, ranges)(t, mine(one, k)) for k, t in enumerate(tables)])
    both = pa.concat_tables([one, two])
    out = [substring._remove(window, 2, ranges, True)(t, mine(both, k)) for k, t in enumerate(tables)]
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept")) for t in out for r in t.to_pylist()), key=str)


def test_symbols_of_one_name_change_no_result(monkeypatch):
    """Symbols select windows; their words decide."""
    rows = [(i, " ".join(f"w{(i * j) % 7}" for j in range(40))) for i in range(30)]
    assert locally(rows, 4) == brute(rows, 13)
    monkeypatch.setattr(substring, "choose", lambda stack, sizes, windows, window: np.zeros(windows.size, np.uint64))
    assert locally(rows, 4) == brute(rows, 13)


def test_batches_are_bounded_by_bytes_and_copies_are_spread(frame, monkeypatch):
    monkeypatch.setattr(substring, "BATCH_BYTES", 2000)
    rows = [(i % 3, " ".join(f"w{i % 5}_{j}" for j in range(60)), "s") for i in range(80)] + [(5, " ".join(f"c{j}" for j in range(50)), "s")] * 40
    assert found(frame(rows)) == brute([(i, t) for i, t, _ in rows], 13)
