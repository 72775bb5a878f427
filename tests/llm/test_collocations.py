import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from strikeloom.llm import collocations

UPPER = {i: i + 32 for i in range(65, 91)}


def plain(rows, least=30, first=2000):
    """Every phrase of every piece, counted in dictionaries."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in often.items()):
                continue
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r) for r in collocations.mine(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def invented(frame, seed=1, n=400):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "delta", "Épsilon", "zêta", "日本", "eta", "theta", "iota"]
    ends = [" ", " ", "  ", "\t", ", ", ". ", "\n", "! ", " \x0b", ";"]
    texts = ["".join(words[min(int(rng.expovariate(0.5)), 9)] + rng.choice(ends) for _ in range(rng.randrange(60))) for _ in range(n)]
    df = frame([(i, t, None) for i, t in enumerate(texts)])
    langs = {i: (None, "en", "fr", "")[i % 4] for i in range(n)}
    named = df.sparkSession.createDataFrame([(i, v, "x", "x") for i, v in langs.items()], "doc_id long, lang string, phrase string, n string")
    return df.select("doc_id", "text").join(named, "doc_id"), [(langs[i], t) for i, t in enumerate(texts)]


def test_against_dictionaries(frame):
    df, rows = invented(frame)
    want = plain(rows)
    assert len(want) > 40 and mined(df) == want
    assert mined(df, least=5) == plain(rows, 5)
    assert mined(df, first=3) == plain(rows, first=3)


def test_several_tries_give_the_same(frame):
    df, rows = invented(frame, 2, 150)
    assert mined(df, least=10, limit=7) == plain(rows, 10)


def test_long_texts_are_cut_at_piece_ends(frame, monkeypatch):
    df, rows = invented(frame, 3, 40)
    joined = "\n".join(t for _, t in rows) * 3
    monkeypatch.setattr(collocations, "TEXT_BYTES", 200)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([joined])], ["lang", "text"])
    parts = [t[0].as_py() for _, t in collocations.texts(iter([batch]))]
    assert len(parts) > 5 and "".join(parts) == joined and all(p[-1] in ".,;:!?\n\x0b\x0c\r" for p in parts[:-1])
    whole = [t[0].as_py() for _, t in collocations.texts(iter([pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["x " * 900])], ["lang", "text"])]))]
    assert whole == ["x " * 900]


def test_odd_and_empty(odd, empty, frame):
    assert mined(empty) == [] and mined(odd, least=10**6) == []
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    assert mined(odd) == plain(rows)


def test_trie_knows_its_phrases_only():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(300)]
    phrases = sorted({(lang, *(words[j] for j in rng.integers(0, 300, 3))) for lang in ("a", "b", "c") for _ in range(2000)} | {("a", "w1", "w1", w) for w in words})
    trie = collocations.Trie(np.arange(len(phrases)) + 7, pa.array([p[0] for p in phrases]), pa.array([" ".join(p[1:]) for p in phrases]))
    texts = [" ".join(p[1:]) for p in phrases] + ["w1 w2", "w3 nowhere w4", "w1 w1 w1 w2"]
    langs = [p[0] for p in phrases] + ["a", "a", "zz"]
    t = collocations.Text(pa.array(texts))
    got = trie.arrivals(t, pa.array(langs))
    firsts = np.flatnonzero(np.append(True, t.doc[1:] != t.doc[:-1]))
    assert got[firsts].tolist() == list(range(len(phrases))) + [-1, -1, -1]
    wanted = Counter(phrases)
    for i, (lang, text) in enumerate(zip(langs, texts)):
        w = text.split()
        assert wanted[(lang, *w[:3])] == int(got[firsts[i]] >= 0)
