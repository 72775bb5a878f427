import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strikeloom.llm import pii

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
            good = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0, 10 <= len(digits) <= 15)
            if good[kind]:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=list("ab1234567890.@+- ()%_\n日"), max_size=60))
def test_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_pattern_examples():
    for text in ("x@y@z.com a@b.c@d.e @a.b", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (826) 555-4081 190.137.223.204", "+12 34", "9" * 5000 + "." * 3 + "a" * 5000):
        assert pii.base_spans(text) == brute(text)


def model(rng, labels=3):
    m = pii.Field({}, np.zeros((0, labels)), rng.normal(size=(labels, labels)))
    return m


def test_viterbi_and_pinning_against_all_labellings():
    rng = np.random.default_rng(4)
    for _ in range(40):
        m = model(rng)
        scores = rng.normal(size=(6, 3))
        scores[:, 0] += rng.integers(0, 5, 6)

        def value(y, s=scores):
            path = [0, *y, 0]
            return sum(s[i, k] for i, k in enumerate(y)) + sum(m.moves[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(3), repeat=6), key=value)
        got = pii.viterbi(scores, np.array([6]), m.moves)
        assert np.isclose(value(got), value(best))
        pinned = m.pinned(scores)
        assert all(best[i] == 0 for i in np.flatnonzero(pinned))
        # Cut at the pinned words, the runs between give the same labels.
        labels, keep = np.zeros(6, int), np.flatnonzero(~pinned)
        if keep.size:
            runs = np.split(keep, np.flatnonzero(np.diff(keep) > 1) + 1)
            labels[keep] = pii.viterbi(scores[keep], np.array([len(r) for r in runs]), m.moves)
        assert np.isclose(value(labels), value(best))


def test_training_gradient_fits_the_labels_and_generalises(documents):
    field = pii.train(pii.weak_labels(documents))
    found = {}
    for text in ("call (826) 555-4081 now", "host 300.1.2.3 is", "the cat sat on the mat."):
        w = pii.words_of(pa.array([text]))
        found[text] = [(text[a:b], pii.KINDS[k]) for a, b, k in pii._field_spans(w, field).get(0, [])]
    assert found["the cat sat on the mat."] == []
    # Words that the patterns label are found again by the field.
    hits = total = 0
    for d in documents.collect():
        w = pii.words_of(pa.array([d["text"]]))
        mine = pii._field_spans(w, field).get(0, [])
        for a, b, _ in pii.base_spans(d["text"]):
            total += 1
            hits += any(x < b and y > a for x, y, _ in mine)
    assert total == 0 or hits >= 0.8 * total


def test_query_columns(documents, odd, empty):
    for df in (documents, odd):
        texts = df.select("doc_id", "text").collect()
        field = pii.train(pii.weak_labels(df))
        rows = pii.digest(pii.find(df, field)).collect()
        want = sorted(((d["doc_id"], brute(d["text"] or "")) for d in texts), key=str)
        got = sorted(rows, key=lambda r: str((r["doc_id"], [])) + r["base_sha256"])
        listed = {(i, hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()): spans for i, spans in want}
        assert len(rows) == len(texts)
        for r in got:
            spans = listed[r["doc_id"], r["base_sha256"]]
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == i for s in spans) for i in range(4)]
            assert {f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in spans} <= set(filter(None, r["spans"].split(",")))
    assert pii.digest(pii.find(empty, pii.train(pii.weak_labels(empty)))).count() == 0


def test_masking(frame):
    docs = frame([(1, "mail a@b.cc and +1 (017) 555-7713 ok", "s"), (2, None, "s"), (3, "plain", "s")])
    out = {r["doc_id"]: r for r in pii.masked(pii.find(docs, None, keep=docs.columns)).collect()}
    assert out[1]["text"] == "mail [EMAIL] and [PHONE] ok" and out[1]["n_chars"] == len(out[1]["text"])
    assert out[2]["text"] is None and out[3]["text"] == "plain" and out[3]["size"] == "x"
    assert pii.mask("abcdef", [(0, 3, 2), (2, 5, 3)]) == "[CARD]f"


def test_shapes_cover_whole_words():
    long = "x" * 400 + "@" + "y" * 300 + "12345678"
    assert pii.shape(long) == ("x@xd5", "x@xd") and pii.shape("a-" * 200 + "7")[0].endswith("x-d1")
