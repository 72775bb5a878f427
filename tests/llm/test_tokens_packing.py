import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strikeloom.llm import packing
from strikeloom.llm.tokens import Tokens

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
FAST = Tokens()


def ids(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=list("ab'stlrevmd1²2.!? \n\t\r éßŁ—’_<|>́日🙂"), max_size=40), max_size=4))
def test_ids_are_those_of_the_tokenizer(texts):
    flat, offsets = FAST.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert flat[offsets[i]:offsets[i + 1]].tolist() == ids(text)


def test_special_strings_and_whole_documents(documents):
    texts = ["a<|endoftext|>b", None, "", "don't I'LL 'tis o''clock '", *[r["text"] for r in documents.limit(60).collect()]]
    flat, offsets = FAST.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert flat[offsets[i]:offsets[i + 1]].tolist() == ids(text)


def cheapest(places, cost, length, short):
    """The programme without a queue."""
    best = [0] + [None] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            size = int(places[j] - places[i])
            if size <= length:
                value = best[i] + cost[j] + (packing.SHORT_COST if size in short else length - size)
                value = min(value, best[i] + cost[j] + length - size)
                best[j] = value if best[j] is None else min(best[j], value)
    return best[-1]


def test_queue_finds_the_cheapest_cuts():
    random.seed(3)
    for _ in range(60):
        places = np.array([0, *sorted(random.sample(range(1, 400), 30))])
        places = np.unique(np.concatenate([places, np.arange(0, places[-1], 40)]))
        cost = np.array([0, *(random.choice([0, 16, 64]) for _ in places[1:])])
        chain = packing.best_cuts(places, cost, 64, (16, 32))
        steps = [0, *chain]
        value = sum(int(cost[j]) + min([64 - int(places[j] - places[i])] + [packing.SHORT_COST] * (int(places[j] - places[i]) in (16, 32))) for i, j in zip(steps, steps[1:]))
        assert value == cheapest(places, cost, 64, (16, 32))


def check(rows, docs):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for d in docs:
        want[d["doc_id"]].append(ids(d["text"]) + [packing.END_ID])
    assert set(pieces) == set(want)
    for doc, texts in want.items():
        total = sum(p["length"] for p in pieces[doc])
        assert total == sum(map(len, texts))
        if len(texts) == 1:
            at = 0
            for p in sorted(pieces[doc], key=lambda p: p["start"]):
                assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(texts[0])
                part = np.array(texts[0][at:at + p["length"]], "<u4")
                assert zlib.crc32(part.tobytes()) == p["ids_crc32"]
                at += p["length"]
    padding = 0
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.LENGTH
        padding += 0 if at & (at - 1) == 0 else packing.LENGTH - at
    return padding, sum(r["length"] for r in rows)


def test_packs_whole_documents_with_little_padding(documents):
    padding, tokens = check(packing.pack(documents).collect(), documents.collect())
    assert padding < 0.03 * tokens


def test_odd_documents(odd, empty):
    check(packing.pack(odd).collect(), odd.collect())
    assert packing.pack(empty).count() == 0


def test_blocks_and_order(frame, monkeypatch):
    docs = frame([(i, "Some words here. And more of them! " * (i % 50), "s") for i in range(300)]).coalesce(1)
    rows = packing.pack(docs).collect()
    padding, tokens = check(rows, docs.collect())
    assert padding < 0.02 * tokens
    order = [(r["sequence_id"], r["offset"]) for r in rows]
    assert order == sorted(order)
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in rows)


def test_pieces_of_one_name_are_told_apart(monkeypatch):
    one, two = "ab" * 8, "ba" * 8
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), one, two, f"{one} {two}", "plain words here"]
    fast = Tokens()
    for again in range(2):  # as new pieces, then as known ones
        flat, offsets = fast.encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ids(t) for t in texts]
    worst = Tokens()
    monkeypatch.setattr(worst, "piece_names", lambda points, starts, lengths: np.zeros(starts.size, np.uint64))
    flat, offsets = worst.encode(pa.array(texts))
    assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ids(t) for t in texts]
