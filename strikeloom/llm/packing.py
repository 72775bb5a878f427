"""Packing token sequences by order-preserving dynamic programming.

The documents of a partition keep their order and form one stream of tokens. A cut may
fall at a document end (free), at a sentence end (``SENTENCE_COST``) or, inside long
stretches without either, at evenly spaced hard places (``HARD_COST``). Over the cut
places p_0 < p_1 < ... the programme is

    f(j) = cost(j) + min over i with p_j - p_i <= length of  f(i) + padding(p_j - p_i)

Padding is ``length - (p_j - p_i)``, so the minimum is one of f(i) + p_i over a sliding
window: a monotone queue answers it in constant time. A window whose size is one of
``SHORT`` (powers of two) needs no padding and costs ``SHORT_COST`` instead.

A partition is worked through in blocks of ``BLOCK_TOKENS``; the last window of a block
is left open and goes on in the next, so only the end of a partition pads freely.
Nothing is shuffled, and a retried task reads the same rows in the same order.

Defined cases: null text counts as empty, and an empty document is its end token alone;
null ids stay null; repeated rows are packed as often as they occur; a document longer
than a window is cut into several pieces; no rows give no sequences.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strikeloom.llm.common import passes, tidy
from strikeloom.llm.tokens import Tokens

LENGTH = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 18
SENTENCE_COST, HARD_COST, SHORT_COST = 16, 64, 24
SHORT = (256, 512, 1024)
#: A stretch without a sentence end that is longer than this gets hard places at this distance.
HARD_EVERY = 256

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cut string"


def cut_places(ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, ascending from 0, and what each costs."""
    soft = np.union1d(np.union1d(ends, sentences), [0])
    gaps = np.diff(soft)
    wide = np.flatnonzero(gaps > HARD_EVERY)
    hard = [np.arange(soft[i] + HARD_EVERY, soft[i + 1], HARD_EVERY) for i in wide]
    places = np.union1d(soft, np.concatenate(hard)) if hard else soft
    cost = np.full(places.size, HARD_COST, np.int64)
    cost[np.searchsorted(places, soft)] = SENTENCE_COST
    cost[np.searchsorted(places, ends)] = 0
    cost[0] = 0
    return places, cost


def best_cuts(places: np.ndarray, cost: np.ndarray, length: int = LENGTH, short=SHORT) -> list[int]:
    """Indexes into ``places`` of the cheapest chain of cuts from the first to the last."""
    n = len(places)
    # For every place, the places that lie exactly a short length before it.
    jumps: dict[int, list[int]] = {}
    for size in short:
        at = np.searchsorted(places, places - size)
        hit = np.flatnonzero(places[np.minimum(at, n - 1)] == places - size)
        for j, i in zip(hit.tolist(), at[hit].tolist()):
            jumps.setdefault(j, []).append(i)
    p, c = places.tolist(), cost.tolist()
    f, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0 + p[0], 0)])
    for j in range(1, n):
        here = p[j]
        while p[queue[0][1]] < here - length:
            queue.popleft()
        value, i = queue[0]
        value += length - here
        for k in jumps.get(j, ()):
            if f[k] + SHORT_COST < value:
                value, i = f[k] + SHORT_COST, k
        value += c[j]
        f[j], back[j] = value, i
        value += here
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    chain, j = [], n - 1
    while j:
        chain.append(j)
        j = back[j]
    return chain[::-1]


class _Stream:
    """Documents of one partition that are not packed yet."""

    def __init__(self, part: int, sentence_end: np.ndarray, length: int, short):
        self.docs: list[tuple[object, np.ndarray, int]] = []  # id, all ids, how many of them are packed
        self.waiting, self.next, self.part, self.sentence_end, self.length, self.short = 0, 0, part, sentence_end, length, short

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, ids, 0))
        self.waiting += len(ids)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        stream = np.concatenate([ids[done:] for _, ids, done in self.docs])
        sizes = np.array([len(ids) - done for _, ids, done in self.docs])
        ends = np.cumsum(sizes)
        sentences = np.flatnonzero(self.sentence_end[stream]) + 1
        places, cost = cut_places(ends, sentences)
        chain = best_cuts(places, cost, self.length, self.short)
        if not last:
            chain = chain[:-1]
        kinds = {0: "document", SENTENCE_COST: "sentence", HARD_COST: "hard"}
        at, d, begin = 0, 0, 0  # begin: where document d starts in the stream
        for j in chain:
            end, offset, sequence = int(places[j]), 0, (self.part << 40) | self.next
            self.next += 1
            while at < end:
                doc_id, ids, done = self.docs[d]
                stop = min(end, int(ends[d]))
                if stop > at:
                    piece = stream[at:stop]
                    yield doc_id, done + at - begin, stop - at, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), sequence, offset, kinds[int(cost[j])]
                    offset += stop - at
                    at = stop
                if stop == int(ends[d]):
                    begin, d = int(ends[d]), d + 1
        left = self.docs[d:]
        if left:
            doc_id, ids, done = left[0]
            left[0] = (doc_id, ids, done + at - begin)
        self.docs = left
        self.waiting = sum(len(ids) - done for _, ids, done in left)


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, ranks: str | None = None, short=SHORT) -> DataFrame:
    """One row per piece: which tokens of which document lie where in which sequence."""
    columns = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = pa.schema([(c, pa.string() if c == "cut" else pa.int64()) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(tokenizer, ranks)
        stream = _Stream(TaskContext.get().partitionId(), tokens.sentence_ends(), length, short)

        def rows(found) -> Iterator[pa.RecordBatch]:
            found = list(found)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds.types)], schema=kinds)

        for batch in passes(batches, limit=4 << 20):  # the piece table is sorted once a pass
            flat, offsets = tokens.encode(batch.column(1))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                stream.add(doc_id, np.append(flat[offsets[i]:offsets[i + 1]], np.uint16(END_ID)))
                if stream.waiting >= BLOCK_TOKENS:
                    yield from rows(stream.flush(False))
        yield from rows(stream.flush(True))

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(tidy(run), SCHEMA)
