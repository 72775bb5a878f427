"""Repeated word sequences by recompression.

A document is a row of word names (64-bit fingerprints, so equal words have equal names
in every task). A recompression round renames it twice: a run of one name becomes one
symbol, then neighbours of which the first is a left and the second a right name (by one
bit of the name) become one symbol. A name is a fingerprint of what it stands for, so the
rounds name runs and pairs globally and equal substrings get equal symbols inside; only
near their ends symbols depend on what lies outside. For every symbol the words that its
existence depends on are carried along (its reach): a window that holds the whole reach
of a symbol has that symbol wherever the window occurs.

Spark rounds:

1. Each window of ``window`` words chooses one symbol that it determines, the one with the
   most letters. The chosen symbols are gathered by name; those of at least two
   documents are shared. A window whose symbol is not shared occurs in one document only.
2. Windows with a shared symbol are verified by their words: the 128-bit digests of the very
   words (joined by one space) are gathered and the least document of each is found.
   Symbols only select windows, so two symbols of one name cost a verification and
   change no result.
3. Words covered by a window that also starts in a smaller document are removed.

Documents travel once, in batches of about ``BATCH_BYTES`` or ``BATCH_DOCS`` rows; all three
rounds read that exchange. Rounds 1 and 2 send one packed row per (batch, name range)
instead of a row per symbol: a name once per batch, with the least and greatest document there, so a name
that occurs everywhere costs one entry per batch. Answers are one bit per entry. What a
batch has found out is handed to its next round: which window chose which entry, then
which windows were verified, so the symbols are made once.

Defined cases: null and empty texts have no words; a document of fewer words than a window
has none; a window that repeats inside one document, or in rows of the same id, is no
repeat; a null id is larger than any other; repeated rows each get a result, and are dealt
over the batches like other rows; a very long text is one batch; no rows give
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeloom.llm.common import combine, mix, utf8, word_names, words

WINDOW = 13
ROUNDS = 2
#: Rows and bytes of text in a batch, on average, whichever is reached first.
BATCH_DOCS, BATCH_BYTES = 1000, 4 << 20
#: Name ranges per batch, as a share of the number of batches.
RANGE_SHARE = 4
NO_ID = np.iinfo(np.int64).max


@dataclass
class Symbols:
    """One level: names, the words [start, end) they stand for and their reach [low, high)."""

    names: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # whether a document starts here


def _last(first: np.ndarray) -> np.ndarray:
    return np.append(first[1:], True) if first.size else first


def name_runs(s: Symbols, level: int) -> Symbols:
    """Runs of one name become one symbol; what borders a run decides that it ends there."""
    n = s.names.size
    if not n:
        return s
    new = s.first.copy()
    new[1:] |= s.names[1:] != s.names[:-1]
    at = np.flatnonzero(new)
    stop = np.append(at[1:], n) - 1
    length = stop - at + 1
    names = np.where(length > 1, combine(s.names[at], length.astype(np.uint64), np.full(at.size, 2 * level + 1, np.uint64)), s.names[at])
    last = _last(s.first)
    # Outside a document nothing is known: the reach leaves it by one word.
    low = np.where(s.first[at], s.start[at] - 1, s.low[np.maximum(at - 1, 0)])
    high = np.where(last[stop], s.end[stop] + 1, s.high[np.minimum(stop + 1, n - 1)])
    return Symbols(names, s.start[at], s.end[stop], low, high, s.first[at])


def name_pairs(s: Symbols, level: int) -> Symbols:
    """A left name followed by a right one becomes one symbol."""
    n = s.names.size
    if not n:
        return s
    left = (mix(s.names + np.uint64(level)) & np.uint64(1)).astype(bool)
    last = _last(s.first)
    opens = np.zeros(n, bool)
    opens[:-1] = left[:-1] & ~left[1:] & ~s.first[1:]
    closes = np.append(False, opens[:-1])
    at = np.flatnonzero(~closes)
    joined = opens[at]
    mate = np.minimum(at + 1, n - 1)
    names = np.where(joined, combine(s.names[at], s.names[mate], np.full(at.size, 2 * level + 2, np.uint64)), s.names[at])
    before, after = np.maximum(at - 1, 0), mate
    low = np.where(joined | left[at], s.low[at], np.where(s.first[at], s.start[at] - 1, np.minimum(s.low[at], s.low[before])))
    high = np.where(joined, s.high[mate], np.where(left[at], np.where(last[at], s.end[at] + 1, np.maximum(s.high[at], s.high[after])), s.high[at]))
    return Symbols(names, s.start[at], np.where(joined, s.end[mate], s.end[at]), low, high, s.first[at])


def levels(names: np.ndarray, bounds: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The word level and every recompressed level of the documents that ``bounds`` cuts ``names`` into."""
    place = np.arange(names.size)
    first = np.zeros(names.size, bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    out = [Symbols(names, place, place + 1, place, place + 1, first)]
    for level in range(rounds):
        out.append(name_pairs(name_runs(out[-1], level), level))
    return out


def choose(stack: list[Symbols], sizes: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """For every window start, the name of the chosen symbol.

    Of all symbols that the window determines, on any level, the one with the most letters
    (``sizes``: bytes of every word) is the rarest as a rule; ties go to the greatest mixed name, so that
    neighbouring windows agree. Both depend on the window's words alone, and make the name: letters and 56 bits, mixed.
    """
    total = sizes.size
    before = np.concatenate([[0], np.cumsum(sizes)])
    best = np.zeros(windows.size, np.uint64)
    for level in range(len(stack) - 1, -1, -1):
        s = stack[level]
        if not s.names.size:
            continue
        # Symbols in order have rising reach: a window sees the range [a, b) of them.
        a = np.cumsum(np.bincount(np.maximum(s.low + 1, 0), minlength=total + 2))[windows]
        b = np.cumsum(np.bincount(np.minimum(s.high, total + 1), minlength=total + 2))[windows + window]
        letters = np.minimum(before[s.end] - before[s.start], 255).astype(np.uint64)
        # The level is part of the name: a word alone differs from itself kept by a round.
        most = (letters << np.uint64(56)) | (mix(s.names + np.uint64(97 + level)) >> np.uint64(8))
        # The greatest of each range by two stretches of a power of two.
        width = b - a
        for power in range(int(width.max(initial=0)).bit_length()):
            mine = np.flatnonzero((width >> power) == 1)
            if mine.size:
                found = np.maximum(most[a[mine]], most[b[mine] - (1 << power)])
                best[mine] = np.maximum(best[mine], found)
            most = np.maximum(most, np.append(most[1 << power:], most[-1:].repeat(min(1 << power, most.size))))
    return mix(best)


@dataclass
class Batch:
    """Words, windows and document ids of one batch, in a fixed order of rows."""

    ids: np.ndarray
    values: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    windows: np.ndarray
    owner: np.ndarray  # document (row) of every window


def unpack(table: pa.Table, window: int) -> Batch:
    table = table.combine_chunks()
    text = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
    ids = np.array([NO_ID if x is None else x for x in table.column("doc_id").to_pylist()], np.int64)
    values, offsets = utf8(text)
    starts, ends, bounds = words(values, offsets)
    sizes = np.diff(bounds)
    count = np.maximum(sizes - window + 1, 0)
    owner = np.repeat(np.arange(sizes.size), count)
    windows = np.repeat(bounds[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return Batch(ids, values, offsets, starts, ends, bounds, windows, owner)


def entries(names: np.ndarray, second: np.ndarray | None, docs: np.ndarray):
    """Distinct names by first appearance: name, its second part, least and greatest document, and the place of every input name.

    ``docs`` rises, so the first appearance is in the least document and the last one in the greatest.
    """
    rank = np.argsort(names, kind="stable") if second is None else np.lexsort((second, names))
    new = np.ones(rank.size, bool)
    new[1:] = names[rank][1:] != names[rank][:-1]
    if second is not None:
        new[1:] |= second[rank][1:] != second[rank][:-1]
    first = rank[new]
    order = np.argsort(first)
    number = np.empty(first.size, np.int64)
    number[order] = np.arange(first.size)
    back = np.empty(rank.size, np.int64)
    back[rank] = number[np.cumsum(new) - 1]
    first = first[order]
    last = np.zeros(first.size, np.int64)
    last[back] = np.arange(back.size)
    return names[first], None if second is None else second[first], docs[first], docs[last], back


PACKED = "range int, batch long, names binary, low binary, more binary"
ANSWER = "batch long, round int, range int, bits binary"


def _range_of(names: np.ndarray, ranges: int) -> np.ndarray:
    return ((names >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _narrow(x: np.ndarray) -> bytes:
    """Numbers in two, four or eight bytes each."""
    if x.size and x.min() < 0:
        return x.astype(np.int64).tobytes()
    return x.astype(next(t for t in (np.uint16, np.uint32, np.int64) if x.max(initial=0) <= np.iinfo(t).max)).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, {2: np.uint16, 4: np.uint32, 8: np.int64}[len(raw) // n]).astype(np.int64)


def pack(batch: int, ranges: int, names: np.ndarray, second: np.ndarray | None, low: np.ndarray, high: np.ndarray, note: bytes) -> pa.Table:
    """Entries dealt over name ranges, in order of appearance; ``second`` adds 64 bits to each name. ``note`` comes back to the batch as it is."""
    where = _range_of(names, ranges)
    order, counts = np.argsort(where, kind="stable"), np.bincount(where, minlength=ranges)
    ends = np.cumsum(counts)
    rows = [(r, order[ends[r] - counts[r]:ends[r]]) for r in np.flatnonzero(counts).tolist()]
    named = [names[x].tobytes() + (second[x].tobytes() if second is not None else b"") for _, x in rows]
    # Negative ranges hold notes.
    return pa.table({
        "range": pa.array([*(r for r, _ in rows), -1 - batch % ranges], pa.int32()), "batch": pa.array([batch] * (len(rows) + 1), pa.int64()),
        "names": pa.array([*named, pa.compress(note, codec="zstd", asbytes=True)], pa.binary()),
        "low": pa.array([*(_narrow(np.diff(low[x], prepend=0)) for _, x in rows), len(note).to_bytes(8, "little")], pa.binary()),
        "more": pa.array([*(_narrow(high[x] - low[x]) for _, x in rows), b""], pa.binary())})


def _note(answers: pa.Table, round_no: int) -> bytes:
    """The note of the batch from a round."""
    for key, number, bits in zip(answers.column("range").to_pylist(), answers.column("round").to_pylist(), answers.column("bits").to_pylist()):
        if number == round_no and key < 0:
            return pa.decompress(bits[8:], int.from_bytes(bits[:8], "little"), codec="zstd", asbytes=True)
    raise ValueError(f"no note of round {round_no}")


def _gather(round_no: int):
    """Answers for one name range. Round 1: is the name in two documents; round 2: is it in a document before the batch's least."""

    def run(table: pa.Table) -> pa.Table:
        batches = table.column("batch").to_numpy()
        key = int(table.column("range")[0].as_py())
        if key < 0:
            notes = [a + b for a, b in zip(table.column("low").to_pylist(), table.column("names").to_pylist())]
            return pa.table({"batch": table.column("batch"), "round": pa.array([round_no] * len(notes), pa.int32()), "range": table.column("range"), "bits": pa.array(notes, pa.binary())})
        order = np.argsort(batches, kind="stable")
        raw = [table.column("names")[int(i)].as_py() for i in order]
        sizes = np.array([len(x) // (8 * round_no) for x in raw])
        low = [np.cumsum(_wide(table.column("low")[int(i)].as_py(), n)) for i, n in zip(order, sizes.tolist())]
        more = [_wide(table.column("more")[int(i)].as_py(), n) for i, n in zip(order, sizes.tolist())]
        lows, highs = np.concatenate(low), np.concatenate(low) + np.concatenate(more)
        if round_no == 1:
            _, back = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in raw]), return_inverse=True)
        else:
            one = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(raw, sizes)])
            two = np.concatenate([np.frombuffer(x, np.uint64, n, 8 * n) for x, n in zip(raw, sizes)])
            rank = np.lexsort((two, one))
            new = np.append(True, (one[rank][1:] != one[rank][:-1]) | (two[rank][1:] != two[rank][:-1]))
            back = np.empty(rank.size, np.int64)
            back[rank] = np.cumsum(new) - 1
        least = np.full(int(back.max()) + 1, NO_ID)
        np.minimum.at(least, back, lows)
        if round_no == 1:
            most = np.full(least.size, np.iinfo(np.int64).min)
            np.maximum.at(most, back, highs)
            flag = (least < most)[back]
        else:
            flag = least[back] < lows
        ends = np.cumsum(sizes)
        bits = [np.packbits(flag[e - n:e]).tobytes() for n, e in zip(sizes.tolist(), ends.tolist())]
        return pa.table({"batch": pa.array(batches[order], pa.int64()), "round": pa.array([round_no] * len(bits), pa.int32()), "range": pa.array([key] * len(bits), pa.int32()), "bits": pa.array(bits, pa.binary())})

    return run


def _flags(answers: pa.Table, round_no: int, where: np.ndarray, ranges: int) -> np.ndarray:
    """The answers to what ``pack`` sent, one boolean per entry; ``where`` has the entries' ranges."""
    out = np.zeros(where.size, bool)
    order, counts = np.argsort(where, kind="stable"), np.bincount(where, minlength=ranges)
    ends = np.cumsum(counts)
    for key, number, bits in zip(answers.column("range").to_pylist(), answers.column("round").to_pylist(), answers.column("bits").to_pylist()):
        if number == round_no and key >= 0:
            out[order[ends[key] - counts[key]:ends[key]]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(counts[key])).astype(bool)
    return out


def _chosen_note(where: np.ndarray, back: np.ndarray) -> bytes:
    """The range of every entry, and the entry of every window: neighbours mostly share one, or go on to the next new one."""
    first = np.flatnonzero(np.diff(back, prepend=-1))
    runs = [np.diff(back[first], prepend=-1).astype(np.int32), np.diff(np.append(first, back.size)).astype(np.int32)]
    return where.size.to_bytes(8, "little") + first.size.to_bytes(8, "little") + where.astype(np.uint32).tobytes() + runs[0].tobytes() + runs[1].tobytes()


def _from_chosen_note(note: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, runs = int.from_bytes(note[:8], "little"), int.from_bytes(note[8:16], "little")
    where = np.frombuffer(note, np.uint32, n, 16).astype(np.int64)
    step, size = np.frombuffer(note, np.int32, 2 * runs, 16 + 4 * n).reshape(2, -1)
    return where, np.repeat(np.cumsum(step, dtype=np.int64) - 1, size)


def digests(b: Batch, at: np.ndarray, window: int) -> np.ndarray:
    """128 bits of the words of the windows that start at words ``at``: n x 2 of 64."""
    size = b.ends - b.starts
    joined = np.full(int(size.sum()) + size.size, 32, np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    # Each word goes to its place in the text of single spaces.
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(begin, size) + inside] = b.values[np.repeat(b.starts, size) + inside]
    text, name = memoryview(joined), xxhash.xxh3_128_digest
    raw = b"".join([name(text[x:y]) for x, y in zip(begin[at].tolist(), (begin + size)[at + window - 1].tolist())])
    return np.frombuffer(raw, np.uint64).reshape(-1, 2)


def _verified(b: Batch, picked: np.ndarray, window: int):
    """``entries`` of the digests of the picked windows."""
    two, one = digests(b, b.windows[picked], window).T if picked.size else np.zeros((2, 0), np.uint64)
    return entries(one, two, b.ids[b.owner[picked]])


def _symbols(window: int, rounds: int, ranges: int):
    def run(table: pa.Table) -> pa.Table:
        b = unpack(table, window)
        chosen = choose(levels(word_names(b.values, b.starts, b.ends), b.bounds, rounds), b.ends - b.starts, b.windows, window)
        names, _, low, high, back = entries(chosen, None, b.ids[b.owner])
        return pack(table.column("batch")[0].as_py(), ranges, names, None, low, high, _chosen_note(_range_of(names, ranges), back))

    return run


def _windows(window: int, rounds: int, ranges: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())], names=["range", "batch", "names", "low", "more"])
        where, back = _from_chosen_note(_note(answers, 1))
        shared = _flags(answers, 1, where, ranges)[back]
        one, two, low, _, _ = _verified(unpack(table, window), np.flatnonzero(shared), window)
        note = shared.size.to_bytes(8, "little") + np.packbits(shared).tobytes()
        return pack(table.column("batch")[0].as_py(), ranges, one, two, low, low, note)

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, removed array<struct<start: bigint, end: bigint>>"


def _remove(window: int, rounds: int, ranges: int, texts: bool):
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        b = unpack(table, window)
        gone = np.zeros(b.starts.size + 1, np.int64)
        if b.windows.size:
            note = _note(answers, 2)
            picked = np.flatnonzero(np.unpackbits(np.frombuffer(note, np.uint8, offset=8), count=int.from_bytes(note[:8], "little")))
            one, _, low, _, back = _verified(b, picked, window)
            before = _flags(answers, 2, _range_of(one, ranges), ranges)
            hit = b.windows[picked[before[back] | (low[back] < b.ids[b.owner[picked]])]]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
        gone = np.cumsum(gone)[:-1] > 0
        raw = b.values.tobytes()
        out = []
        for i in range(table.num_rows):
            a, e = int(b.bounds[i]), int(b.bounds[i + 1])
            kept = raw[b.offsets[i]:b.offsets[i + 1]].split()
            mine = gone[a:e]
            spans = []
            if mine.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])]
                kept = [w for w, g in zip(kept, mine.tolist()) if not g]
            joined = b" ".join(kept)
            out.append((None if b.ids[i] == NO_ID else int(b.ids[i]), e - a, int(mine.sum()), hashlib.sha256(joined).hexdigest(), joined.decode() if texts else None, spans))
        columns = list(zip(*out)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds.types)], schema=kinds)

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the text that stays; null if ``texts`` is off) and removed word ranges."""
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    batches = max(1, -(-size["n"] // BATCH_DOCS), -(-size["b"] // BATCH_BYTES))
    ranges = max(1, -(-batches // RANGE_SHARE))
    # By place, not by content: copies of one row would meet in one batch.
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(batches))
    batched = docs.selectExpr("cast(doc_id as long) as doc_id", "text").withColumn("batch", place)
    batched = batched.repartition("batch")
    # Rows in a fixed order: every round and every retry sees the same batch.
    one = batched.groupBy("batch").applyInArrow(_ordered(_symbols(window, rounds, ranges)), PACKED).groupBy("range").applyInArrow(_gather(1), ANSWER)
    two = batched.groupBy("batch").cogroup(one.groupBy("batch")).applyInArrow(_ordered(_windows(window, rounds, ranges)), PACKED).groupBy("range").applyInArrow(_gather(2), ANSWER)
    both = one.unionByName(two)
    return batched.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(_ordered(_remove(window, rounds, ranges, texts)), RESULT)


def _ordered(f):
    """Sort a batch by id and text before ``f``."""

    def sort(table: pa.Table) -> pa.Table:
        return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]) if table.num_rows else table

    if f.__code__.co_argcount == 1:
        def run_one(table: pa.Table) -> pa.Table:
            return f(sort(table))
        return run_one

    def run_two(table: pa.Table, answers: pa.Table) -> pa.Table:
        return f(sort(table), answers)
    return run_two
