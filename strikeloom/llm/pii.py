"""Personal data: fixed patterns plus a linear-chain conditional random field over word shapes.

The patterns (``base_spans``) are exact and linear in the length of a text. The random
field labels words with a kind or ``other``. Its features are shapes only: the word's
shape with the lengths of its digit runs, its collapsed shape, its size, and the shapes
of both neighbours. It is trained on a small labelled table (``LABELLED`` rows at most)
of word windows; without one, windows of a bounded sample of the documents are labelled
by the patterns.

Decoding is Viterbi in numpy batches. A word whose score for ``other`` leads by more than
any labelling around it could gain is certainly ``other`` (``pinned``): the chain is cut
there without changing the best labelling, so only short runs around unusual words need
the recursion, all of a batch at once.

Spans found by the field are added where they touch no pattern span, hold enough digits
(or an @) and are not a number that the patterns saw and dropped.

Defined cases: null and empty texts hold no span; null ids stay null; repeated rows each
get their result; very long texts are decoded whole; an empty table gives no rows; when
the sample holds no personal data, only the patterns are used. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strikeloom.llm.common import passes, tidy

KINDS = ("email", "ip", "card", "phone")
#: Documents whose windows are labelled by the patterns, and windows kept, at most.
SAMPLE_DOCS, LABELLED = 4_000, 1_200
WINDOW = 4
MIN_DIGITS = 7

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, index of kind) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    if "@" in text:
        out += [(a, b, 0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            out += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# Words and shapes ------------------------------------------------------------------

_PLAIN = ("x", "X", "p")  # letters in lower case, with upper case, with other characters
_SPACE, _LOW, _UP, _KEY, _REST = range(5)


def _table() -> np.ndarray:
    out = np.full(0x250, _REST, np.uint8)
    for i in range(0x250):
        c = chr(i)
        out[i] = _SPACE if c in " \t\n\v\f\r" else _KEY if c in "0123456789@+" else _LOW if c.islower() else _UP if c.isalpha() else _REST
    return out


_TABLE = _table()
_RUN = re.compile(r"d+|x+|X+")


def shape(word: str) -> tuple[str, str]:
    """Shape of the whole word with lengths of digit runs (to 5), and the collapsed shape."""
    flat = "".join("d" if "0" <= c <= "9" else "x" if c.islower() else "X" if c.isalpha() else c for c in word.strip(".,;:!?\"'#"))
    return _RUN.sub(lambda m: m[0][0] + (str(min(len(m[0]), 5)) if m[0][0] == "d" else ""), flat), _RUN.sub(lambda m: m[0][0], flat)


@dataclass
class Words:
    """Words of a batch: code point places in the joined texts, and coded shapes."""

    joined: str
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    plain: np.ndarray  # 0..2, or -1 for words with a digit, @ or +


def words_of(column: pa.Array) -> Words:
    texts = [t or "" for t in column.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kinds = np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], np.uint8(_UP))
    ink = kinds != _SPACE
    none = np.zeros(0, np.int64)
    if not ink.any():
        return Words(joined, offsets, none, none, np.zeros(offsets.size, np.int64), none)
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    start, end = ink.copy(), ink.copy()
    start[1:] &= ~ink[:-1]
    start[begins] = ink[begins]
    end[:-1] &= ~ink[1:]
    end[begins[1:] - 1] = ink[begins[1:] - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    top = np.maximum.reduceat(kinds, starts)  # kinds between words are spaces, the lowest
    key = np.bincount(np.searchsorted(starts, np.flatnonzero(kinds == _KEY), "right") - 1, minlength=starts.size) > 0
    plain = np.select([key, top == _REST, top == _UP], [-1, 2, 1], 0)
    return Words(joined, offsets, starts, ends, np.searchsorted(starts, offsets), plain)


def features(shapes: list[tuple[str, str]], i: int) -> tuple[str, ...]:
    """Feature names of word i, whose neighbours are i - 1 and i + 1."""
    full, short = shapes[i]
    before = shapes[i - 1][1] if i else "^"
    after = shapes[i + 1][1] if i + 1 < len(shapes) else "$"
    return "s=" + full, "c=" + short, f"n={min(len(full), 24) // 4}", "b=" + before, "a=" + after, f"bc={before}|{short}", f"ca={short}|{after}"


# The random field --------------------------------------------------------------------


@dataclass
class Field:
    """Weights of a chain whose ends are bordered by ``other`` (label 0)."""

    names: dict[str, int]
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # label before x label
    cache: dict = field(default_factory=dict)

    def emit(self, feats: tuple[str, ...]) -> np.ndarray:
        out = self.cache.get(feats)
        if out is None:
            if len(self.cache) > 100_000:
                self.cache.clear()
            at = [self.names[f] for f in feats if f in self.names]
            out = self.cache[feats] = self.weights[at].sum(axis=0)
        return out

    def gain(self) -> np.ndarray:
        """What a label other than 0 can gain at most through its two transitions."""
        m = self.moves
        return np.array([(m[:, y] - m[:, 0]).max() + (m[y] - m[0]).max() for y in range(len(m))])

    def pinned(self, scores: np.ndarray) -> np.ndarray:
        lead = scores[..., :1] - scores[..., 1:]
        return (lead > self.gain()[1:] + 1e-9).all(axis=-1)


def viterbi(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of all runs at once; ``scores`` holds the runs end to end, each bordered by label 0."""
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    back = np.zeros(scores.shape, np.int8)
    state = scores[first] + moves[0]
    final = np.zeros(len(sizes), np.int64)
    for t in range(1, int(sizes[0]) + 1):
        alive = int(np.searchsorted(-sizes, -t, "left"))  # runs longer than t
        ending = slice(alive, int(np.searchsorted(-sizes, -t, "right")))
        final[ending] = (state[ending] + moves[:, 0]).argmax(axis=1)
        if not alive:
            break
        paths = state[:alive, :, None] + moves
        rows = first[:alive] + t
        back[rows] = paths.argmax(axis=1)
        state[:alive] = paths.max(axis=1) + scores[rows]
    labels = np.zeros(len(scores), np.int64)
    now = final
    for t in range(int(sizes[0]) - 1, -1, -1):
        alive = int(np.searchsorted(-sizes, -t, "left"))
        rows = first[:alive] + t
        labels[rows] = now[:alive]
        now[:alive] = back[rows, now[:alive]]
    return labels


def fit(table: list[tuple[list[str], list[int]]], steps: int = 120, rate: float = 0.2, penalty: float = 0.02) -> Field | None:
    """Maximum likelihood with an L2 penalty over windows of words and labels; None without any labelled word."""
    table = [(w, y) for w, y in table if w]
    if not any(any(y) for _, y in table):
        return None
    names: dict[str, int] = {}
    rows = []
    for words, _ in table:
        shapes = [shape(w) if _DIGIT.search(w) or "@" in w or "+" in w else (_PLAIN[_plain(w)],) * 2 for w in words]
        rows.append([[names.setdefault(f, len(names)) for f in features(shapes, i)] for i in range(len(words))])
    longest, k, n = max(len(r) for r in rows), len(KINDS) + 1, len(rows)
    width = len(rows[0][0])
    feats = np.full((n, longest, width), len(names), np.int64)
    gold, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (r, (_, y)) in enumerate(zip(rows, table)):
        feats[i, :len(r)], gold[i, :len(r)], mask[i, :len(r)] = r, y, True
    weights, moves = np.zeros((len(names) + 1, k)), np.zeros((k, k))
    # Sums over all occurrences of a feature are taken in the order of the feature ids.
    order = np.argsort(feats[mask].ravel(), kind="stable")
    firsts = np.searchsorted(feats[mask].ravel()[order], np.arange(len(names)))
    order //= width

    def tally(values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.add.reduceat(values[order], firsts), np.zeros((1, k))])

    known = tally(np.eye(k)[gold[mask]])
    padded = np.concatenate([np.zeros((n, 1), np.int64), np.where(mask, gold, 0), np.zeros((n, 1), np.int64)], axis=1)
    lengths = mask.sum(axis=1)
    known_moves = np.zeros((k, k))
    for t in range(longest + 1):
        live = t <= lengths
        np.add.at(known_moves, (padded[live, t], padded[live, t + 1]), 1)
    means = [np.zeros_like(weights), np.zeros_like(moves)]
    squares = [np.zeros_like(weights), np.zeros_like(moves)]

    def total(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for step in range(1, steps + 1):
        weights[-1] = 0
        scores = weights[feats].sum(axis=2)
        ahead, behind = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        ahead[:, 0] = scores[:, 0] + moves[0]
        for t in range(1, longest):
            ahead[:, t] = np.where(mask[:, t, None], total(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t], ahead[:, t - 1])
        for t in range(longest - 1, -1, -1):
            last = t == lengths - 1
            if t + 1 < longest:
                on = total(moves + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
                behind[:, t] = np.where(last[:, None], moves[:, 0], on)
            else:
                behind[:, t] = moves[:, 0]
        z = total(ahead[:, -1] + moves[:, 0], 1)
        chance = np.exp(ahead + behind - z[:, None, None]) * mask[:, :, None]
        expected = tally(chance[mask])
        expected_moves = np.zeros((k, k))
        expected_moves[0] += chance[:, 0].sum(axis=0)
        expected_moves[:, 0] += chance[np.arange(n), lengths - 1].sum(axis=0)
        for t in range(1, longest):
            both = np.exp(ahead[:, t - 1, :, None] + moves + (scores[:, t] + behind[:, t])[:, None, :] - z[:, None, None])
            expected_moves += both[mask[:, t]].sum(axis=0)
        for i, (value, g) in enumerate(((weights, known - expected - penalty * weights), (moves, known_moves - expected_moves - penalty * moves))):
            means[i] = 0.9 * means[i] + 0.1 * g
            squares[i] = 0.99 * squares[i] + 0.01 * g * g
            value += rate * (means[i] / (1 - 0.9**step)) / (np.sqrt(squares[i] / (1 - 0.99**step)) + 1e-8) * min(1.0, 3 * (1 - step / (steps + 1)))
    return Field(names, weights[:-1], moves)


def _plain(word: str) -> int:
    """Class of a word without digit, @ and +, as ``words_of`` sees it."""
    kinds = [int(_TABLE[ord(c)]) if ord(c) < 0x250 else _UP for c in word]
    return 2 if _REST in kinds else 1 if _UP in kinds else 0


def weak_labels(docs: DataFrame, sample: int = SAMPLE_DOCS, limit: int = LABELLED) -> DataFrame:
    """(words array<string>, labels array<int>): windows around unusual words of a bounded sample, labelled by the patterns."""
    ids = docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            w = words_of(batch.column(0))
            key, rows = w.plain < 0, []
            for i in range(batch.num_rows):
                a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                odd = np.flatnonzero(key[a:b])
                if not odd.size:
                    if b > a:
                        rows.append((a, min(b, a + 2 * WINDOW + 1), i))
                    continue
                cuts = np.flatnonzero(np.diff(odd) > 2 * WINDOW)
                for x, y in zip(odd[np.append(0, cuts + 1)], odd[np.append(cuts, odd.size - 1)]):
                    rows.append((max(a, a + x - WINDOW), min(b, a + y + WINDOW + 1, a + x + 4 * WINDOW), i))
            words, labels, spans, last = [], [], [], -1
            for a, b, i in rows:
                if i != last:
                    start = int(w.offsets[i])
                    spans, last = base_spans(w.joined[start:int(w.offsets[i + 1])]), i
                words.append([w.joined[s:e] for s, e in zip(w.starts[a:b], w.ends[a:b])])
                labels.append([next((k + 1 for x, y, k in spans if x < e - start and y > s - start), 0) for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist())])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.int32()))], ["words", "labels"])

    found = chosen.select("text").mapInArrow(tidy(run), "words array<string>, labels array<int>")
    # Windows with personal data first, the rest by hash, so that the bound keeps both.
    return found.orderBy(F.when(F.exists("labels", lambda x: x > 0), F.pmod(F.xxhash64("words"), F.lit(3))).otherwise(F.pmod(F.xxhash64("words"), F.lit(6))), F.xxhash64("words"), "words").limit(limit)


def train(labelled: DataFrame) -> Field | None:
    """A field from a labelled table, of which ``LABELLED`` rows at most are read."""
    rows = labelled.select("words", "labels").limit(LABELLED).collect()
    return fit([(r["words"], r["labels"]) for r in rows])


def _field_spans(w: Words, model: Field) -> dict[int, list[tuple[int, int, int]]]:
    """Spans by text index that the field finds, in code points of the text."""
    n = w.starts.size
    if not n:
        return {}
    # Emissions of plain words depend on three plain neighbours: one table for all.
    edge = len(_PLAIN)
    names = [*((p, p) for p in _PLAIN)]

    def neighbours(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, after = np.full(n, edge), np.full(n, edge)
        before[1:], after[:-1] = code[:-1], code[1:]
        filled = w.bounds[:-1] < w.bounds[1:]
        before[w.bounds[:-1][filled]] = edge
        after[w.bounds[1:][filled] - 1] = edge
        return before, after

    before, after = neighbours(w.plain)
    grid = np.zeros((edge + 1, edge, edge + 1, len(model.moves)))
    for b in range(edge + 1):
        for c in range(edge):
            for a in range(edge + 1):
                row = [*([names[b]] if b < edge else []), names[c], *([names[a]] if a < edge else [])]
                grid[b, c, a] = model.emit(features(row, int(b < edge)))
    sure = model.pinned(grid)
    usual = (w.plain >= 0) & (before >= 0) & (after >= 0)
    open_ = ~usual
    open_[usual] = ~sure[before[usual], w.plain[usual], after[usual]]
    at = np.flatnonzero(open_)
    if not at.size:
        return {}
    shapes: dict[int, tuple[str, str]] = {}

    def look(i: int) -> tuple[str, str]:
        if i not in shapes:
            shapes[i] = names[w.plain[i]] if w.plain[i] >= 0 else shape(w.joined[w.starts[i]:w.ends[i]])
        return shapes[i]

    scores = np.zeros((at.size, len(model.moves)))
    for j, i in enumerate(at.tolist()):
        row = [*([look(i - 1)] if before[i] != edge else []), look(i), *([look(i + 1)] if after[i] != edge else [])]
        scores[j] = model.emit(features(row, int(before[i] != edge)))
    keep = ~model.pinned(scores)
    at, scores = at[keep], scores[keep]
    if not at.size:
        return {}
    text = np.searchsorted(w.bounds, at, "right") - 1
    new = np.append(True, (np.diff(at) > 1) | (np.diff(text) > 0))
    sizes = np.diff(np.append(np.flatnonzero(new), at.size))
    labels = viterbi(scores, sizes, model.moves)
    out: dict[int, list[tuple[int, int, int]]] = {}
    j = 0
    while j < at.size:
        e = j + 1
        if labels[j]:
            while e < at.size and not new[e] and labels[e] == labels[j]:
                e += 1
            a, b = int(w.starts[at[j]]), int(w.ends[at[e - 1]])
            piece = w.joined[a:b]
            a += len(piece) - len(piece.lstrip(".,;:!?\"'#"))
            b -= len(piece) - len(piece.rstrip(".,;:!?\"'#"))
            start = int(w.offsets[text[j]])
            if a < b:
                out.setdefault(int(text[j]), []).append((a - start, b - start, int(labels[j]) - 1))
        j = e
    return out


def _columns(docs: DataFrame, keep) -> tuple[DataFrame, int]:
    """What ``_find`` reads, and the place of the first column it hands on."""
    kept = [c for c in keep if c not in ("doc_id", "text", "found")]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *kept), 1 if "text" in keep else 2


def _types(fields) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)


def _find(shipped, first: int):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for batch in passes(batches):
            w = words_of(batch.column(1))
            special = np.unique(np.searchsorted(w.bounds, np.flatnonzero(w.plain < 0), "right") - 1)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            more = _field_spans(w, m) if m else {}
            for i in sorted({*special.tolist(), *more}):
                text = w.joined[w.offsets[i]:w.offsets[i + 1]]
                base = base_spans(text)
                extra = []
                for a, b, k in more.get(i, ()):
                    piece = text[a:b]
                    enough = "@" in piece if k == 0 else len(_DIGIT.findall(piece)) >= MIN_DIGITS
                    dropped = k == 2 and _CARD.fullmatch(piece)  # the patterns saw this number; it fails its check
                    if enough and not dropped and not any(x < b and y > a for x, y, _ in base):
                        extra.append((a, b, k))
                every = sorted([(a, b, k, True) for a, b, k in base] + [(a, b, k, False) for a, b, k in extra], key=lambda s: (s[0], s[2], s[1]))
                spans[i] = [{"start": a, "end": b, "kind": k, "base": own} for a, b, k, own in every]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span)), *batch.columns[first:]], ["doc_id", "found", *batch.schema.names[first:]])

    return run


def find(docs: DataFrame, model: Field | None, keep=()) -> DataFrame:
    """``doc_id`` and ``found``: array of (start, end, kind index, base) by start and kind, with the ``keep`` columns.

    ``text`` can be one of the kept columns.
    """
    columns, first = _columns(docs, keep)
    more = _types(columns.schema.fields[first:])
    run = _find(docs.sparkSession.sparkContext.broadcast(model), first)
    return columns.mapInArrow(tidy(run), "doc_id long, found array<struct<start: bigint, end: bigint, kind: int, base: boolean>>" + (", " + more if more else ""))


def digest(found: DataFrame) -> DataFrame:
    """Counts, checksum and text form of the spans of ``find``."""
    name = F.array(*[F.lit(k) for k in KINDS])

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["base"])
    def count(kind: int):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(i) for i in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span, or union of overlapping ones, replaced by its first kind in brackets."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], "[", KINDS[k].upper(), "]"]
        at = b
    return "".join([*out, text[at:]])


def _mask(others: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.schema.get_field_index("text"))
            spans = batch.column(batch.schema.get_field_index("found")).to_pylist()
            out = [t if t is None or not s else mask(t, [(x["start"], x["end"], x["kind"]) for x in s]) for t, s in zip(texts.to_pylist(), spans)]
            columns = []
            for c in others:
                column = batch.column(batch.schema.get_field_index(c))
                if c == "text":
                    column = pa.array(out, texts.type)
                elif c == "n_chars":
                    column = pa.array([len(t) if s and t is not None else n for t, s, n in zip(out, spans, column.to_pylist())], column.type)
                columns.append(column)
            yield pa.RecordBatch.from_arrays(columns, others)

    return run


def masked(found: DataFrame) -> DataFrame:
    """The rows of ``find`` (with ``text`` and ``n_chars`` kept) with personal data masked."""
    fields = [f for f in found.schema.fields if f.name != "found"]
    return found.mapInArrow(tidy(_mask([f.name for f in fields])), _types(fields))


def find_and_mask(docs: DataFrame, model: Field | None, keep) -> DataFrame:
    """``masked`` over ``find`` in one step: a task has one Python process, not two."""
    columns, first = _columns(docs, ["text", *keep])
    fields = [columns.schema["doc_id"], *columns.schema.fields[first:]]
    search, hide = _find(docs.sparkSession.sparkContext.broadcast(model), first), _mask([f.name for f in fields])
    return columns.mapInArrow(tidy(lambda batches: hide(search(batches))), _types(fields))
