"""Byte-level BPE ids of whole columns.

The text is split into pieces with array operations by the vocabulary's public split
pattern, each distinct piece is encoded once per task, and ids are gathered back. Texts
with characters outside the tabulated ranges, or with a special token's string, go
through ``tokenizers`` whole, so the ids are always those of the tokenizer file.
Pieces are looked up by a 64-bit name and compared letter by letter with the piece that
the name stands for; a text with a piece that differs goes through ``tokenizers`` too.
"""

from __future__ import annotations

import base64
import re
import unicodedata

import numpy as np
import pyarrow as pa

from strikeloom.llm.common import MIX_A, mix

_OTHER, _LETTER, _NUMBER, _SPACE, _UNKNOWN = range(5)
#: Code points whose class never changed between Unicode versions: Latin and general punctuation.
_KNOWN = ((0, 0x250), (0x2010, 0x2028), (0x2030, 0x205F))
_LIMIT = 0x2060
#: Pieces kept per task; beyond it the table starts anew.
_KEEP = 1_000_000


def _classes() -> np.ndarray:
    out = np.full(_LIMIT + 1, _UNKNOWN, np.uint8)  # the last stands for all code points above
    for low, high in _KNOWN:
        for point in range(low, high):
            kind = unicodedata.category(chr(point))[0]
            out[point] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _SPACE
    return out


class Tokens:
    def __init__(self, tokenizer: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.table = table
        self.piece = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe.encode_single_piece
        special = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        self.classes = _classes()
        self.letter = mix(np.arange(_LIMIT + 1, dtype=np.uint64) * np.uint64(MIX_A) + np.uint64(7))
        self.names, self.sizes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint16)
        self.letters, self.spans = np.zeros(0, np.uint32), np.zeros((0, 2), np.int64)  # the known pieces themselves

    def sentence_ends(self) -> np.ndarray:
        """For every id, whether its bytes end a sentence or a line."""
        out = np.zeros(max(self.table.values()) + 2, bool)
        for raw, number in self.table.items():
            out[number] = bool(re.search(rb"[.!?][\"')\]]*$|\n", raw))
        return out

    def starts(self, points: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pieces start. The pattern: contractions, an optional space before a run of letters, numbers or others, runs of white space."""
        n = points.size
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        filled = offsets[:-1] < offsets[1:]
        first[offsets[:-1][filled]] = True
        last[offsets[1:][filled] - 1] = True
        change = first.copy()
        change[1:] |= kind[1:] != kind[:-1]
        space = kind == _SPACE
        blank = np.zeros(n, bool)
        blank[1:] = points[:-1] == 32
        start = change & (space | first | ~blank)
        # The last of several white-space characters before a word stands alone or joins the word.
        lone = space & ~last & ~change
        lone[:-1] &= ~space[1:]
        start |= lone
        mark = np.flatnonzero((points == 39) & start)
        mark = mark[mark + 1 < n]
        mark = mark[~last[mark] & (kind[mark + 1] == _LETTER)]
        if mark.size:
            a = points[mark + 1]
            after = np.minimum(mark + 2, n - 1)
            b = np.where((mark + 2 < n) & ~last[mark + 1], points[after], 0)
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
            hit, size = mark[one | two], np.where(one, 2, 3)[one | two]
            start[hit + 1] = False
            inside = hit + size < n
            start[(hit + size)[inside]] |= ~first[(hit + size)[inside]]
        return np.flatnonzero(start)

    def lookup(self, names: np.ndarray) -> np.ndarray:
        if not self.names.size:
            return np.full(names.size, -1)
        at = np.minimum(np.searchsorted(self.names, names), self.names.size - 1)
        return np.where(self.names[at] == names, at, -1)

    def learn(self, names: np.ndarray, pieces: list[bytes], letters: np.ndarray, lengths: np.ndarray) -> None:
        """``letters``: the code points of the pieces end to end."""
        if self.names.size > _KEEP:
            self.names, self.sizes, self.places, self.ids = self.names[:0], self.sizes[:0], self.places[:0], self.ids[:0]
            self.letters, self.spans = self.letters[:0], self.spans[:0]
        ends = self.letters.size + np.cumsum(lengths)
        self.letters = np.concatenate([self.letters, letters])
        spans = np.concatenate([self.spans, np.column_stack([ends - lengths, lengths])])
        found = [self.piece(x) for x in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        places = self.ids.size + np.cumsum(sizes) - sizes
        self.ids = np.concatenate([self.ids, np.fromiter((x for ids in found for x in ids), np.uint16, int(sizes.sum()))])
        joined = np.concatenate([self.names, names])
        order = np.argsort(joined, kind="stable")
        self.names, self.sizes, self.places = joined[order], np.concatenate([self.sizes, sizes])[order], np.concatenate([self.places, places])[order]
        self.spans = spans[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of the texts; null counts as empty."""
        texts = [t or "" for t in column.to_pylist()]
        odd: dict[int, np.ndarray] = {}

        def whole(rows) -> None:
            for i in rows:
                odd[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint16)
                texts[i] = ""

        whole([i for i, t in enumerate(texts) if self.special and self.special.search(t)])
        while True:
            joined = "".join(texts)
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            kinds = self.classes[np.minimum(points, _LIMIT)]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            unknown = np.flatnonzero(kinds == _UNKNOWN)
            if not unknown.size:
                ids, bounds, differ = self.by_pieces(joined, points, kinds, offsets)
                if not differ.size:
                    break
                unknown = differ
            whole(np.unique(np.searchsorted(offsets, unknown, "right") - 1).tolist())
        if not odd:
            return ids, bounds
        parts = [odd.get(i, ids[bounds[i]:bounds[i + 1]]) for i in range(len(texts))]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def by_pieces(self, joined: str, points: np.ndarray, kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and offsets, and the first letters of pieces whose name stands for another piece."""
        if not points.size:
            return np.zeros(0, np.uint16), np.zeros(offsets.size, np.int64), np.zeros(0, np.int64)
        starts = self.starts(points, kinds, offsets)
        lengths = np.diff(np.append(starts, points.size))
        names = self.piece_names(points, starts, lengths)
        distinct, where, back = np.unique(names, return_index=True, return_inverse=True)
        at = self.lookup(distinct)
        new = np.flatnonzero(at < 0)
        if new.size:
            if self.names.size > _KEEP:  # the table starts anew: learn all pieces of this pass
                new = np.arange(distinct.size)
            rows = where[new]
            pieces = [joined[a:b].encode() for a, b in zip(starts[rows].tolist(), (starts + lengths)[rows].tolist())]
            self.learn(distinct[new], pieces, points[_places(starts[rows], lengths[rows])], lengths[rows])
            at = self.lookup(distinct)
        known = at[back]
        same = self.spans[known, 1] == lengths
        if same.all():
            differs = points != self.letters[_places(self.spans[known, 0], lengths)]
            same = ~np.logical_or.reduceat(differs, starts) if differs.any() else same
        if not same.all():
            return np.zeros(0, np.uint16), np.zeros(offsets.size, np.int64), starts[~same]
        sizes = self.sizes[known]
        total = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.places[known] - (total - sizes), sizes) + np.arange(int(total[-1]))]
        return ids, np.concatenate([[0], total])[np.searchsorted(starts, offsets)], np.zeros(0, np.int64)

    def piece_names(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        powers = np.cumprod(np.full(int(lengths.max()) + 1, MIX_A | 1, np.uint64))
        inside = np.arange(points.size) - np.repeat(starts, lengths)
        return mix(np.add.reduceat(self.letter[points] * powers[inside], starts) ^ lengths.astype(np.uint64))


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of stretches, end to end."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if ends.size else 0)
