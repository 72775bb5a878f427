"""Lower-cased letter runs of whole columns, as array operations on code points."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from strikeloom.llm.common import MIX_A, mix

#: Code points below are tabulated, those above count as letters but for symbol ranges.
_LIMIT = 0x2070
_SYMBOLS = ((0x2070, 0x2C00), (0x3000, 0x3040), (0xFE00, 0xFE70), (0xFF00, 0xFF21), (0x1F000, 0x1FB00))


@dataclass
class Found:
    offsets: np.ndarray  # first code point of every text, and the total
    starts: np.ndarray  # of every token, in the joined texts
    ends: np.ndarray
    docs: np.ndarray
    bounds: np.ndarray  # first token of every text, and the total
    names: np.ndarray
    heads: np.ndarray
    points: np.ndarray  # lower-cased


class Letters:
    def __init__(self):
        chars = [chr(i) for i in range(_LIMIT)]
        self.is_letter = np.array([unicodedata.category(c)[0] in "LM" for c in chars])
        self.lower = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in chars], np.uint32)

    def points(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points (lower-cased), which are letters, and the offsets of the texts; null counts as empty."""
        texts = [t or "" for t in column.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        raw = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        low = np.minimum(raw, _LIMIT - 1)
        letter, lower = self.is_letter[low], self.lower[low]
        high = np.flatnonzero(raw >= _LIMIT)
        if high.size:
            values = raw[high]
            lower[high] = values
            letter[high] = ~np.any([(values >= a) & (values < b) for a, b in _SYMBOLS], axis=0)
        return lower, letter, offsets

    def tokens(self, column: pa.Array, head: int) -> Found:
        points, letter, offsets = self.points(column)
        if not letter.any():
            none, zero = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return Found(offsets, none, none, none, np.zeros(offsets.size, np.int64), zero, zero, points)
        filled = offsets[:-1] < offsets[1:]
        begins = offsets[:-1][filled]
        start = letter.copy()
        start[1:] &= ~letter[:-1]
        start[begins] = letter[begins]
        end = letter.copy()
        end[:-1] &= ~letter[1:]
        end[begins[1:] - 1] = letter[begins[1:] - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        bounds = np.searchsorted(starts, offsets)
        lengths = ends - starts
        inked = points[letter].astype(np.uint64)
        at = np.cumsum(lengths) - lengths
        inside = np.arange(inked.size) - np.repeat(at, lengths)
        powers = np.cumprod(np.full(int(lengths.max()) + 1, MIX_A | 1, np.uint64))
        worth = mix(inked * np.uint64(MIX_A)) * powers[inside]
        names = mix(np.add.reduceat(worth, at))
        heads = mix(np.add.reduceat(np.where(inside < head, worth, np.uint64(0)), at) ^ np.uint64(MIX_A))
        return Found(offsets, starts, ends, np.repeat(np.arange(offsets.size - 1), np.diff(bounds)), bounds, names, heads, points)
