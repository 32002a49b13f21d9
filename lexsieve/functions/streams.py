"""A text as a stream of folded characters, each with its place in the original."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from lexsieve.functions import fold


@dataclass(slots=True)
class Stream:
    """Parallel arrays over folded characters. start and end are code points of the original;
    gap: a separator precedes; hard: part of a word at its edges; run: characters collapsed into it."""

    chars: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hard: np.ndarray
    gap: np.ndarray
    run: np.ndarray

    def take(self, at: np.ndarray) -> Stream:
        return Stream(*(getattr(self, c)[at] for c in self.__slots__))

    def text(self) -> str:
        return self.chars.astype("<u4").tobytes().decode("utf-32-le")

    def __len__(self) -> int:
        return len(self.chars)


class Normalizer:
    def __init__(self) -> None:
        self.kind, self.size, self.first, self.pool = fold.arrays()

    def points(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")

    def stream(self, points: np.ndarray, marks: np.ndarray | None = None) -> Stream:
        """marks: places of the characters that part several texts; a gap lies on either side of each."""
        known = np.minimum(points, fold.LIMIT - 1)
        kind = np.where(points < fold.LIMIT, self.kind[known], fold.HARD)
        kept = np.flatnonzero(kind >= fold.SOFT)
        size = np.where(points[kept] < fold.LIMIT, self.size[known[kept]], 1).astype(np.int64)
        source = np.repeat(kept, size)
        within = np.arange(len(source)) - np.repeat(np.cumsum(size) - size, size)
        inside = points[source] < fold.LIMIT
        chars = np.where(inside, self.pool[np.where(inside, self.first[known[source]] + within, 0)], points[source])
        breaks = np.cumsum(kind == fold.BREAK)[source]
        gap = np.ones(len(source), dtype=bool)
        gap[1:] = breaks[1:] != breaks[:-1]
        if marks is not None and len(marks):
            at = np.searchsorted(source, marks)
            gap[at] = True
            gap[np.minimum(at + 1, len(gap) - 1)] = True
        return Stream(chars, source, source + 1, kind[source] == fold.HARD, gap, np.ones(len(source), dtype=np.int64))

    @staticmethod
    def squeezed(s: Stream, marks: np.ndarray | None = None) -> Stream | None:
        """Runs of one character as one, none across a mark; none where there is no run."""
        new = np.ones(len(s), dtype=bool)
        new[1:] = s.chars[1:] != s.chars[:-1]
        if marks is not None and len(marks):
            at = np.searchsorted(s.start, marks)
            new[at] = True
            new[np.minimum(at + 1, len(new) - 1)] = True
        first = np.flatnonzero(new)
        if len(first) == len(s):
            return None
        last = np.append(first[1:], len(s)) - 1
        return Stream(s.chars[first], s.start[first], s.end[last], s.hard[first], s.gap[first], last - first + 1)


def utf16_offsets(points: np.ndarray) -> np.ndarray:
    """Code units before each code point, and in all."""
    return np.concatenate([[0], np.cumsum(1 + (points > 0xFFFF))])
