"""Scanning texts: candidates of both streams, rules, intervals, order.

Pure arrays: every step is linear in the texts and in the candidates, but for sorting them. Many texts are
scanned as one, parted by marks that no pattern holds: places grow from text to text, so that
intervals of two texts never meet, and one pass of each automaton serves all.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from lexsieve.functions import fold
from lexsieve.functions.streams import Normalizer, Stream, utf16_offsets
from lexsieve.operators.automaton import Automaton
from lexsieve.plans.policy import Category, Policy, ScoreMode

#: What a candidate went through; 0 is a match.
MATCH, EDGE, INNER_GAP, RUNS, ALLOWED, PRECEDED = range(6)
REASONS = ("match", "edge", "inner_gap", "runs", "allowed", "preceded")


#: Characters that are scanned as one; a longer text is scanned alone.
SLICE_CHARS = 500_000


@dataclass(frozen=True)
class Found:
    """Parallel arrays over candidates; start and end are code points."""

    start: np.ndarray
    end: np.ndarray
    term: np.ndarray
    stream: np.ndarray
    reason: np.ndarray

    def take(self, at: np.ndarray) -> Found:
        return Found(self.start[at], self.end[at], self.term[at], self.stream[at], self.reason[at])


@dataclass(frozen=True)
class Slice:
    """Some texts as one: their code points, where each begins and where the marks are."""

    texts: list[str]
    points: np.ndarray
    begins: np.ndarray
    marks: np.ndarray

    def rows(self, found: Found) -> np.ndarray:
        """The number of each candidate's text."""
        return np.searchsorted(self.begins, found.start, "right") - 1


class Spans:
    """Intervals by start, with the furthest end so far: containment and overlap by binary search."""

    def __init__(self, start: np.ndarray, end: np.ndarray) -> None:
        order = np.argsort(start, kind="stable")
        self.start = start[order]
        self.reach = np.maximum.accumulate(end[order]) if len(order) else end

    def _reach(self, at: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.full(len(at), -1)
        return np.where(at > 0, self.reach[np.maximum(at - 1, 0)], -1)

    def containing(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._reach(np.searchsorted(self.start, start, "right")) >= end

    def overlapping(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._reach(np.searchsorted(self.start, end, "left")) > start


class Engine:
    """terms: (folded text, category name, severity, whole word), in the order that breaks ties.

    The patterns of all terms are compiled; a policy only tells which terms count, so that engines of one
    dictionary share them.
    """

    def __init__(self, terms: list[tuple[str, str, int, bool]], allow: list[str], policy: Policy) -> None:
        if not terms:
            raise RuntimeError("a screen needs at least one term")
        self.terms = terms
        self.normalizer = Normalizer()
        self.plain, self.allow, self.squeezed = Automaton(), Automaton(), Automaton()
        self.length = np.array([len(t[0]) for t in terms])
        self.word = np.array([t[3] for t in terms])
        self.severity = np.array([t[2] for t in terms])
        self.category = [Category.parse(t[1]) for t in terms]
        by_pattern: list[list[int]] = []
        by_squeezed: list[list[int]] = []
        for number, term in enumerate(terms):
            for automaton, text, owners in (
                (self.plain, term[0], by_pattern),
                (self.squeezed, fold.squeeze(term[0]), by_squeezed),
            ):
                at = automaton.add(text)
                if at == len(owners):
                    owners.append([])
                owners[at].append(number)
        self.owners = (by_pattern, by_squeezed)
        self.runs = [np.array([n for _, n in fold.runs(t[0])]) for t in terms]
        for word in allow:
            self.allow.add(word)
        for automaton in (self.plain, self.allow, self.squeezed):
            automaton.build()
        held = set().union(*(t[0] for t in terms), *allow)
        self._set(policy)
        self.mark = next(c for c in map(chr, range(0x10FFFF, fold.LIMIT, -1)) if c not in held)

    def _set(self, policy: Policy) -> None:
        self.policy = policy
        self.active = np.array([policy.allows(c, s) for c, s in zip(self.category, self.severity.tolist(), strict=True)])

    def with_policy(self, policy: Policy) -> Engine:
        """The same compiled patterns under another policy."""
        other = copy.copy(self)
        other._set(policy)
        return other

    def slices(self, texts: list[str | None]) -> Iterator[Slice]:
        """The texts in order, some at a time; a null counts as empty."""
        few: list[str] = []
        size = 0
        for k, text in enumerate(texts):
            few.append(text or "")
            size += len(few[-1]) + 1
            if size >= SLICE_CHARS or k + 1 == len(texts):
                ends = np.cumsum([len(t) + 1 for t in few])
                points = self.normalizer.points(self.mark.join(few))
                yield Slice(few, points, np.concatenate([[0], ends[:-1]]), ends[:-1] - 1)
                few, size = [], 0

    def candidates_of(self, part: Slice) -> Found:
        """All occurrences of terms in both streams, with what became of each."""
        none = np.zeros(0, dtype=np.int64)
        empty = Found(none, none, none, none, none)
        plain = self.normalizer.stream(part.points, part.marks)
        if not len(plain):
            return empty
        squeezed = self._squeezed(plain, part)
        first = self._judged(plain, 0)
        second = self._judged(squeezed, 1) if squeezed is not None else empty
        if not len(first.start) and not len(second.start):
            return empty
        allowed = self._all_allowed([s for s in (plain, squeezed) if s is not None], part, [first, second])
        for found in (first, second):
            found.reason[(found.reason == MATCH) & allowed.containing(found.start, found.end)] = ALLOWED
        ahead = first.reason == MATCH
        met = Spans(first.start[ahead], first.end[ahead]).overlapping(second.start, second.end)
        second.reason[(second.reason == MATCH) & met] = PRECEDED
        return Found(*(np.concatenate(x) for x in zip(*(vars(f).values() for f in (first, second)), strict=True)))

    def scan_of(self, part: Slice) -> Found:
        """The matches by start, then longest first, then term."""
        found = self.candidates_of(part)
        found = found.take(found.reason == MATCH)
        order = np.lexsort((found.term, -found.end, found.start))
        found = found.take(order)
        same = np.zeros(len(order), dtype=bool)
        same[1:] = (np.diff(found.start) == 0) & (np.diff(found.end) == 0) & (np.diff(found.term) == 0)
        found = found.take(~same)
        if self.policy.collapse_contained and len(found.start) > 1:
            before = np.concatenate([[-1], np.maximum.accumulate(found.end)[:-1]])
            found = found.take(found.end > before)
        return found

    def detect_of(self, part: Slice) -> np.ndarray:
        """Whether each text has a match. A text with a match in the plain stream is not looked at in the other, and no match is
        put in order."""
        flags = np.zeros(len(part.texts), dtype=bool)
        plain = self.normalizer.stream(part.points, part.marks)
        if not len(plain):
            return flags
        squeezed = self._squeezed(plain, part)
        both = [s for s in (plain, squeezed) if s is not None]
        for number, stream in enumerate(both):
            if flags.any():
                stream = stream.take(~flags[np.searchsorted(part.begins, stream.start, "right") - 1])
            found = self._judged(stream, number)
            found = found.take(found.reason == MATCH)
            if len(found.start):
                allowed = self._all_allowed(both, part, [found])
                flags[part.rows(found)[~allowed.containing(found.start, found.end)]] = True
        return flags

    def masks_of(self, part: Slice, found: Found) -> list[str]:
        """The texts with every stretch of matches masked."""
        out = list(part.texts)
        if not len(found.start):
            return out
        reach = np.maximum.accumulate(found.end)
        opens = np.concatenate([[True], found.start[1:] >= reach[:-1]])
        starts, ends = found.start[opens], np.append(reach[:-1][opens[1:]], reach[-1])
        row = np.searchsorted(part.begins, starts, "right") - 1
        low = part.begins[row]
        units = utf16_offsets(part.points)
        cut = zip(row.tolist(), (starts - low).tolist(), (ends - low).tolist(), (units[ends] - units[starts]).tolist(), strict=True)
        pieces: dict[int, list[str]] = {}
        last: dict[int, int] = {}
        token, char = self.policy.mask_token, self.policy.mask_char
        for k, start, end, size in cut:
            pieces.setdefault(k, []).extend((part.texts[k][last.get(k, 0) : start], char * size if token is None else token))
            last[k] = end
        for k, told in pieces.items():
            out[k] = "".join((*told, part.texts[k][last[k] :]))
        return out

    def scores_of(self, part: Slice, found: Found) -> np.ndarray:
        scores = np.zeros(len(part.texts), dtype=np.int64)
        join = np.maximum if self.policy.score_mode is ScoreMode.MAX else np.add
        join.at(scores, part.rows(found), self.severity[found.term])
        return scores

    # --- one text --------------------------------------------------------------------------------

    def candidates(self, text: str | None) -> Found:
        return self.candidates_of(next(self.slices([text])))

    def scan(self, text: str | None) -> Found:
        return self.scan_of(next(self.slices([text])))

    def detect(self, text: str | None) -> bool:
        return bool(self.detect_of(next(self.slices([text])))[0])

    def mask(self, text: str | None) -> str | None:
        part = next(self.slices([text]))
        return None if text is None else self.masks_of(part, self.scan_of(part))[0]

    def score(self, found: Found) -> int:
        severity = self.severity[found.term]
        return int(severity.max(initial=0) if self.policy.score_mode is ScoreMode.MAX else severity.sum())

    def utf16(self, text: str, found: Found) -> tuple[np.ndarray, np.ndarray]:
        if text.isascii() or not len(found.start):
            return found.start, found.end
        units = utf16_offsets(self.normalizer.points(text))
        return units[found.start], units[found.end]

    def _squeezed(self, plain: Stream, part: Slice) -> Stream | None:
        """The squeezed stream of the texts that have a run."""
        whole = self.normalizer.squeezed(plain, part.marks) if self.policy.repeat_tolerance else None
        if whole is None or not len(part.marks):
            return whole
        row = np.searchsorted(part.begins, whole.start, "right") - 1
        long = np.zeros(len(part.texts), dtype=bool)
        long[row[whole.run > 1]] = True
        return whole if long.all() else whole.take(long[row])

    def _all_allowed(self, streams: list[Stream], part: Slice, found: list[Found]) -> Spans:
        """Spans of allowed words in the texts that hold what was found."""
        wanted = np.zeros(len(part.texts), dtype=bool)
        for f in found:
            wanted[part.rows(f)] = True
        if 2 * wanted.sum() < len(wanted):
            streams = [s.take(wanted[np.searchsorted(part.begins, s.start, "right") - 1]) for s in streams]
        return Spans(*(np.concatenate(x) for x in zip(*map(self._allowed, streams), strict=True)))

    def _allowed(self, s: Stream) -> tuple[np.ndarray, np.ndarray]:
        hits = np.array(self.allow.scan(s.text()), dtype=np.int64).reshape(-1, 3)
        return s.start[hits[:, 0]], s.end[hits[:, 1]]

    def _judged(self, s: Stream, number: int) -> Found:
        automaton, owners = ((self.plain, self.squeezed)[number], self.owners[number])
        raw = automaton.scan(s.text())
        rows = [(a, b, t) for a, b, p in raw for t in owners[p]]
        at = np.array(rows, dtype=np.int64).reshape(-1, 3)
        if not self.active.all():
            at = at[self.active[at[:, 2]]]
        first, last, term = at[:, 0], at[:, 1], at[:, 2]
        if not len(first):
            return Found(first, first, term, term, term.copy())
        left = s.gap | np.concatenate([[True], ~s.hard[:-1]])
        right = np.append(s.gap[1:] | ~s.hard[1:], True)
        gaps = np.cumsum(s.gap)
        inner = gaps[last] > gaps[first]
        word = self.word[term]
        reason = np.full(len(first), MATCH)
        if number:
            short = last - first + 1 != self.length[term]
            for t in np.unique(term[short]).tolist():
                at = np.flatnonzero(short & (term == t))
                own = s.run[first[at][:, None] + np.arange(len(self.runs[t]))]
                reason[at[(own < self.runs[t]).any(axis=1)]] = RUNS
        judged = reason == MATCH
        reason[judged & word & ~(left[first] & right[last])] = EDGE
        reason[judged & ~word & inner & ~left[first]] = INNER_GAP
        return Found(s.start[first], s.end[last], term, np.full(len(first), number), reason)
