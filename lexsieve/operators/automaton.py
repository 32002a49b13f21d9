"""Multi-pattern matching: all occurrences of all patterns, in one pass."""

from __future__ import annotations

import ahocorasick


class Automaton:
    def __init__(self) -> None:
        self._trie = ahocorasick.Automaton()
        self._size = 0
        self._ready = False

    def __len__(self) -> int:
        return self._size

    def add(self, pattern: str) -> int:
        """The pattern's number; that of its first addition if it is known."""
        if self._ready:
            raise RuntimeError("patterns can't be added after build()")
        if not pattern:
            raise ValueError("a pattern must not be empty")
        found = self._trie.get(pattern, None)
        if found is not None:
            return found[0]
        self._trie.add_word(pattern, (self._size, len(pattern)))
        self._size += 1
        return self._size - 1

    def build(self) -> Automaton:
        if self._size:
            self._trie.make_automaton()
        self._ready = True
        return self

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(first index, last index, pattern) of every occurrence, by last index and then longest first."""
        if not self._ready:
            raise RuntimeError("build() comes before scan()")
        if not self._size:
            return []
        return [(last - size + 1, last, number) for last, (number, size) in self._trie.iter(text)]
