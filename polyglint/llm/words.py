"""Sums of per-word vectors over whole texts; the vector of each distinct word is computed once per worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

from polyglint.llm.common import MEMO_ENTRIES
from polyglint.llm.segments import BLOCK_CHARS, WordRows

_WHITE = re.compile(r"\s")


def blocks(text: str) -> Iterator[str]:
    """The text in parts of about BLOCK_CHARS characters, cut at white space."""
    at = 0
    while len(text) - at > 2 * BLOCK_CHARS and (m := _WHITE.search(text, at + BLOCK_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class VectorMemo:
    """Vectors of the distinct words seen so far; beyond `limit` words it starts afresh."""

    def __init__(self, compute: Callable[[list[str]], np.ndarray], width: int, limit: int = MEMO_ENTRIES):
        self.compute, self.width, self.limit = compute, width, limit
        self._clear()

    def _clear(self) -> None:
        self.row, self.table = WordRows(), np.empty((1 << 12, self.width), np.float32)

    def vectors(self, words: list[str]) -> np.ndarray:
        """A row for each word."""
        if len(self.row) > self.limit:
            self._clear()
        n = len(self.row)
        rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        if new := self.row.new:
            self.row.new = []
            while n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.empty_like(self.table)])
            self.table[n : n + len(new)] = self.compute(new)
        return self.table[rows]

    def sums(self, words_of: Callable[[str], list[str]], texts: list[str]) -> np.ndarray:
        """For each text the sum of its words' vectors (zeros for none), in double precision and alike in any batch."""
        out = np.zeros((len(texts), self.width))
        at, size, first = [], 0, 0
        for i, text in enumerate(texts):
            if len(text) > BLOCK_CHARS:
                for block in blocks(text):
                    out[i] += self.vectors(words_of(block)).sum(axis=0, dtype=np.float64)
                continue
            at.append(i)
            size += len(text)
            if size > BLOCK_CHARS:
                self._add(out, at, [words_of(texts[k]) for k in at])
                at, size = [], 0
        self._add(out, at, [words_of(texts[k]) for k in at])
        return out

    def _add(self, out: np.ndarray, at: list[int], words: list[list[str]]) -> None:
        at, words = [i for i, w in zip(at, words, strict=True) if w], [w for w in words if w]
        if at:
            starts = np.cumsum([0, *map(len, words[:-1])])
            out[at] = np.add.reduceat(self.vectors([w for part in words for w in part]).astype(np.float64), starts, axis=0)
