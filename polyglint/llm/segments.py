"""Token ids of texts by segments: a text is cut where no token can cross, and each distinct segment is encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from polyglint.llm.common import MEMO_ENTRIES

#: Characters of a text that are cut into segments at a time, and of texts that are encoded together.
BLOCK_CHARS = 1 << 20


def ragged_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., starts[0] + lengths[0] - 1, then the same for the next start, and so on."""
    ends = np.cumsum(lengths)
    return np.arange(int(lengths.sum())) + np.repeat(starts - (ends - lengths), lengths)


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[starts[0] : starts[0] + lengths[0]], then the same for the next start, and so on, as one array."""
    return flat[ragged_ranges(starts, lengths)]


class WordRows(dict):
    """Segment to row number; an unknown segment gets the next one and is noted in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        row = self[segment] = len(self)
        self.new.append(segment)
        return row


class SegmentMemo:
    """Ids of the distinct segments seen so far; beyond `limit` of them it starts afresh, so memory is bounded.

    encode: a list of distinct segments to (flat ids, number of ids of each). cut: a text to its segments, whose
    ids, one after the other, are the ids of the text. safe_cut: a pattern whose matches begin a segment in any text.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], cut: Callable[[str], list[str]], safe_cut: re.Pattern, limit: int = MEMO_ENTRIES):
        self.encode, self.cut, self.safe_cut, self.limit = encode, cut, safe_cut, limit
        self._clear()

    def _clear(self) -> None:
        self.row = WordRows()
        self.flat, self.used = np.empty(1 << 16, np.int32), 0
        self.starts, self.lengths = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64)

    def rows(self, segments: list[str]) -> np.ndarray:
        if len(self.row) > self.limit:
            self._clear()
        n = len(self.row)
        rows = np.fromiter(map(self.row.__getitem__, segments), np.int64, len(segments))
        if self.row.new:
            ids, lengths = self.encode(self.row.new)
            m = len(self.row.new)
            self.row.new = []
            while self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
            while n + m > len(self.starts):
                self.starts, self.lengths = (np.concatenate([a, np.empty_like(a)]) for a in (self.starts, self.lengths))
            self.flat[self.used : self.used + len(ids)] = ids
            self.lengths[n : n + m] = lengths
            self.starts[n : n + m] = self.used + np.cumsum(lengths) - lengths
            self.used += len(ids)
        return rows

    def blocks(self, text: str) -> Iterator[str]:
        """The text in parts of about BLOCK_CHARS, cut where a segment begins."""
        at = 0
        while len(text) - at > 2 * BLOCK_CHARS and (m := self.safe_cut.search(text, at + BLOCK_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    def ids(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        waiting: list[str] = []
        size = 0
        for text in texts:
            if len(text) > BLOCK_CHARS:
                yield from self._together(waiting)
                waiting, size = [], 0
                yield np.concatenate([x for block in self.blocks(text) for x in self._together([block])])
                continue
            waiting.append(text)
            size += len(text)
            if size > BLOCK_CHARS:
                yield from self._together(waiting)
                waiting, size = [], 0
        yield from self._together(waiting)

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        if not texts:
            return
        cut = [self.cut(t) for t in texts]
        segments = [s for part in cut for s in part]
        rows = self.rows(segments)
        lengths = self.lengths[rows]
        ids = ragged_take(self.flat, self.starts[rows], lengths)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, cut)])]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield ids[a:b]
