"""SentencePiece BPE encoding by vectorised merge rounds, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polyglint.llm.common import memo
from polyglint.llm.segments import SegmentMemo

SPACE = "▁"
NEVER = np.int64(1) << 30
#: Longer words are merged one pair at a time from a heap: rounds would cost the square of the length.
LONG_WORD = 256
#: Characters whose results are held at a time, and words that a worker remembers.
BATCH_CHARS, MEMO_WORDS = 2_000_000, 300_000


class PieceModel:
    """A BPE model of the sentencepiece library, with byte fallback and no normalisation but for spaces.

    Symbols are piece ids; a character that is no piece is the symbol `size + code point`. A pair of symbols may merge
    if their concatenation is a piece; a higher score goes first, then the leftmost place.
    """

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = size = sp.get_piece_size()
        usual = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in usual):
            raise ValueError("models with unused pieces are not supported")
        pieces = {sp.id_to_piece(i): i for i in usual}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if not all(sp.is_byte(int(i)) for i in self.bytes):
            raise ValueError("models without byte fallback are not supported")
        self.symbol = np.arange(0x110000, dtype=np.int64) + size
        for piece, i in pieces.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in usual}, reverse=True))}
        self.base = size + 0x110000
        found: dict[int, tuple[int, int]] = {}
        for piece, i in pieces.items():
            for k in range(1, len(piece)):
                left, right = (pieces.get(x, self.symbol[ord(x)] if len(x) == 1 else None) for x in (piece[:k], piece[k:]))
                if left is not None and right is not None:
                    found[int(left) * self.base + int(right)] = (order[sp.get_score(i)], i)
        self.pairs = found
        self.keys = np.array(sorted(found), np.int64)
        self.ranks, self.merged = (np.array([found[k][x] for k in self.keys.tolist()], np.int64) for x in (0, 1))
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        lines = not any("\n" in p for p in pieces if len(p) > 1)
        if inner:
            self.segment, self.safe_cut = re.compile(r"(?s).+"), re.compile(r"(?!)")
        else:
            self.segment, self.safe_cut = re.compile(r"\n| *[^ \n]+| +" if lines else r" *[^ ]+| +"), re.compile(r"(?<=[^ ]) ")
        for probe in ("a", "  two  spaces ", "\tx\n\n y▁z ﬁ 一\U0001f600é\x00 \n  ", "<s>\n \n<0x0A>"):
            if self.encode_whole(probe).tolist() != sp.encode(probe):
                raise ValueError("this model normalises texts in a way that is not supported")

    def escape(self, text: str) -> str:
        """The text as it is cut and encoded: a space in front, and the library's own sign for a space as a space."""
        return " " + text.replace(SPACE, " ") if text else ""

    def cut(self, escaped: str) -> list[str]:
        return self.segment.findall(escaped)

    def encode_whole(self, text: str) -> np.ndarray:
        return self.encode_segments(self.cut(self.escape(text)))[0]

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if they don't merge) and merged symbol of each pair."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.merged[at]

    def encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all segments, and how many each has."""
        if not segments:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        chars = np.frombuffer("".join(segments).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = self.symbol[chars]
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        words = np.repeat(np.arange(len(segments)), lengths)
        long = lengths > LONG_WORD
        done_words, done_symbols = [], []
        for w in np.flatnonzero(long).tolist():
            out = self._merge_long(symbols[words == w].tolist())
            done_words.append(np.full(len(out), w))
            done_symbols.append(np.array(out, np.int64))
        keep = ~long[words]
        for w, s in self._rounds(words[keep], symbols[keep]):
            done_words.append(w)
            done_symbols.append(s)
        words, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(words, kind="stable")
        return self._to_ids(words[order], symbols[order], len(segments))

    def _rounds(self, words: np.ndarray, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each round merges, in every word at once, the leftmost of its pairs of least rank, and drops the words that have none."""
        if not len(words):
            return
        rank, merged = np.full(len(words), NEVER), np.zeros(len(words), np.int64)
        inside = np.flatnonzero(words[1:] == words[:-1])
        rank[inside], merged[inside] = self.look_up(symbols[inside], symbols[inside + 1])
        while len(words):
            starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
            best = np.minimum.reduceat((rank << 32) | np.arange(len(words)), starts)
            over = (best >> 32) == NEVER
            at = best[~over] & 0xFFFFFFFF
            keep = np.ones(len(words), bool)
            if over.any():
                ended = np.repeat(over, np.diff(np.append(starts, len(words))))
                yield words[ended], symbols[ended]
                keep &= ~ended
            if not len(at):
                return
            symbols[at] = merged[at]
            keep[at + 1] = False
            rank[at] = rank[at + 1]
            place = np.cumsum(keep) - 1
            words, symbols, rank, merged = words[keep], symbols[keep], rank[keep], merged[keep]
            at = place[at]
            same = (at + 1 < len(words)) & (words[np.minimum(at + 1, len(words) - 1)] == words[at])
            rank[at[~same]] = NEVER
            touched = np.concatenate([at[same], at[(at > 0) & (words[at - 1] == words[at])] - 1])
            rank[touched], merged[touched] = self.look_up(symbols[touched], symbols[touched + 1])

    def _merge_long(self, symbols: list[int]) -> list[int]:
        """The same merges for one long word: linked symbols and a heap of (rank, place)."""
        n = len(symbols)
        after, before, alive = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (hit := self.pairs.get(symbols[i] * self.base + symbols[j])):
                heapq.heappush(heap, (hit[0], i, symbols[i], symbols[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue
            symbols[i] = self.pairs[left * self.base + right][1]
            alive[j] = False
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s, a in zip(symbols, alive, strict=True) if a]

    def _to_ids(self, words: np.ndarray, symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        strange = np.flatnonzero(symbols >= self.size)
        if len(strange):
            points = symbols[strange] - self.size
            counts = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
            repeats = np.ones(len(symbols), np.int64)
            repeats[strange] = counts
            starts = (np.cumsum(repeats) - repeats)[strange]
            words, symbols = np.repeat(words, repeats), np.repeat(symbols, repeats)
            data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            symbols[np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = self.bytes[data]
        return symbols.astype(np.int32), np.bincount(words, minlength=n)


def _loaded(path: str) -> tuple[PieceModel, SegmentMemo]:
    def load() -> tuple[PieceModel, SegmentMemo]:
        model = PieceModel(path)
        return model, SegmentMemo(model.encode_segments, model.cut, model.safe_cut, MEMO_WORDS)

    return memo(f"pieces of {path}", load)


def encode_texts(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """The ids of each text."""
    model, memo = _loaded(path)
    return memo.ids(map(model.escape, texts))


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", digest: bool = True) -> DataFrame:
    """All columns of `docs` and a struct `pieces`: n_tokens, then ids_sha256 and decoded_sha256 or (digest=False) ids and decoded.

    Whole texts are encoded as the sentencepiece library encodes them, without begin or end ids, and the library decodes
    the ids. Null is as empty: no ids, an empty text. `path` must be readable on every executor. Narrow: no shuffle;
    results leave in batches of about BATCH_CHARS characters. An input column named `pieces` is replaced.
    """
    kept = docs.select(*(F.col(c) for c in docs.columns if c != "pieces"))
    at = kept.columns.index(text_col)

    def packed(texts: list[str]) -> pa.StructArray:
        library, ids = _loaded(path)[0].library, list(encode_texts(texts, path))
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        decoded, digests = [], []
        for one in ids:
            listed = one.tolist()
            text = library.decode(listed) if listed else ""
            decoded.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
            if digest:
                digests.append(hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest())
        if digest:
            return pa.StructArray.from_arrays([pa.array(lengths), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])
        flat = pa.array(np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), flat)
        return pa.StructArray.from_arrays([pa.array(lengths), lists, pa.array(decoded, pa.string())], ["n_tokens", "ids", "decoded"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum([len(t) for t in (x.as_py() or "" for x in batch.column(at))])
            ends = [*np.flatnonzero(np.diff(sizes // BATCH_CHARS)) + 1, len(sizes)]
            for start, end in zip([0, *ends], ends, strict=False):
                if end > start:
                    part = batch.slice(start, end - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, packed([t or "" for t in part.column(at).to_pylist()])], [*part.schema.names, "pieces"])

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "n_tokens long, ids array<int>, decoded string"
    return kept.mapInArrow(coded, T.StructType([*kept.schema.fields, T.StructField("pieces", T.StructType.fromDDL(fields))]))
