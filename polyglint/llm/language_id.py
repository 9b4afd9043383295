"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglint.llm.words import VectorMemo, blocks

ORDER = 5
#: Bound of the training sample: documents of each language, whole texts of any length.
TRAIN_DOCS = 1_000
UNKNOWN = "und"


class PartialMatching:
    """Frozen statistics of one variable-order context tree of bytes for each language.

    Words (lower-cased, between white space) are coded byte by byte, then their end. The context of a byte is the
    word's start and up to `order` bytes of the word before it; it never leaves the word, so that a word's code length is computed once
    (which loses what a language's word order says). In a context seen n times with d different
    successors, a successor seen c times has probability c / (n + d), and the escape to the context one byte shorter d / (n + d);
    an unseen context costs nothing, and below the empty one all 256 bytes are alike.
    """

    def __init__(self, langs: list[str], counts: list[Counter], order: int = ORDER):
        self.langs, self.order, self.levels = langs, order, []
        words = sorted(set().union(*counts)) if counts else []
        times = np.array([[c[w] for c in counts] for w in words], float).reshape(len(words), len(langs))
        flat, word, depth = self._bytes(words)
        for n in range(order + 1):
            at = np.flatnonzero(depth >= max(n, 1))
            keys, of = np.unique(self._keys(flat, at, n), return_inverse=True)
            seen = np.stack([np.bincount(of, times[word[at], k], len(keys)) for k in range(len(langs))], axis=1) if langs else np.zeros((len(keys), 0))
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, kinds = np.zeros((len(contexts), len(langs))), np.zeros((len(contexts), len(langs)))
            np.add.at(total, of, seen)
            np.add.at(kinds, of, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                own = -np.log2(seen / (total + kinds)[of])
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            self.levels.append((keys, own.astype(np.float32), of, contexts, escape.astype(np.float32)))

    @staticmethod
    def _bytes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all words, each after and before a space; the word of each byte, and how many bytes of it stand before."""
        data = [b" " + w.encode("utf-8", "surrogatepass") + b" " for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        word = np.repeat(np.arange(len(data)), lengths)
        return np.frombuffer(b"".join(data), np.uint8), word, np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    @staticmethod
    def _keys(flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """The n bytes before each place and its own, as one number."""
        key = np.zeros(len(at), np.uint64)
        for k in range(n, -1, -1):
            key = key << np.uint64(8) | flat[at - k]
        return key

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits of each word (a row) in each language (a column)."""
        flat, word, depth = self._bytes(words)
        at = np.flatnonzero(depth > 0)
        bits = np.full((len(at), len(self.langs)), 8.0, np.float32)
        open_ = np.arange(len(at))
        for n, (keys, own, context_of, contexts, escape) in enumerate(self.levels):
            open_ = open_[depth[at[open_]] >= n]
            if not len(open_) or not len(keys):
                break
            key = self._keys(flat, at[open_], n)
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[k] == key
            c = np.minimum(np.searchsorted(contexts, key >> np.uint64(8)), len(contexts) - 1)
            known = contexts[c] == key >> np.uint64(8)
            open_, k, hit, c = open_[known], k[known], hit[known], c[known]
            shorter = bits[open_] + escape[c]
            bits[open_] = np.where(hit[:, None] & np.isfinite(own[k]), own[k], shorter)
        out = np.zeros((len(words), len(self.langs)))
        np.add.at(out, word[at], bits)
        return out


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, train_docs: int = TRAIN_DOCS) -> PartialMatching:
    """Statistics of at most `train_docs` whole documents of each language, drawn by a hash from the rows where `learn` holds.

    Words are counted on the executors; the driver gets the distinct words of the sample and how often each language has them.
    Equal texts are drawn together as far as the bound allows, and count as often as they are drawn; ties change nothing, as they are alike.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return PartialMatching([], [])
    share = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.3 * train_docs / n + 30 / n))))
    drawn = rows.withColumn("u", F.xxhash64("text")).where(F.pmod("u", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u"))).where(F.col("k") <= train_docs)

    def split(texts: pd.Series) -> pd.Series:
        return pd.Series([[word for block in blocks(t) for word in words_of(block)] for t in texts], dtype=object)

    counts: dict[str, Counter] = {lang: Counter() for lang in sorted(sizes)}
    words = drawn.select("lang", F.explode(F.pandas_udf(split, "array<string>")("text")).alias("word")).groupBy("lang", "word").count()
    for row in words.toLocalIterator():
        counts[row["lang"]][row["word"]] = row["count"]
    return PartialMatching([*counts], [*counts.values()], order)


def words_of(text: str) -> list[str]:
    return text.lower().split()


_MEMOS: dict[str, VectorMemo] = {}


def identify(docs: DataFrame, model: PartialMatching, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and a struct `language`: lang_pred (the language with the shortest code, the first by name in
    a tie) and score, its probability by the code lengths if all languages are as likely beforehand.

    A null text, one without a letter, and any text if no language was learned get `und` and 0.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        if key not in _MEMOS:
            _MEMOS.clear()
            _MEMOS[key] = VectorMemo(own.code_lengths, len(own.langs))
        for texts in batches:
            texts = [t or "" for t in texts]
            letters = np.array([any(map(str.isalpha, t)) for t in texts], bool) & bool(own.langs)
            if own.langs:
                bits = _MEMOS[key].sums(words_of, texts)
                best = bits.argmin(axis=1)
                score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
            else:
                best, score = np.zeros(len(texts), int), np.zeros(len(texts))
            yield pd.DataFrame({"lang_pred": np.where(letters, np.array([*own.langs, UNKNOWN], object)[best], UNKNOWN), "score": np.where(letters, score, 0.0)})

    return docs.withColumn("language", F.pandas_udf(predicted, "lang_pred string, score double")(F.col(text_col)))
