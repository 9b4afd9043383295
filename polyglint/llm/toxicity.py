"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyglint.llm.words import blocks

BUCKETS, FACTORS, SEED = 1 << 20, 8, 7
#: A bucket gets weights if so many training rows have it.
MIN_DOCS = 5
#: Two machines are fitted on four fifths of the sample, and the one with the lesser loss on the last fifth is fitted on all of it. The first
#: has weights only for buckets whose share of the rows differs between the labels by so many standard errors, the second for
#: all frequent ones, so that terms count that tell the labels apart only in pairs; its vectors start larger and move faster, as no
#: weight leads them. (standard errors, epochs, spread of the first vectors, first sum of squared gradients)
KINDS = ((4.0, 40, 0.01, 1e-1), (0.0, 15, 0.1, 1e-4))
#: Longer terms also count by so many leading letters, so that unseen derived forms of a term are known by their stem.
STEM = 5
#: Bound of the training sample, in labelled rows.
TRAIN_ROWS = 12_000
TERM = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def buckets(term: str) -> list[int]:
    """The bucket of a term and, if it is longer, of its stem."""
    return [bucket(term), bucket(f"{term[:STEM]}*")] if len(term) > STEM else [bucket(term)]


def buckets_of(text: str) -> np.ndarray:
    """The distinct buckets of a text's terms, ascending."""
    found: set[str] = set()
    for block in blocks(text):
        found.update(terms_of(block))
    return np.unique(np.fromiter((b for term in found for b in buckets(term)), np.int64))


class FactorizationMachine:
    """Logistic model of term presence: a bias, a weight for each bucket, and for each pair of buckets the product of their vectors.

    Only buckets of MIN_DOCS rows whose shares differ by `min_z` standard errors have weights; others count as absent. Fitted by
    AdaGrad on batches in a seeded order, so equal rows give equal models.
    """

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, min_z: float = 0.0, epochs: int = 15, spread: float = 0.1, first: float = 1e-4, factors: int = FACTORS):
        toxic = labels == 1
        with_, clean = (np.bincount(np.concatenate([np.empty(0, np.int32), *(r for r, t in zip(rows, toxic, strict=True) if t == side)]), minlength=BUCKETS) for side in (True, False))
        n1, n0, count = max(1, toxic.sum()), max(1, (~toxic).sum()), with_ + clean
        share = count / (n1 + n0)
        z = np.abs(with_ / n1 - clean / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
        self.column = np.full(BUCKETS, -1, np.int32)
        kept = np.flatnonzero((count >= MIN_DOCS) & (z >= min_z))
        self.column[kept] = np.arange(len(kept))
        del with_, clean, count, share, z
        rng = np.random.default_rng(SEED)
        self.bias = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)))
        self.weights, self.vectors = np.zeros(len(kept)), rng.normal(0, spread, (len(kept), factors))
        rows = [c[c >= 0] for c in (self.column[r] for r in rows)]
        self._fit(rows, labels.astype(float), rng, epochs, first)

    def _fit(self, rows: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator, epochs: int, first_square: float, batch: int = 128, rate: float = 0.5, l2: float = 1e-5) -> None:
        g_bias, g_weights, g_vectors = 1.0, np.full(len(self.weights), 1e-2), np.full(self.vectors.shape, first_square)
        if not (0 < labels.sum() < len(labels)):
            return
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                part = order[at : at + batch]
                full = np.array([len(rows[i]) > 0 for i in part])
                blank = (sigmoid(np.array(self.bias)) - labels[part[~full]]).sum()
                part, size = part[full], len(part)
                if not len(part):
                    g_bias += (blank / size) ** 2
                    self.bias -= rate * blank / size / np.sqrt(g_bias)
                    continue
                columns = np.concatenate([rows[i] for i in part])
                lengths = np.array([len(rows[i]) for i in part])
                own, sums, starts = self.vectors[columns], None, np.cumsum(lengths) - lengths
                sums = np.add.reduceat(own, starts, axis=0)
                logit = self.bias + np.add.reduceat(self.weights[columns], starts) + 0.5 * (sums**2 - np.add.reduceat(own**2, starts, axis=0)).sum(axis=1)
                error = sigmoid(logit) - labels[part]
                each = np.repeat(error, lengths)
                grad = each[:, None] * (np.repeat(sums, lengths, axis=0) - own)
                place = np.argsort(columns, kind="stable")
                uniq, first = np.unique(columns[place], return_index=True)
                gw = np.add.reduceat(each[place], first) / len(part) + l2 * self.weights[uniq]
                gv = np.add.reduceat(grad[place], first, axis=0) / len(part) + l2 * self.vectors[uniq]
                gb = (error.sum() + blank) / size
                g_bias += gb * gb
                g_weights[uniq] += gw * gw
                g_vectors[uniq] += gv * gv
                self.bias -= rate * gb / np.sqrt(g_bias)
                self.weights[uniq] -= rate * gw / np.sqrt(g_weights[uniq])
                self.vectors[uniq] -= 0.3 * rate * gv / np.sqrt(g_vectors[uniq])

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each row of distinct columns (see `column`)."""
        logit = np.full(len(rows), self.bias)
        full = [i for i, r in enumerate(rows) if len(r)]
        if full:
            columns = np.concatenate([rows[i] for i in full])
            starts = np.cumsum([0, *(len(rows[i]) for i in full[:-1])])
            own = self.vectors[columns]
            logit[full] += np.add.reduceat(self.weights[columns], starts) + 0.5 * (np.add.reduceat(own, starts, axis=0) ** 2 - np.add.reduceat(own**2, starts, axis=0)).sum(axis=1)
        return sigmoid(logit)


    def loss(self, rows: list[np.ndarray], labels: np.ndarray) -> float:
        """Mean log loss on rows of buckets."""
        known = (self.column[r] for r in rows)
        p = np.clip(self.scores([c[c >= 0] for c in known]), 1e-6, 1 - 1e-6)
        return float(-np.mean(np.where(labels == 1, np.log(p), np.log(1 - p))))


def fitted(rows: list[np.ndarray], labels: np.ndarray) -> FactorizationMachine:
    """The machine of the kind that loses less on a fifth of the rows that it has not learned from, fitted on all rows; the first of KINDS where there are too few rows to tell."""
    held = np.random.default_rng(SEED).random(len(rows)) < 0.2
    kind = KINDS[0]
    if all(0 < labels[part].sum() < part.sum() for part in (held, ~held)):
        split = [[r for r, h in zip(rows, held, strict=True) if h == side] for side in (True, False)]
        loss = [FactorizationMachine(split[1], labels[~held], *k).loss(split[0], labels[held]) for k in KINDS]
        kind = KINDS[int(np.argmin(loss))]
    return FactorizationMachine(rows, labels, *kind)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> FactorizationMachine:
    """Fit on at most `train_rows` labelled rows, drawn by a hash of the id from those where `learn` (of the id) holds.

    Only the drawn rows' ids and labels are broadcast, and only their term hashes reach the driver. Rows whose id, label
    or text is null are not learned from; a document with several labels counts for each.
    """
    known = labels.where(learn & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    total = known.count()
    share = int(min(1.0, train_rows / max(total, 1)) * 1_000_003)
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) <= share).orderBy(F.xxhash64("id"), "id", "y").limit(train_rows)

    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([buckets_of(t) for t in texts], dtype=object)

    found = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    rows = found.select("id", "y", F.pandas_udf(hashed, "array<long>")("text").alias("b")).toPandas().sort_values(["id", "y"], kind="stable")
    buckets_, y = [np.asarray(b, np.int32) for b in rows["b"]], rows["y"].to_numpy(float)
    del rows
    return fitted(buckets_, y)


class _Columns(dict):
    """Term to its columns of the machine; most terms have none."""

    def __init__(self, column: np.ndarray):
        super().__init__()
        self.column = column

    def __missing__(self, term: str) -> tuple[int, ...]:
        found = self[term] = tuple(int(c) for c in self.column[buckets(term)] if c >= 0)
        return found


_COLUMNS: dict[str, _Columns] = {}


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", memo: int = 1_000_000) -> DataFrame:
    """All columns of `docs` and `score` (double, 0 to 1) for the whole text; null and empty texts get the bias alone."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = sent.value
        for texts in batches:
            if key not in _COLUMNS or len(_COLUMNS[key]) > memo:
                _COLUMNS.clear()
                _COLUMNS[key] = _Columns(own.column)
            of = _COLUMNS[key].__getitem__
            rows = []
            for text in texts:
                found: set[int] = set()
                for block in blocks(text or ""):
                    found.update(chain.from_iterable(map(of, terms_of(block))))
                rows.append(np.array(sorted(found), np.int64))
            yield pd.Series(np.concatenate([own.scores(rows[at : at + 200]) for at in range(0, len(rows), 200)]) if rows else np.empty(0))

    return docs.withColumn("score", F.pandas_udf(scored, "double")(F.col(text_col)))
