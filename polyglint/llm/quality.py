"""Quality scores by co-training: a content view and a metadata view teach each other, then vote with calibrated odds."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyglint.llm.common import HASH_ENTRIES, memo
from polyglint.llm.words import blocks

#: Bounds of the sample that models are fitted on: labelled rows, and unlabelled ones that get pseudo-labels.
TRAIN_ROWS, POOL_ROWS = 10_000, 4_000
#: Rounds of exchange; how sure a view must be to teach, and how many rows of each class it may in a round.
ROUNDS, SURE, TAUGHT = 3, 0.98, 200
KEEP = 0.5
#: Rows of each label that calibration needs among the held ones.
FEW = 10
_CLASSES = [range(65, 91), range(97, 123), range(48, 58), range(128, 256), [33], [124], [46, 44], [10], [32, 9], [*range(35, 39), 42], [*range(34, 35), *range(39, 42), 43, 45, *range(47, 48), *range(58, 65), *range(91, 97), 123, 125, 126]]
_OF_CLASS = np.zeros((256, len(_CLASSES)))
for _k, _bytes in enumerate(_CLASSES):
    _OF_CLASS[list(_bytes), _k] = 1.0
#: Buckets of the words' hashes, whose shares are facts of the text.
WORD_BUCKETS = 96
RATIOS = len(_CLASSES) + 4
CONTENT = RATIOS + WORD_BUCKETS
#: Values of a metadata column with an indicator of their own (the most frequent of the sample, ties by name), and buckets that the others share by a hash.
LEVELS, SHARED = 200, 32


def content(text: str | None) -> np.ndarray:
    """Facts of a whole text: shares of byte classes, word length, richness of its vocabulary, repeats side by side, shares of word buckets.

    The size is left to the metadata view.
    """
    bytes_, n, letters, repeats, kinds, last, hashed = np.zeros(256), 0, 0, 0, set(), None, np.zeros(WORD_BUCKETS)
    known = memo("quality", _Buckets)
    if len(known) > HASH_ENTRIES:
        known.clear()
    for block in blocks(text or ""):
        words = block.split()
        bytes_ += np.bincount(np.frombuffer(block.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        n += len(words)
        letters += sum(map(len, words))
        repeats += sum(map(eq, words, words[1:])) + bool(words and words[0] == last)
        kinds.update(words)
        hashed += np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), minlength=WORD_BUCKETS)
        last = words[-1] if words else last
    shares = np.log(bytes_ @ _OF_CLASS / max(bytes_.sum(), 1) + 1e-3)
    more = [letters / max(n, 1), np.log(len(kinds) + 1) / np.log(n + 2), np.log(repeats / max(n, 1) + 1e-2), len(kinds) / max(n, 1)]
    return np.concatenate([shares, more, np.sqrt(hashed / max(n, 1))])


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        found = self[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        return found


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int = 25) -> np.ndarray:
    """Weights of a penalised logistic regression by Newton's method; the last column of x is the bias and free."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (p - y) + penalty * w)
        w -= step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class View:
    """Standardised features, the first `squared` of them with squares, a logistic regression and a calibration of its odds."""

    l2: float
    squared: int
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)
    calibration: tuple[float, float] = (1.0, 0.0)

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.hstack([z, z[:, : self.squared] ** 2, np.ones((len(x), 1))])

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        if self.mean is None:
            self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.weights = _logistic(self.design(x), y, self.l2)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.calibration[0] * (self.design(x) @ self.weights) + self.calibration[1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Two parameters fitted on rows that the view has not learned from, with targets that leave room for doubt."""
        self.calibration = (1.0, 0.0)
        good, bad = y.sum(), len(y) - y.sum()
        soft = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
        a, b = _logistic(np.stack([self.odds(x), np.ones(len(x))], axis=1), soft, 1e-3)
        self.calibration = (max(float(a), 0.0), float(b))


class CoTraining:
    """The fitted views; without rows of both labels every score is the share of label 1 (0.5 for no rows)."""

    def __init__(self, rows: pd.DataFrame, pool: pd.DataFrame, rounds: int = ROUNDS):
        """rows: content, source, lang, n_chars, y, and held (True: for calibration); pool: the same without y."""
        y = rows["y"].to_numpy(float)
        self.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.levels = {c: {v: k for k, (v, _) in enumerate(sorted(Counter(rows[c].dropna()).items(), key=lambda x: (-x[1], x[0]))[:LEVELS])} for c in ("source", "lang")}
        self.fitted = 0 < y.sum() < len(y)
        if not self.fitted:
            return
        held = rows["held"].to_numpy(bool)
        learned = ~held
        if min(y[held].sum(), (1 - y[held]).sum()) < FEW:  # too few for a calibration of their own: all rows serve both
            held = learned = np.ones(len(y), bool)
        self.views = (View(1.0, RATIOS), View(5.0, 1))
        x, u = self.features(rows), self.features(pool)
        taught: list[dict[int, float]] = [{}, {}]
        for turn in range(rounds + 1):
            for view, own, new, extra in zip(self.views, x, u, taught, strict=True):
                at = [*extra]
                view.fit(np.vstack([own[learned], new[at]]), np.concatenate([y[learned], [extra[i] for i in at]]))
            if turn == rounds or not len(pool):
                break
            for teacher, pupil in ((0, 1), (1, 0)):
                p = sigmoid(self.views[teacher].odds(u[teacher]))
                order = np.argsort(-p, kind="stable")
                best = [i for i in order if p[i] >= SURE and i not in taught[pupil]][:TAUGHT]
                worst = [i for i in order[::-1] if p[i] <= 1 - SURE and i not in taught[pupil]][:TAUGHT]
                taught[pupil].update({**dict.fromkeys(best, 1.0), **dict.fromkeys(worst, 0.0)})
        for view, own in zip(self.views, x, strict=True):
            view.calibrate(own[held], y[held])

    def features(self, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        text = np.array(rows["content"].tolist(), float).reshape(len(rows), CONTENT)
        chars = pd.to_numeric(rows["n_chars"]).to_numpy(float, na_value=np.nan)
        parts = [np.where(np.isnan(chars), 0, np.log1p(np.maximum(np.nan_to_num(chars), 0)))[:, None], np.isnan(chars)[:, None].astype(float)]
        for column, levels in self.levels.items():
            other = lambda v: 0 if v is None or v != v else 1 + zlib.crc32(str(v).encode("utf-8", "surrogatepass")) % SHARED
            hot = np.zeros((len(rows), 1 + SHARED + len(levels)))
            hot[np.arange(len(rows)), [1 + SHARED + levels[v] if v in levels else other(v) for v in rows[column]]] = 1
            parts.append(hot)
        return text, np.hstack(parts)

    def scores(self, rows: pd.DataFrame) -> pd.DataFrame:
        """p_content, p_metadata, and score, in which the odds of both count, the prior once."""
        if not self.fitted:
            p = np.full(len(rows), sigmoid(np.array(self.prior)))
            return pd.DataFrame({"p_content": p, "p_metadata": p, "score": p})
        a, b = (view.odds(x) for view, x in zip(self.views, self.features(rows), strict=True))
        return pd.DataFrame({"p_content": sigmoid(a), "p_metadata": sigmoid(b), "score": sigmoid(a + b - self.prior)})


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, pool_rows: int = POOL_ROWS) -> CoTraining:
    """Fit on at most `train_rows` labelled rows and `pool_rows` other rows, drawn by hashes of their ids.

    Only the drawn ids and labels are broadcast, and only features of drawn rows reach the driver. A fifth of the labelled rows, by
    hash, is held for calibration. Null ids, labels and texts are not learned from; a document with several labels counts for each.
    """
    grid = 1_000_003
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    share = int(min(1.0, train_rows / max(known.count(), 1)) * grid)
    drawn = known.where(F.pmod(F.xxhash64("id"), F.lit(grid)) <= share).orderBy(F.xxhash64("id"), "id", "y").limit(train_rows)
    pool_share = int(min(1.0, pool_rows / max(docs.count(), 1)) * grid)
    mark = F.pmod(F.xxhash64("id", F.lit("pool")), F.lit(grid))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), "source", "lang", "n_chars").where("text is not null and id is not null")
    rows = rows.join(F.broadcast(drawn), "id", "left").where(F.col("y").isNotNull() | (mark <= pool_share))
    facts = F.pandas_udf(lambda texts: pd.Series([content(t) for t in texts], dtype=object), "array<double>")
    found = rows.select("id", "y", "source", "lang", "n_chars", facts("text").alias("content"), (F.pmod(F.xxhash64("id", F.lit("held")), F.lit(5)) == 0).alias("held")).toPandas()
    found = found.sort_values(["id", "y"], kind="stable").reset_index(drop=True)
    return CoTraining(found[found["y"].notna()].reset_index(drop=True), found[found["y"].isna()].head(2 * pool_rows).reset_index(drop=True))


def score(docs: DataFrame, model: CoTraining, text_col: str = "text") -> DataFrame:
    """All columns of `docs` and a struct `quality`: p_content, p_metadata, score (0 to 1, higher: label 1 likelier).

    Whole texts are read; null is as empty; sources and languages without an indicator of their own share 32 by a hash. Narrow: no shuffle.
    An input column named `quality` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts, source, lang, chars in batches:
            yield own.scores(pd.DataFrame({"content": [content(t) for t in texts], "source": source, "lang": lang, "n_chars": chars}))

    udf = F.pandas_udf(scored, "p_content double, p_metadata double, score double")
    return docs.withColumn("quality", udf(F.col(text_col), F.col("source"), F.col("lang"), F.col("n_chars").cast("double")))


def keeps(score: Column) -> Column:
    return score >= KEEP
