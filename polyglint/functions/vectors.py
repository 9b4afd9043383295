"""Cosine search over rows (id, embedding)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """Products of single-precision components, added in double; 0 for other lengths and for zero vectors."""
    zero = F.lit(0.0)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), zero, lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), zero).otherwise(dot(a, b) / F.when(norm == 0, 1.0).otherwise(norm))


def scored(vectors: DataFrame, query: Sequence[float]) -> DataFrame:
    """Adds `score`, the cosine to one query vector; Arrow batches of rows in one product."""
    q = np.asarray(query, np.float32)

    def batch(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in columns:
            out = np.zeros(len(column))
            fit = [i for i, v in enumerate(column) if v is not None and len(v) == len(q)]
            if fit:
                x = np.stack([column.iloc[i] for i in fit]).astype(np.float32)
                dot = (x * q).astype(float).sum(axis=1)
                norm = np.sqrt((x * x).astype(float).sum(axis=1)) * np.sqrt(float((q * q).astype(float).sum()))
                out[fit] = np.divide(dot, norm, out=np.zeros(len(fit)), where=norm > 0)
            yield pd.Series(out)

    return vectors.withColumn("score", F.pandas_udf(batch, "double")(F.col("embedding")))


def search(vectors: DataFrame, query: Sequence[float], k: int = 10, where: Column | None = None) -> DataFrame:
    """(id, score) of the k nearest, ties by id; the filter comes before the limit. Empty and zero vectors are skipped."""
    held = vectors.where(F.exists("embedding", lambda x: x != 0))
    held = held if where is None else held.where(where)
    return scored(held, query).orderBy(F.col("score").desc(), "id").limit(k).select("id", "score")


def collections(vectors: DataFrame, collection: Column) -> DataFrame:
    """(collection, length, dimension): what each collection holds."""
    return vectors.groupBy(collection.alias("collection")).agg(F.count(F.lit(1)).alias("length"), F.max(F.size("embedding")).alias("dimension"))


class CellIndex:
    """An index: unit vectors in the cells of seeded centroids; a search scores the `probes` nearest cells, then all whose
    widest angle leaves room for a better vector, so it finds what a search of all vectors does.

    The number of centroids is bounded, and they are fitted on a bounded sample; every vector is in a cell.
    """

    def __init__(self, vectors: DataFrame, cells: int = 32, sample: int = 5_000, seed: int = 11, rounds: int = 8):
        drawn = vectors.where(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).toPandas()
        x = np.stack(drawn["embedding"]).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        self.centroids = x[:cells].copy()
        for _ in range(rounds):
            home = (x @ self.centroids.T).argmax(axis=1)
            for c in np.unique(home):
                mean = x[home == c].mean(axis=0)
                self.centroids[c] = mean / max(np.linalg.norm(mean), 1e-12)
        centroids = self.centroids

        def cell(column: pd.Series) -> pd.DataFrame:
            x = np.stack(column).astype(float)
            near = x @ centroids.T / np.linalg.norm(x, axis=1, keepdims=True)
            return pd.DataFrame({"cell": near.argmax(axis=1).astype(np.int32), "angle": np.arccos(np.clip(near.max(axis=1), -1, 1))})

        held = vectors.where(F.exists("embedding", lambda x: x != 0))
        self.table = held.withColumn("home", F.pandas_udf(cell, "cell int, angle double")("embedding")).withColumns({"cell": F.col("home.cell"), "angle": F.col("home.angle")}).drop("home")
        self.widest: dict[int, float] = {}

    def search(self, query: Sequence[float], k: int = 10, probes: int = 16) -> DataFrame:
        q = np.asarray(query, float)
        near = self.centroids @ q / max(np.linalg.norm(q), 1e-12)
        probed = np.argsort(-near)[:probes].tolist()
        best = search(self.table.where(F.col("cell").isin(*probed)), query, k).collect()
        least = best[-1]["score"] if best and len(best) == k else -np.inf
        self.widest = self.widest or {r["cell"]: r["angle"] for r in self.table.groupBy("cell").agg(F.max("angle").alias("angle")).collect()}
        angle = np.arccos(np.clip(near, -1, 1))
        open_ = [c for c, widest in self.widest.items() if np.cos(max(0.0, angle[c] - widest)) >= least - 1e-6]
        return search(self.table.where(F.col("cell").isin(*probed, *open_)), query, k)


class IndexRegistry:
    """Collections that may be searched from SQL, with their dimensions."""

    def __init__(self) -> None:
        self._dimensions: dict[str, int] = {}

    def register(self, collection: str, dimension: int) -> None:
        self._dimensions[collection] = dimension

    def search(self, vectors: DataFrame, collection: str, query: Sequence[float], k: int, where: Column | None = None) -> DataFrame:
        """A hybrid search; raises for a collection without an index and for a query of another dimension."""
        if self._dimensions.get(collection) != len(query):
            raise ValueError(f"no index of dimension {len(query)} on {collection}")
        return search(vectors, query, k, where)


def save(vectors: DataFrame, path: str) -> None:
    """One folder for each collection, so that a search reads its own alone."""
    vectors.write.mode("overwrite").partitionBy("collection").parquet(path)


def upserted(held: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, embedding) after changes (seq, id, embedding), the last of each id; a null embedding deletes."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("embedding"), "seq").alias("c")).select("id", F.col("c.embedding").alias("embedding"))
    rest = held.join(last, "id", "left_anti").select("id", "embedding")
    return rest.unionByName(last.where("embedding is not null"))
