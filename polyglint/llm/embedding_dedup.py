"""Near-duplicate vectors by an exact metric range join over pivot cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from polyglint.llm.common import bounded, written
from polyglint.llm.components import connected_components, local_links

MIN_COSINE = 0.98
#: Vectors that one pivot should stand for; pivots of all labels together at most, in proportion to their sizes (this bounds the
#: broadcast). Beyond it cells grow and are cut into blocks. Vectors whose distances to the pivots are held at a time.
PER_PIVOT, ALL_PIVOTS, AT_ONCE = 2_048, 4_096, 1_024
#: Rows of a cell that one block holds; a task compares two blocks.
BLOCK = 2_048


def _nodes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, node, label, vector): node names equal vectors of one label; null for vectors that link with nothing."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    node = F.concat_ws(":", F.xxhash64(label_col, vector_col), F.hash(F.lit(7), vector_col))
    return vectors.select(F.col(id_col).alias("id"), F.when(fine, node).alias("node"), F.col(label_col).cast("string").alias("label"), v.cast("array<double>").alias("vector"))


def unit(rows: list) -> np.ndarray:
    x = np.array([np.asarray(r, float) for r in rows])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pivots(nodes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Unit pivots of each (label, dimension) that is large enough to have several; ALL_PIVOTS at most over all."""
    sizes = nodes.groupBy("label", F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    share = sizes.withColumn("k", F.least(F.ceil(F.col("size") / PER_PIVOT), F.floor(F.col("size") * ALL_PIVOTS / max(total, 1)))).where("k > 1")
    drawn = nodes.withColumn("dim", F.size("vector")).join(F.broadcast(share), ["label", "dim"]).withColumn("u", F.pmod(F.xxhash64("node"), F.lit(1_000_003)))
    drawn = drawn.where(F.col("u") * F.col("size") < F.col("k") * 8 * 1_000_003).withColumn("r", F.row_number().over(Window.partitionBy("label", "dim").orderBy("u", "node"))).where("r <= k")
    found: dict[tuple[str, int], list] = {}
    for row in drawn.select("label", "dim", "vector").collect():
        found.setdefault((row["label"], row["dim"]), []).append(row["vector"])
    return {k: unit(v) for k, v in found.items()}


def assign(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector (its nearest pivot), and which cells may hold a vector within `radius` of it.

    If x is nearer to p than to q, every y of q's cell has d(x, y) >= (d(x, q) - d(x, p)) / 2, by the triangle inequality; in
    Euclidean space x is even (d(x, q)**2 - d(x, p)**2) / (2 d(p, q)) from the plane between the cells. x goes to q unless that is above the radius.
    """
    d = np.sqrt(np.maximum(0, 2 - 2 * units @ pivots.T))
    home = d.argmin(axis=1)
    near = d[np.arange(len(d)), home]
    between = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))[home]
    away = (d**2 - near[:, None] ** 2) / (2 * np.maximum(between, 1e-12))
    reach = away <= radius + 1e-6
    reach[np.arange(len(d)), home] = True
    return home, reach


def _cells(nodes: DataFrame, spark: SparkSession, min_cosine: float) -> DataFrame:
    """(cell, home, node, n, unit): each vector in its home cell and in those near enough; unit as bytes of doubles."""
    sent = spark.sparkContext.broadcast(_pivots(nodes))
    radius = math.sqrt(max(0.0, 2 - 2 * min_cosine))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.assign(dim=batch["vector"].map(len))
            for (label, dim), part in batch.groupby(["label", "dim"], sort=False):
                units, pivots = unit(part["vector"].tolist()), sent.value.get((label, dim))
                node, n = part["node"].to_numpy(), part["n"].to_numpy()
                for at in range(0, len(units), AT_ONCE):
                    own = units[at : at + AT_ONCE]
                    home, reach = (np.zeros(len(own), int), np.ones((len(own), 1), bool)) if pivots is None else assign(own, pivots, radius)
                    row, cell = np.nonzero(reach)
                    yield pd.DataFrame({"cell": [f"{label}|{dim}|{c}" for c in cell], "home": home[row] == cell, "node": node[at + row], "n": n[at + row], "unit": [own[r].tobytes() for r in row]})

    return nodes.select("label", "vector", "node", "n").mapInPandas(placed, "cell string, home boolean, node string, n long, unit binary")


def _compare(part: pd.DataFrame, min_cosine: float) -> pd.DataFrame:
    """Links among the rows of two blocks of a cell: how many each home row has, and a spanning star of each local component."""
    part = part.sort_values("node", kind="stable")
    x = np.frombuffer(b"".join(part["unit"]), float).reshape(len(part), -1)
    block, first, second = part["block"].to_numpy(), part["i"].iloc[0], part["j"].iloc[0]
    near = (x @ x.T) >= min_cosine
    if first != second:
        near &= block[:, None] != block[None, :]
    np.fill_diagonal(near, False)
    hits = np.flatnonzero(near.any(axis=1))
    near, node, home = near[np.ix_(hits, hits)], part["node"].to_numpy()[hits], part["home"].to_numpy()[hits]
    links = np.where(home, near @ part["n"].to_numpy()[hits].astype(np.int64), 0)
    return pd.DataFrame({"node": node, "links": links, "root": node[local_links(near)] if len(hits) else node})


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cosine: float = MIN_COSINE) -> DataFrame:
    """(id, n_links, component_id, kept), one row per input row: links join vectors of one label with a cosine of at least `min_cosine`.

    Equal vectors of a label are one node with a count, so copies are not compared. On unit vectors the cosine bounds the Euclidean
    distance; pivots cut each label into cells, vectors near a boundary are sent to the other cell too, and each cell
    finds the links of its home vectors alone. A large cell is cut into blocks and each pair of blocks is a task of its own,
    which returns counts and a spanning star instead of pairs. n_links counts other rows, component_id is the least id reachable.

    Null ids, null labels, and vectors that are null, empty, zero or not finite link with nothing (component_id is their own id). Vectors
    of other lengths never link. Repeated rows count as links of each other. Empty input gives no rows.
    """
    spark = vectors.sparkSession
    rows = written(_nodes(vectors, id_col, vector_col, label_col), "vectors")
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")), "nodes")
    cells = written(_cells(nodes, spark, min_cosine), "cells")
    blocks = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = cells.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "home", "node", "n", "unit")
    found = written(dealt.groupBy("cell", "i", "j").applyInPandas(lambda part: _compare(part, min_cosine), "node string, links long, root string"), "links")
    parts = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = nodes.join(counts, "node", "left").join(parts.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left")
    placed = placed.select("node", "first_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    placed = written(placed, "placed")
    named = bounded(written(placed.groupBy("component").agg(F.min("first_id").alias("component_id")), "named"))
    facts = placed.join(named, "component").select(F.col("node").alias("known"), "n_links", "component_id")
    out = rows.join(facts, rows.node == facts.known, "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
