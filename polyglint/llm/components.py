"""Connected components of a distributed edge list by alternating star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyglint.llm.common import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges (u, v), ascending, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            nodes, least = least_reached(*(np.concatenate([p[c].to_numpy() for p in parts]) for c in "uv"))
            yield pd.DataFrame({"node": nodes, "component": least})

    return edges.coalesce(1).mapInPandas(labelled, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, rounds: int = 60, together: int = 0) -> DataFrame:
    """(node, component) for every node of `edges` (columns u, v of one orderable type); component is its smallest node.

    Each round runs a large-star step (larger neighbours move to the smallest neighbour) and a small-star step
    (smaller neighbours and the node itself do). Neighbour lists are never gathered: minima are pre-aggregated, then
    joined back, so that a hub is split by the adaptive skew join. Edges with a null end and self loops are ignored;
    repeated edges count once; no edges give no rows. Each round ends in a table of the shared folder. Up to `together` edges between numbers are looked at
    in one task instead, so that a small graph does not cost some hundred small stages and the driver's memory of them.
    """
    e = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(e)
    if 0 < state[0] <= together:
        return _in_one_task(e)
    for _ in range(rounds):
        if not state[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        before, state = state, _state(e)
        if before == state:
            break
    else:
        raise RuntimeError(f"components still changed after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def local_links(near: np.ndarray) -> np.ndarray:
    """The first member of each row's component in a symmetric boolean matrix."""
    root = np.full(len(near), -1)
    for i in range(len(near)):
        if root[i] < 0:
            found = front = near[i] & (root < 0)
            found[i] = True
            while front.any():
                front = near[front].any(axis=0) & (root < 0) & ~found
                found = found | front
            root[found] = i
    return root
