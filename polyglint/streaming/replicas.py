"""Merges of replicated state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counter_value(replicas: DataFrame) -> DataFrame:
    """(counter, value) of grow-only counters (counter, node, count): the sum of each node's highest count."""
    return replicas.groupBy("counter", "node").agg(F.max("count").alias("count")).groupBy("counter").agg(F.sum("count").alias("value"))


def register(writes: DataFrame) -> DataFrame:
    """(key, value): last write by (ts, node)."""
    return writes.groupBy("key").agg(F.max_by("value", F.struct("ts", "node")).alias("value"))


def version_vector(clocks: DataFrame) -> DataFrame:
    """(node, clock): pointwise maximum."""
    return clocks.groupBy("node").agg(F.max("clock").alias("clock"))
