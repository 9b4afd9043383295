"""Sorted sets as rows (key, member, score), ordered by score and then by the member's bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranks(zset: DataFrame) -> DataFrame:
    """Adds the 0-based rank and reverse rank."""
    up = Window.partitionBy("key").orderBy("score", "member")
    down = Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("member").desc())
    return zset.withColumn("rank", (F.row_number().over(up) - 1).cast("long")).withColumn("rev_rank", (F.row_number().over(down) - 1).cast("long"))


def by_index(zset: DataFrame, key: str, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """(position, member, score) from start to stop, both included, negatives from the end.

    A range from the front is the first `stop + 1` rows and needs no rank of the others.
    """
    order = [F.col("score").desc(), F.col("member").desc()] if reverse else ["score", "member"]
    own = zset.where(F.col("key") == key).select("member", "score")
    if start >= 0 and stop >= 0:
        own = own.orderBy(*order).limit(stop + 1)
    numbered = own.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    a, b = (F.lit(x) + (F.col("n") if x < 0 else 0) for x in (start, stop))
    return numbered.where((F.col("position") >= a) & (F.col("position") <= b)).select("position", "member", "score")


def score_between(low: str, high: str) -> Column:
    """Bounds as text: a number, inf, +inf or -inf; a leading ( leaves the bound itself out."""

    def bound(text: str) -> tuple[float, bool]:
        return float(text.lstrip("(")), text.startswith("(")

    (a, no_a), (b, no_b) = bound(low), bound(high)
    s = F.col("score")
    return (s > a if no_a else s >= a) & (s < b if no_b else s <= b)


def lex_between(low: str, high: str) -> Column:
    """Bounds as text: - or + (open), [member (included) or (member (left out)."""
    m = F.col("member")

    def side(text: str, lower: bool) -> Column:
        if text in "+-":
            return F.lit((text == "-") == lower)
        included, member = text[0] == "[", text[1:]
        if lower:
            return m >= member if included else m > member
        return m <= member if included else m < member

    return side(low, True) & side(high, False)


def by_score(zset: DataFrame, key: str, low: str, high: str) -> DataFrame:
    return zset.where((F.col("key") == key) & score_between(low, high)).orderBy("score", "member").select("member", "score")


def by_lex(zset: DataFrame, key: str, low: str, high: str) -> DataFrame:
    return zset.where((F.col("key") == key) & lex_between(low, high)).orderBy("member").select("member", "score")


def counts(zset: DataFrame, condition: Column) -> DataFrame:
    """(key, cardinality, matching)."""
    return zset.groupBy("key").agg(F.count(F.lit(1)).alias("cardinality"), F.count_if(condition).alias("matching"))


def folded(operations: DataFrame) -> DataFrame:
    """(key, member, score) after operations (seq, key, member, kind, score): ZADD sets, ZINCRBY adds since then, ZREM removes.

    Only operations after the last ZADD or ZREM of a member count besides it.
    """
    base = F.max(F.when(F.col("kind") != "ZINCRBY", F.col("seq"))).over(Window.partitionBy("key", "member"))
    since = operations.withColumn("base", F.coalesce(base, F.lit(-1))).where(F.col("seq") >= F.col("base"))
    final = since.groupBy("key", "member").agg(F.sum(F.when(F.col("kind") != "ZREM", F.col("score")).otherwise(0.0)).alias("score"), F.count_if(F.col("kind") != "ZREM").alias("n"))
    return final.where("n > 0").select("key", "member", "score")


def without(zset: DataFrame, condition: Column) -> DataFrame:
    return zset.where(~condition)
