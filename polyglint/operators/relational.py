"""Joins and aggregates over keyed rows, in one phase, in two, and over federated shards."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AGGREGATES = ("COUNT", "SUM", "AVG")
_WRAP = "18446744073709551616"


def hash_join(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column) -> DataFrame:
    """Inner equi-join of (key, value) rows: the left key, and both values as text with a pipe between them."""
    a = left.select(F.col("key"), F.col("value").cast("string").alias("left_value"), left_key.alias("on_left"))
    b = right.select(F.col("value").cast("string").alias("right_value"), right_key.alias("on_right"))
    return a.join(b, F.col("on_left") == F.col("on_right")).select("key", F.concat_ws("|", "left_value", "right_value").alias("value"))


def wrapping_sum(column: Column) -> Column:
    """Sum of longs that wraps at 64 bits instead of raising; 0 for no rows."""
    exact = F.coalesce(F.sum(column.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    half = F.lit("9223372036854775808").cast("decimal(38,0)")
    return (F.pmod(exact + half, F.lit(_WRAP).cast("decimal(38,0)")) - half).cast("long")


def aggregate_column(kind: str, number: Column) -> Column:
    """COUNT, SUM or AVG of longs; AVG divides towards zero, and all are 0 for no rows."""
    counted = F.count(F.lit(1))
    if kind == "COUNT":
        return counted
    if kind == "SUM":
        return wrapping_sum(number)
    if kind == "AVG":
        return F.when(counted == 0, F.lit(0)).otherwise(_div(wrapping_sum(number), counted)).cast("long")
    raise ValueError(f"unknown aggregate {kind}")


def _div(a: Column, b: Column) -> Column:
    """Integer division towards zero; b is never 0 where the result is used."""
    return F.call_function("div", a, F.when(b == 0, F.lit(1)).otherwise(b))


def aggregate(rows: DataFrame, kind: str, number: Column) -> DataFrame:
    return rows.agg(aggregate_column(kind, number).alias("result"))


def group_aggregate(rows: DataFrame, group: Column, kind: str, number: Column) -> DataFrame:
    """Keys as text: bytes are read as ISO-8859-1."""
    return rows.groupBy(group.alias("group_key")).agg(aggregate_column(kind, number).alias("result"))


def latin1(column: Column) -> Column:
    return F.decode(column.cast("binary"), "ISO-8859-1")


def partials(rows: DataFrame, shard: Column, number: Column) -> DataFrame:
    """(shard, count, sum, min, max), a row for each shard that has rows."""
    return rows.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("count"), F.sum(number).alias("sum"), F.min(number).alias("min"), F.max(number).alias("max"))


def merge_partials(parts: DataFrame, kind: str) -> DataFrame:
    """COUNT, SUM or AVG (towards zero) from partial rows; 0 for none."""
    count, total = F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum("sum"), F.lit(0))
    result = {"COUNT": count, "SUM": total, "AVG": F.when(count == 0, F.lit(0)).otherwise(_div(total, count))}[kind]
    return parts.agg(result.cast("long").alias("result"))


def merge_regions(regions: Sequence[DataFrame]) -> DataFrame:
    """Rows of all regions, one for each key: that of the first region that has it."""
    tagged = [r.select("key", "value", F.lit(i).alias("region")) for i, r in enumerate(regions)]
    together = reduce(DataFrame.unionByName, tagged)
    return together.groupBy("key").agg(F.min_by(F.struct("value", "region"), F.col("region")).alias("first")).select("key", "first.value", "first.region")


def federated_aggregate(shards: DataFrame, kind: str) -> DataFrame:
    """(value, count) of shard results (value double, count long).

    AVG weighs by count and reports the sum of counts; COUNT adds the counts; SUM, MIN and MAX report the number of shards; all are 0 for no shard.
    """
    n, weight = F.count(F.lit(1)), F.coalesce(F.sum("count"), F.lit(0))
    value, count = {
        "SUM": (F.sum("value"), n),
        "COUNT": (weight.cast("double"), weight),
        "AVG": (F.sum(F.col("value") * F.col("count")) / F.when(weight == 0, F.lit(None)).otherwise(weight), weight),
        "MIN": (F.min("value"), n),
        "MAX": (F.max("value"), n),
    }[kind]
    return shards.agg(F.coalesce(value, F.lit(0.0)).alias("value"), count.alias("count"))


def federated_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, left_value, right_value) by key; of equal right keys the one with the highest `seq` counts, equal left keys all stay."""
    last = right.groupBy("key").agg(F.max_by("value", "seq").alias("right_value"))
    return left.select("key", F.col("value").alias("left_value")).join(last, "key").orderBy("key", "left_value")


def cloud_aggregate(shards: DataFrame, kind: str) -> DataFrame:
    """A federated aggregate with the clouds that took part, sorted, and whether all data may be in one residency."""
    facts = shards.agg(F.array_join(F.array_sort(F.collect_set("cloud")), ",").alias("clouds"), (F.count_distinct("residency") <= 1).alias("compliant"))
    return federated_aggregate(shards, kind).join(facts)


def allowed(rows: DataFrame, role: str) -> DataFrame:
    """Rows whose `allowed_roles` (array) has the role."""
    return rows.where(F.array_contains("allowed_roles", role))


def cost_attribution(costs: DataFrame) -> DataFrame:
    """(level, name, cost): the total and the sums by tenant, cloud and domain in one pass of grouping sets."""
    sets = costs.groupingSets([[], ["tenant"], ["cloud"], ["domain"]], "tenant", "cloud", "domain").agg(F.sum("cost").alias("cost"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "tenant").when(F.col("g") == 5, "cloud").otherwise("domain")
    return sets.select(level.alias("level"), F.coalesce("tenant", "cloud", "domain", F.lit("")).alias("name"), "cost")


def metered_bill(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Amount due by tenant: usage times the price of its kind."""
    return usage.join(prices, "kind").groupBy("tenant").agg(F.sum(F.col("quantity") * F.col("price")).alias("amount"))


def recurring_revenue(subscriptions: DataFrame) -> DataFrame:
    """Monthly revenue by tenant, of all and of active subscriptions."""
    return subscriptions.groupBy("tenant").agg(F.sum("price").alias("mrr"), F.coalesce(F.sum(F.when(F.col("active"), F.col("price"))), F.lit(0.0)).alias("active_mrr"))


def ratio(rows: DataFrame, hit: Column, base: Column) -> DataFrame:
    """Share of the rows where `base` holds in which `hit` holds too (churn, conversion); 0 for no such row."""
    n = F.count_if(base)
    return rows.agg(F.when(n == 0, F.lit(0.0)).otherwise(F.count_if(base & hit) / n).alias("rate"))


def position_percentiles(rows: DataFrame, value: str) -> DataFrame:
    """(p50, p95, max) by position: sorted[n / 2], sorted[int(0.95 n) - 1] and the last; zeros for no row.

    Values are counted first, so what is ordered is one row for each distinct value.
    """
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("v"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    at = lambda place: F.coalesce(F.min(F.when(F.col("upto") > place, F.col("v"))), F.lit(0))
    return upto.agg(at(F.floor(F.col("n") / 2)).alias("p50"), at(F.greatest(F.floor(F.col("n") * 0.95) - 1, F.lit(0))).alias("p95"), F.coalesce(F.max("v"), F.lit(0)).alias("max"))


def weighted_mean(rows: DataFrame, value: str, weight: str) -> DataFrame:
    total = F.sum(weight)
    return rows.agg(F.coalesce(F.sum(F.col(value) * F.col(weight)) / F.when(total != 0, total), F.lit(0.0)).alias("mean"))


def top_k(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in an order: a heap for each partition, then one over their results."""
    return rows.orderBy(*order).limit(k)


def execute_shards(shards: Sequence[object], work: Callable[[object], DataFrame]) -> DataFrame:
    """Rows of all shards by a callback that gives each shard's plan, one for each key: one job, in which shards are partitions of the work."""
    return merge_regions([work(s) for s in shards]).select("key", "value")


def lifecycle(objects: DataFrame, now_ms: int, warm_ms: int, cold_ms: int, expire_ms: int) -> DataFrame:
    """Adds the tier that an object's age asks for: HOT, WARM, COLD or EXPIRED."""
    age = F.lit(now_ms) - F.col("ts_ms")
    return objects.withColumn("tier", F.when(age >= expire_ms, "EXPIRED").when(age >= cold_ms, "COLD").when(age >= warm_ms, "WARM").otherwise("HOT"))
