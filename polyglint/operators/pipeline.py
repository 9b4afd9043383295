"""The pushdown pipeline over rows (key string, value double): eight operators in one canonical order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The order in which operators run, whatever order they are listed in; an operator listed n times runs n times.
ORDER = ("JOIN", "FILTER", "PROJECT", "AGGREGATE", "GROUP_BY", "WINDOW", "ORDER_BY", "LIMIT")
WINDOWS = ("NONE", "ROW_NUMBER", "RANK", "LAG", "LEAD", "SUM_OVER", "COUNT_OVER", "AVG_OVER")


def key_range(rows: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Keys in [start, end); None is open."""
    rows = rows if start is None else rows.where(F.col("key") >= start)
    return rows if end is None else rows.where(F.col("key") < end)


def at_least(rows: DataFrame, threshold: float) -> DataFrame:
    return rows.where(F.col("value") >= threshold)


def scaled(rows: DataFrame, factor: float) -> DataFrame:
    return rows.select("key", (F.col("value") * F.lit(float(factor))).alias("value"))


def total(rows: DataFrame) -> DataFrame:
    """One row ("sum", total); 0 for no rows."""
    return rows.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")).select(F.lit("sum").alias("key"), "value")


def sum_by_key(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sum("value").alias("value"))


def _window(name: str) -> Column:
    by_value = Window.partitionBy("key").orderBy("value")
    so_far = by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {
        "ROW_NUMBER": F.row_number().over(by_value).cast("double"),
        "RANK": F.dense_rank().over(by_value).cast("double"),
        "LAG": F.lag("value", 1, 0.0).over(by_value),
        "LEAD": F.lead("value", 1, 0.0).over(by_value),
        "SUM_OVER": F.sum("value").over(so_far),
        "COUNT_OVER": F.count(F.lit(1)).over(so_far).cast("double"),
        "AVG_OVER": F.avg("value").over(so_far),
    }[name]


def windowed(rows: DataFrame, name: str) -> DataFrame:
    """The window function by key in order of value takes the place of value. RANK has no gaps, LAG and LEAD start from 0."""
    return rows if name == "NONE" else rows.select("key", _window(name).alias("value"))


def ordered(rows: DataFrame, descending: bool = False) -> DataFrame:
    """By value, ties by key."""
    return rows.orderBy(F.col("value").desc() if descending else F.col("value"), "key")


def joined(left: DataFrame, right: DataFrame | None) -> DataFrame:
    """Inner join by key that adds the values; an absent or empty right side leaves the left side as it is."""
    if right is None or right.isEmpty():
        return left
    return left.join(right.withColumnRenamed("value", "added"), "key").select("key", (F.col("value") + F.col("added")).alias("value"))


@dataclass(frozen=True)
class Request:
    """A pipeline call. `threshold` is what FILTER compares with and what PROJECT multiplies by."""

    operators: Sequence[str]
    start: str | None = None
    end: str | None = None
    threshold: float = 0.0
    window: str = "NONE"
    descending: bool = False
    limit: int | None = None
    join_rows: DataFrame | None = None
    join_tables: Sequence[DataFrame] = field(default_factory=tuple)


def run(rows: DataFrame, request: Request) -> DataFrame:
    """Range, then the listed operators in ORDER; joins before filters, as the filter sees the summed value."""
    if unknown := set(request.operators) - set(ORDER):
        raise ValueError(f"unknown operators {sorted(unknown)}")
    steps = {
        "JOIN": lambda r: reduce(joined, [request.join_rows, *request.join_tables], r),
        "FILTER": lambda r: at_least(r, request.threshold),
        "PROJECT": lambda r: scaled(r, request.threshold),
        "AGGREGATE": total,
        "GROUP_BY": sum_by_key,
        "WINDOW": lambda r: windowed(r, request.window),
        "ORDER_BY": lambda r: ordered(r, request.descending),
        "LIMIT": lambda r: r if request.limit is None else r.limit(request.limit),
    }
    return reduce(lambda r, name: steps[name](r), sorted(request.operators, key=ORDER.index), key_range(rows, request.start, request.end))


def run_one(rows: DataFrame, request: Request) -> DataFrame:
    """A single operator without a chain: JOIN, WINDOW and LIMIT do nothing, and ORDER_BY ascends."""
    (name,) = request.operators
    rows = key_range(rows, request.start, request.end)
    if name in ("JOIN", "WINDOW", "LIMIT"):
        return rows
    return run(rows, Request([name], threshold=request.threshold))
