"""Sets as rows (key, member), and bitmaps as rows of bytes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def members(sets: DataFrame, key: str) -> DataFrame:
    return sets.where(F.col("key") == key).select("member").distinct()


def intersection(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Members of all the sets, by counting the sets that hold each: one shuffle for any number of sets."""
    held = sets.where(F.col("key").isin(*keys)).select("key", "member").distinct().groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    return held.where(F.col("n") == len(set(keys))).select("member")


def union(sets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return sets.where(F.col("key").isin(*keys)).select("member").distinct()


def difference(sets: DataFrame, first: str, rest: Sequence[str]) -> DataFrame:
    """Members of the first set that no other has."""
    held = sets.where(F.col("key").isin(first, *rest)).groupBy("member").agg(F.bool_or(F.col("key") == first).alias("own"), F.bool_or(F.col("key").isin(*rest)).alias("other"))
    return held.where("own and not other").select("member")


def stored(result: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The result as rows of set `key`, none if it is empty, and its size."""
    rows = result.select(F.lit(key).alias("key"), "member")
    return rows, rows.count()


def added(held: Column, new: Column) -> Column:
    """The set after additions; its size, not the number added, is what the caller is told."""
    return F.array_distinct(F.concat(held, new))


def removed(held: Column, old: Column) -> Column:
    return F.array_except(held, old)


def drawn(sets: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n members in a seeded order that does not depend on the partitioning."""
    return members(sets, key).orderBy(F.xxhash64("member", F.lit(seed)), "member").limit(n)


def grow_only(replicas: Sequence[DataFrame]) -> DataFrame:
    """Merge of grow-only sets."""
    return reduce(DataFrame.unionByName, replicas).distinct()


def observed_remove(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """Elements with an added tag that was not removed; both are rows (element, tag)."""
    return adds.join(removes, ["element", "tag"], "left_anti").select("element").distinct()


def _nibbles(bits: Column) -> Column:
    """A binary value as an array of its bytes."""
    hexed = F.hex(bits)
    size = (F.length(hexed) / 2).cast("int")
    return F.when(size == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("int")))


def get_bit(bits: Column, offset: Column) -> Column:
    """Bit at an offset, the highest of a byte first; 0 beyond the end."""
    byte = F.get(_nibbles(bits), F.floor(offset / 8).cast("int"))
    return F.coalesce(F.call_function("getbit", byte, 7 - F.pmod(offset, F.lit(8)).cast("int")).cast("int"), F.lit(0))


def bit_count(bits: Column, start: int = 0, end: int = -1) -> Column:
    """Ones in bytes start to end, both included, negatives from the end."""
    bytes_ = _nibbles(bits)
    size = F.size(bytes_)
    a = F.greatest(F.lit(start) + F.when(F.lit(start) < 0, size).otherwise(0), F.lit(0))
    b = F.least(F.lit(end) + F.when(F.lit(end) < 0, size).otherwise(0), size - 1)
    return F.aggregate(F.filter(bytes_, lambda x, i: (i >= a) & (i <= b)), F.lit(0), lambda n, x: n + F.bit_count(x))


def bit_position(bits: Column, wanted: int) -> Column:
    """Offset of the first bit that is `wanted`; -1 if there is none."""
    place = F.array_position(F.flatten(F.transform(_nibbles(bits), lambda b: F.transform(F.sequence(F.lit(7), F.lit(0), F.lit(-1)), lambda k: F.call_function("getbit", b, k).cast("int")))), wanted)
    return (place - 1).cast("long")


def bit_operation(kind: str, values: Sequence[Column]) -> Column:
    """AND, OR, XOR of values padded with zero bytes to the longest, or NOT of one; upper-case hexadecimal text."""
    arrays = [_nibbles(v) for v in values]
    longest = F.greatest(*map(F.size, arrays)) if len(arrays) > 1 else F.size(arrays[0])
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(0))
    fold = {"AND": Column.bitwiseAND, "OR": Column.bitwiseOR, "XOR": Column.bitwiseXOR}
    each = (lambda i: F.bitwise_not(at(arrays[0], i)).bitwiseAND(F.lit(255))) if kind == "NOT" else (lambda i: reduce(fold[kind], [at(a, i) for a in arrays]))
    digits = F.transform(F.sequence(F.lit(0), F.greatest(longest - 1, F.lit(0))), lambda i: F.lpad(F.hex(each(i)), 2, "0"))
    return F.when(longest == 0, F.lit("")).otherwise(F.array_join(digits, ""))
