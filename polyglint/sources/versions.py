"""Versioned tables: rows (key, value, start_ts, commit_ts, write_type) with PUT, DELETE and LOCK writes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(versions: DataFrame, read_ts: int | None = None) -> DataFrame:
    """(key, value) as committed at `read_ts` (None: latest): of each key the newest PUT or DELETE, unless that is a DELETE. LOCKs are never seen."""
    seen = versions.where("write_type != 'LOCK'")
    seen = seen if read_ts is None else seen.where(F.col("commit_ts") <= read_ts)
    newest = seen.groupBy("key").agg(F.max_by(F.struct("value", "write_type"), "commit_ts").alias("v"))
    return newest.where("v.write_type != 'DELETE'").select("key", "v.value")


def snapshot_scan(versions: DataFrame, start: str | None = None, end: str | None = None, read_ts: int | None = None) -> DataFrame:
    """Keys in [start, end) as of `read_ts`, in order; the range reaches the file scan."""
    if start is not None:
        versions = versions.where(F.col("key") >= start)
    if end is not None:
        versions = versions.where(F.col("key") < end)
    return as_of(versions, read_ts).orderBy("key")


def snapshot_read(versions: DataFrame, key: str, read_ts: int | None = None) -> DataFrame:
    return as_of(versions.where(F.col("key") == key), read_ts)


def history(versions: DataFrame, key: str) -> DataFrame:
    return versions.where(F.col("key") == key).orderBy("commit_ts")


def garbage(versions: DataFrame, safe_point: int, keep_locks: bool = False) -> DataFrame:
    """Versions that may be dropped: all but the newest of a key, if committed before the safe point; the batch form leaves LOCKs."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.col("commit_ts").desc()))
    old = versions.withColumn("age", newest).where((F.col("age") > 1) & (F.col("commit_ts") < safe_point)).drop("age")
    return old.where("write_type != 'LOCK'") if keep_locks else old


def restore(checkpoint: DataFrame, log: DataFrame, target_ts: int) -> DataFrame:
    """(key, value) at a point in time: a checkpoint's versions and those of the log up to the target."""
    return as_of(checkpoint.unionByName(log.where(F.col("commit_ts") <= target_ts)))


def live(now_ms: int) -> Column:
    """Neither deleted nor past its time to live; a null expiry never ends."""
    return ~F.col("deleted") & (F.col("expire_ms").isNull() | (F.col("expire_ms") > now_ms))


def merge_scan(sources: Sequence[DataFrame], now_ms: int) -> DataFrame:
    """(key, value) over sources (key, value, deleted, expire_ms), the newest source first: it wins for each key, then dead rows go."""
    tagged = reduce(DataFrame.unionByName, [s.withColumn("source", F.lit(i)) for i, s in enumerate(sources)])
    first = tagged.groupBy("key").agg(F.min_by(F.struct("value", "deleted", "expire_ms"), "source").alias("v")).select("key", "v.*")
    return first.where(live(now_ms)).select("key", "value")


def glob(column: Column, pattern: str) -> Column:
    """Match with * and ? as the only special characters; neither crosses a line."""
    special = set(r"\^$.|+()[]{}")
    body = "".join(".*" if c == "*" else "." if c == "?" else f"\\{c}" if c in special else c for c in pattern)
    return column.rlike(rf"\A{body}\z")


def scan_page(keys: DataFrame, pattern: str, cursor: int, count: int) -> DataFrame:
    """(position, key) of one page: `count` keys from position `cursor` in key order, those of the page that match."""
    page = keys.select("key").orderBy("key").limit(cursor + count)
    numbered = page.withColumn("position", F.row_number().over(Window.orderBy("key")) - 1)
    return numbered.where((F.col("position") >= cursor) & glob(F.col("key"), pattern)).select("position", "key")


def encoding(value: Column) -> Column:
    """How a string value is held: int, embstr (44 bytes at most) or raw."""
    return F.when(value.try_cast("bigint").isNotNull(), "int").when(F.octet_length(value) <= 44, "embstr").otherwise("raw")


def time_to_live(now_ms: int) -> Column:
    """Milliseconds left; -1 without an expiry, -2 for a dead row."""
    return F.when(~live(now_ms), F.lit(-2)).when(F.col("expire_ms").isNull(), F.lit(-1)).otherwise(F.col("expire_ms") - now_ms).cast("long")
