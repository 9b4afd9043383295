"""Append-only streams (stream, ms, seq, fields) with consumer groups, and publishing by channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglint.sources.versions import glob


def entry_id(ms: Column, seq: Column) -> Column:
    """The number by which ids compare."""
    return ms * 1_000_000 + seq


def accepted(entries: DataFrame) -> DataFrame:
    """Entries whose id is above all before them in arrival order."""
    before = Window.partitionBy("stream").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    number = entry_id(F.col("ms"), F.col("seq"))
    return entries.where(number > 0).withColumn("highest", F.max(number).over(before)).where(F.col("highest").isNull() | (number > F.col("highest"))).drop("highest")


def ranged(entries: DataFrame, stream: str, start: int, end: int, count: int | None = None) -> DataFrame:
    """Entries with start <= id <= end in order."""
    number = entry_id(F.col("ms"), F.col("seq"))
    out = entries.where((F.col("stream") == stream) & number.between(start, end)).orderBy("ms", "seq")
    return out if count is None else out.limit(count)


def after(entries: DataFrame, stream: str, last: int, count: int | None = None) -> DataFrame:
    out = entries.where((F.col("stream") == stream) & (entry_id(F.col("ms"), F.col("seq")) > last)).orderBy("ms", "seq")
    return out if count is None else out.limit(count)


def trimmed(entries: DataFrame, keep: int) -> DataFrame:
    """The last `keep` entries of each stream."""
    place = F.row_number().over(Window.partitionBy("stream").orderBy(F.col("ms").desc(), F.col("seq").desc()))
    return entries.withColumn("place", place).where(F.col("place") <= keep).drop("place")


def group_state(deliveries: DataFrame, acknowledgements: DataFrame, claims: DataFrame) -> DataFrame:
    """(stream, group, consumer, id, delivered, dead_letters): pending entries of consumer groups from their logs.

    deliveries and claims: (stream, group, consumer, id, at); acknowledgements: (stream, group, id). The last delivery or claim owns an
    entry; a claim by the consumer that already has it counts as a dead letter; acknowledged entries are gone.
    """
    both = deliveries.withColumn("claim", F.lit(False)).unionByName(claims.withColumn("claim", F.lit(True)))
    own = Window.partitionBy("stream", "group", "id").orderBy("at", "claim")
    again = F.col("claim") & (F.lag("consumer").over(own) == F.col("consumer"))
    state = both.withColumn("again", F.coalesce(again, F.lit(False))).groupBy("stream", "group", "id").agg(F.max_by("consumer", F.struct("at", "claim")).alias("consumer"), F.count(F.lit(1)).alias("delivered"), F.count_if("again").alias("dead_letters"))
    return state.join(acknowledgements, ["stream", "group", "id"], "left_anti").select("stream", "group", "consumer", "id", "delivered", "dead_letters")


def pending(state: DataFrame) -> DataFrame:
    return state.groupBy("stream", "group", "consumer").agg(F.count(F.lit(1)).alias("pending"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def receivers(messages: DataFrame, channels: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(message, n): subscribers (channel, subscriber) of each message's channel, and those whose pattern matches it.

    The few patterns become conditions on the message, so nothing is joined by comparing rows.
    """
    exact = messages.join(channels.groupBy("channel").agg(F.count(F.lit(1)).alias("exact")), "channel", "left")
    hits = sum((F.when(glob(F.col("channel"), p), 1).otherwise(0) for _, p in patterns), F.lit(0))
    return exact.select("message", (F.coalesce("exact", F.lit(0)) + hits).cast("long").alias("n"))
