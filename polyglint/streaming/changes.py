"""Change logs: rows (seq, type, key, value, deleted, region, ts). Batch folds, and the same folds over file streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def append(log: DataFrame, path: str) -> None:
    """Append changes to a log folder; files are numbered by the commit, rows by seq."""
    log.write.mode("append").parquet(path)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).orderBy("seq")


def consume(log: DataFrame, checkpoint: int, limit: int | None = None) -> DataFrame:
    """Changes after a checkpoint, in order, repeated ones once; at least once in all, as the caller moves the checkpoint after its sink."""
    new = log.where(F.col("seq") > checkpoint).dropDuplicates(["seq"]).orderBy("seq")
    return new if limit is None else new.limit(limit)


def watermarks(applied: DataFrame) -> DataFrame:
    """(region, watermark): highest applied seq."""
    return applied.groupBy("region").agg(F.max("seq").alias("watermark"))


def unapplied(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Changes above their region's watermark."""
    return log.join(marks, "region", "left").where(F.col("watermark").isNull() | (F.col("seq") > F.col("watermark"))).drop("watermark")


def current(log: DataFrame) -> DataFrame:
    """(key, value) after the log: the last change of each key, unless it deletes."""
    last = log.groupBy("key").agg(F.max_by(F.struct("value", "deleted"), "seq").alias("c"))
    return last.where("not c.deleted").select("key", "c.value")


def view_aggregate(state: DataFrame, kind: str) -> DataFrame:
    """(value, count) of a maintained view over current (key, value); an empty view is (0, 0)."""
    column = {"SUM": F.sum("value"), "COUNT": F.count("value").cast("double"), "AVG": F.avg("value"), "MIN": F.min("value"), "MAX": F.max("value")}[kind]
    return state.agg(F.coalesce(column, F.lit(0.0)).alias("value"), F.count(F.lit(1)).alias("count"))


def maintained_view(log: DataFrame, kind: str) -> DataFrame:
    return view_aggregate(current(log), kind)


def follow(spark: SparkSession, path: str, schema: str, checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run `sink` on each batch of new changes of a log folder until none is left; a second run resumes at the checkpoint."""
    return spark.readStream.schema(schema).parquet(path).writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def maintain(spark: SparkSession, path: str, schema: str, checkpoint: str, state_path: str) -> StreamingQuery:
    """Keep the newest change of each key of a log folder as Parquet generations under `state_path`.

    Each batch merges the previous generation with its changes and writes the next under the batch's number, so a repeated batch writes the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select("key", "seq", "value", "deleted")
        if number:
            new = new.unionByName(batch.sparkSession.read.parquet(f"{state_path}/generation={number - 1}"))
        last = new.groupBy("key").agg(F.max_by(F.struct("seq", "value", "deleted"), "seq").alias("c")).select("key", "c.*")
        last.write.mode("overwrite").parquet(f"{state_path}/generation={number}")

    return follow(spark, path, schema, checkpoint, merge)


def tumbling(stream: DataFrame, width: str, delay: str) -> DataFrame:
    """(window_start, key, n, total) of event-time windows; runs on a batch and, with late rows dropped after `delay`, on a stream."""
    out = stream.withWatermark("ts", delay).groupBy(F.window("ts", width), "key").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "key", "n", "total")


def last_writer(log: DataFrame) -> DataFrame:
    """(key, value, ts, cluster, region, seq): what is held for each key after all changes in the order of `arrival`.

    A change takes the place of the held one if its time is later, or as late and its cluster greater, unless both are of one region
    and its seq is not above the held one's. What is held decides what is taken next, so the changes of one key meet in one row.
    """
    names = ("region", "seq", "ts", "cluster", "value")
    arrived = F.sort_array(F.collect_list(F.struct("arrival", F.struct(*names).alias("change"))))

    def taken(held: Column, one: Column) -> Column:
        replay = (one["region"] == held["region"]) & (one["seq"] <= held["seq"])
        later = (one["ts"] > held["ts"]) | ((one["ts"] == held["ts"]) & (one["cluster"] > held["cluster"]))
        return F.when(~replay & later, one).otherwise(held)

    of_key = log.groupBy("key").agg(F.transform(arrived, lambda x: x["change"]).alias("c"))
    return of_key.select("key", F.aggregate("c", F.get("c", F.lit(0)), taken).alias("w")).select("key", "w.value", "w.ts", "w.cluster", "w.region", "w.seq")


def conflicts(log: DataFrame) -> DataFrame:
    """Changes of a key by another region than its first; a MOVE forgets the first."""
    by_seq = Window.partitionBy("key").orderBy("seq")
    moved = log.withColumn("epoch", F.count_if(F.col("type") == "REGION_MOVE").over(by_seq.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("type != 'REGION_MOVE'")
    first = F.first("region").over(Window.partitionBy("key", "epoch").orderBy("seq"))
    return moved.withColumn("first_region", first).where("region != first_region").drop("epoch")


def lag(log: DataFrame, applied: DataFrame, now_ms: Column) -> DataFrame:
    """(region, pending, behind_ms): changes not applied yet, and how long ago the last applied one was made."""
    done = applied.groupBy("region").agg(F.max("seq").alias("seq_done"), F.max("ts_ms").alias("ts_done"))
    waiting = log.join(done, "region", "left").groupBy("region").agg(F.count_if(F.col("seq") > F.coalesce("seq_done", F.lit(-1))).alias("pending"), F.max("ts_done").alias("ts_done"))
    return waiting.select("region", "pending", (now_ms - F.coalesce("ts_done", F.lit(0))).alias("behind_ms"))
