"""The driver's tables in the shapes that the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.runtime import ready, table


def event_ms() -> Column:
    return F.unix_millis(F.col("ts").cast("timestamp"))


ROWS = "(SELECT event_type || (user_id % 20) AS key, value FROM events)"
VERSIONS = "(SELECT 'u' || lpad((user_id % 300)::VARCHAR, 4, '0') AS key, props AS value, event_id - 1 AS start_ts, event_id AS commit_ts, CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'LOCK' ELSE 'PUT' END AS write_type FROM events)"
CHANGES = "(SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'REGION_MOVE' ELSE 'PUT' END AS type, 'k' || (user_id % 200) AS key, value, event_type = 'error' AS deleted, 'r' || (event_id % 3) AS region, 'c' || (event_id % 4) AS cluster, epoch_us(ts) // 60000000 AS ts, epoch_us(ts) // 1000 AS ts_ms FROM events)"
POINTS = "(SELECT event_type AS series, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, value FROM events)"
SETS = "(SELECT p_brand AS key, p_type AS member FROM part)"
ZSETS = "(SELECT c_mktsegment AS key, c_name AS member, round(c_acctbal / 100) + 0.0 AS score FROM customer)"
PLACES = "(SELECT c_name AS member, (c_custkey * 37 % 3600) / 10.0::DOUBLE - 180 AS lon, (c_custkey * 17 % 1700) / 10.0::DOUBLE - 85 AS lat FROM customer)"


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ready(spark), sf_dir, "events").select(F.concat("event_type", (F.col("user_id") % 20).cast("string")).alias("key"), "value")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "signup", "LOCK").otherwise("PUT")
    key = F.concat(F.lit("u"), F.lpad((F.col("user_id") % 300).cast("string"), 4, "0"))
    return table(ready(spark), sf_dir, "events").select(key.alias("key"), F.col("props").alias("value"), (F.col("event_id") - 1).alias("start_ts"), F.col("event_id").alias("commit_ts"), kind.alias("write_type"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda prefix, column, n: F.concat(F.lit(prefix), (F.col(column) % n).cast("string"))
    kind = F.when(F.col("event_type") == "signup", "REGION_MOVE").otherwise("PUT")
    return table(ready(spark), sf_dir, "events").select(F.col("event_id").alias("seq"), kind.alias("type"), named("k", "user_id", 200).alias("key"), "value", (F.col("event_type") == "error").alias("deleted"), named("r", "event_id", 3).alias("region"), named("c", "event_id", 4).alias("cluster"), F.floor(event_ms() / 60000).alias("ts"), event_ms().alias("ts_ms"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ready(spark), sf_dir, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("seq"), event_ms().alias("ts_ms"), "value")


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ready(spark), sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("member"))


def zsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ready(spark), sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), (F.round(F.col("c_acctbal") / 100) + 0.0).alias("score"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ready(spark), sf_dir, "customer").select(F.col("c_name").alias("member"), ((F.col("c_custkey") * 37 % 3600) / 10.0 - 180).alias("lon"), ((F.col("c_custkey") * 17 % 1700) / 10.0 - 85).alias("lat"))
