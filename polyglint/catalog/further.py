"""Further queries: work by shards, vector tables, added places, fan-out of change logs, lifecycles and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.catalog import query
from polyglint.catalog.inputs import CHANGES, PLACES, ROWS, changes, event_ms, places, rows
from polyglint.catalog.logs import scratch
from polyglint.catalog.typed import _COS, _QUERY, _vectors
from polyglint.functions import places as G
from polyglint.functions import vectors as V
from polyglint.operators import pipeline as P
from polyglint.operators import relational as R
from polyglint.plans import sharding
from polyglint.runtime import ready, table
from polyglint.streaming import changes as C
from polyglint.streaming.views import Views


@query("j6_distributed_execute", "SELECT key, arg_min(value, shard) AS value FROM (SELECT l_partkey AS key, l_orderkey // ((SELECT max(l_orderkey) FROM lineitem) // 3 + 1) AS shard, count(*) AS value FROM lineitem GROUP BY 1, 2) s GROUP BY key")
def distributed_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(ready(spark), sf_dir, "lineitem")
    width = (lines.agg(F.max("l_orderkey")).first()[0] or 0) // 3 + 1

    def work(shard: sharding.Shard) -> DataFrame:
        own = lines.where((F.col("l_orderkey") >= shard.start) & (F.col("l_orderkey") < shard.end))
        return own.groupBy(F.col("l_partkey").alias("key")).agg(F.count(F.lit(1)).alias("value"))

    return R.execute_shards(sharding.plan_shards(3, ["eu"], 0, 3 * width), work)


@query("j7_indexed_vector_search", f"SELECT id, round(score, 5) AS score FROM (SELECT vec_id AS id, {_COS} AS score FROM embeddings WHERE label < 5) s ORDER BY s.score DESC, id LIMIT 5")
def indexed_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = V.IndexRegistry()
    registry.register("embeddings", 64)
    return registry.search(_vectors(spark, sf_dir), "embeddings", _QUERY, 5, F.col("label") < 5).withColumn("score", F.round("score", 5))


@query("o6_sharded_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def sharded_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(ready(spark), sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition(8, F.col("o_orderkey"))
    return R.top_k(orders, 15, F.col("o_totalprice").desc(), F.col("o_orderkey"))


@query("o3_limit", f"SELECT count(*) AS n FROM (SELECT * FROM {ROWS} r LIMIT 37) l")
def limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run(rows(spark, sf_dir), P.Request(["LIMIT"], limit=37)).agg(F.count(F.lit(1)).alias("n"))


@query("sc16_vector_table", "SELECT vec_id AS id, len(embedding) AS dimension FROM embeddings WHERE label = 2")
def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(ready(spark), "vectors")
    V.save(_vectors(spark, sf_dir).withColumn("collection", F.col("label")), path)
    return spark.read.parquet(path).where("collection = 2").select("id", F.size("embedding").cast("long").alias("dimension"))


@query("x41_vector_upserts", "SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 64 END::BIGINT AS dimension FROM embeddings WHERE vec_id % 5 <> 0")
def vector_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _vectors(spark, sf_dir).select("id", "embedding")
    one = F.array(F.lit(1.0).cast("float"))
    moved = held.where("id % 7 = 0").select(F.lit(1).alias("seq"), "id", one.alias("embedding"))
    gone = held.where("id % 5 = 0").select(F.lit(2).alias("seq"), "id", F.lit(None).cast("array<float>").alias("embedding"))
    return V.upserted(held, moved.union(gone)).select("id", F.size("embedding").cast("long").alias("dimension"))


@query("x54_added_places", f"SELECT member, CASE WHEN member < 'Customer#000000100' THEN lon ELSE 1.5::DOUBLE END AS lon, member >= 'Customer#000000100' AS changed FROM {PLACES} p")
def added_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = places(spark, sf_dir)
    new = every.withColumn("lon", F.lit(1.5))
    return G.added(every.where("member < 'Customer#000000100'"), new, "NX").select("member", "lon", "changed")


@query("x54_moved_places", f"SELECT member, 1.5::DOUBLE AS lon FROM {PLACES} p WHERE member < 'Customer#000000100'")
def moved_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = places(spark, sf_dir)
    return G.added(every.where("member < 'Customer#000000100'"), every.withColumn("lon", F.lit(1.5)), "XX").select("member", "lon")


@query("t6_fan_out", f"SELECT g AS consumer_group, count(*) AS n, max(seq) AS position FROM {CHANGES} c, (VALUES ('audit', -1), ('search', 400)) v(g, mark) WHERE seq > mark GROUP BY g")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changes(spark, sf_dir)
    own = [C.consume(log, at).agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("position")).select(F.lit(group).alias("consumer_group"), "n", "position") for group, at in (("audit", -1), ("search", 400))]
    return own[0].union(own[1])


@query("t9_view_states", "SELECT * FROM (VALUES ('fresh', true, 1), ('stale', false, 1)) v(name, valid, generation)")
def view_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = Views(ready(spark), scratch(spark, "states"))
    for name, now in (("fresh", 9000), ("stale", 1000)):
        views.create(name, lambda: table(spark, sf_dir, "region"), 100)
        views.refresh(name, now)
    for name in views.expired(10_000, 5_000):
        views.invalidate(name)
    return views.states().select("name", "valid", "generation")


@query("x76_lifecycle", "SELECT tier, count(*) AS n FROM (SELECT CASE WHEN a >= 2160000000 THEN 'EXPIRED' WHEN a >= 1296000000 THEN 'COLD' WHEN a >= 432000000 THEN 'WARM' ELSE 'HOT' END AS tier FROM (SELECT 1706659200000 - epoch_us(ts) // 1000 AS a FROM events) e) t GROUP BY tier")
def lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(ready(spark), sf_dir, "events").select(event_ms().alias("ts_ms"))
    return R.lifecycle(objects, 1706659200000, 432_000_000, 1_296_000_000, 2_160_000_000).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("x77_compliance_report", "SELECT o_orderpriority AS severity, count(*) AS n FROM orders WHERE o_totalprice > 400000 GROUP BY 1")
def compliance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ready(spark), sf_dir, "orders").where("o_totalprice > 400000").groupBy(F.col("o_orderpriority").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
