"""Queries over the pipeline, joins, aggregates, snapshots, shards and planning figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.catalog import query
from polyglint.catalog.inputs import ROWS, VERSIONS, rows, versions
from polyglint.operators import pipeline as P
from polyglint.operators import planning as L
from polyglint.operators import relational as R
from polyglint.plans import kv_sql, sharding
from polyglint.runtime import ready, table
from polyglint.sources import versions as V


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 4) for c in columns})


# Pipeline operators.


@query("f2_key_range", f"SELECT key, value FROM {ROWS} r WHERE key >= 'click' AND key < 'purchase'")
def key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.key_range(rows(spark, sf_dir), "click", "purchase")


@query("f3_filter", f"SELECT key, value FROM {ROWS} r WHERE value >= 100")
def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run(rows(spark, sf_dir), P.Request(["FILTER"], threshold=100.0))


@query("f4_project", f"SELECT key, round(value * 2.5, 4) AS value FROM {ROWS} r")
def projected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.run(rows(spark, sf_dir), P.Request(["PROJECT"], threshold=2.5)), "value")


@query("a3_aggregate", f"SELECT 'sum' AS key, round(coalesce(sum(value), 0), 2) AS value FROM {ROWS} r")
def aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run(rows(spark, sf_dir), P.Request(["AGGREGATE"])).withColumn("value", F.round("value", 2))


@query("a3_aggregate_empty", "SELECT 'sum' AS key, 0.0::DOUBLE AS value")
def aggregated_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run(rows(spark, sf_dir), P.Request(["AGGREGATE"], start="zzz"))


@query("a4_group_by", f"SELECT key, round(sum(value), 2) AS value FROM {ROWS} r GROUP BY key")
def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run(rows(spark, sf_dir), P.Request(["GROUP_BY"])).withColumn("value", F.round("value", 2))


_W = "(PARTITION BY key ORDER BY value)"
_S = "(PARTITION BY key ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_WINDOWS = {
    "NONE": "value",
    "ROW_NUMBER": f"(row_number() OVER {_W})::DOUBLE",
    "RANK": f"(dense_rank() OVER {_W})::DOUBLE",
    "LAG": f"lag(value, 1, 0) OVER {_W}",
    "LEAD": f"lead(value, 1, 0) OVER {_W}",
    "SUM_OVER": f"round(sum(value) OVER {_S}, 2)",
    "COUNT_OVER": f"(count(*) OVER {_S})::DOUBLE",
    "AVG_OVER": f"round(avg(value) OVER {_S} + 1e-9, 4)",
}
for _i, (_name, _sql) in enumerate(_WINDOWS.items()):

    @query(f"w{_i}_{_name.lower()}", f"SELECT key, {_sql} AS value FROM {ROWS} r")
    def window(spark: SparkSession, sf_dir: str, name: str = _name) -> DataFrame:
        out = P.run(rows(spark, sf_dir), P.Request(["WINDOW"], window=name))
        return out.withColumn("value", F.round(F.col("value") + (1e-9 if name == "AVG_OVER" else 0.0), 2 if name == "SUM_OVER" else 4))


@query("o1_order_by", f"SELECT key, value FROM {ROWS} r ORDER BY value DESC, key LIMIT 25")
def order_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run(rows(spark, sf_dir), P.Request(["LIMIT", "ORDER_BY"], descending=True, limit=25))


@query("o2_sorted_by_key", f"SELECT key, count(*) AS n FROM {ROWS} r GROUP BY key ORDER BY key")
def sorted_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy("key")


_LEFT = "(SELECT 'c' || o_custkey AS key, o_totalprice AS value FROM orders)"
_RIGHT = "(SELECT 'c' || c_custkey AS key, c_acctbal AS value FROM customer)"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ready(spark), sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_totalprice").alias("value"))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ready(spark), sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_acctbal").alias("value"))


@query("j2_join_add", f"SELECT l.key, round(l.value + r.value, 2) AS value FROM {_LEFT} l JOIN {_RIGHT} r ON l.key = r.key")
def join_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run(_orders(spark, sf_dir), P.Request(["JOIN"], join_rows=_customers(spark, sf_dir))).withColumn("value", F.round("value", 2))


@query("j2_join_empty_is_identity", f"SELECT key, value FROM {_LEFT} l")
def join_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run(_orders(spark, sf_dir), P.Request(["JOIN"], join_rows=_customers(spark, sf_dir).where("false")))


@query("j3_chained_join", f"SELECT l.key, round(l.value + r.value + s.value, 2) AS value FROM {_LEFT} l JOIN {_RIGHT} r ON l.key = r.key JOIN (SELECT key, value FROM {_RIGHT} x WHERE value >= 5000) s ON r.key = s.key")
def chained_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = _customers(spark, sf_dir)
    return P.run(_orders(spark, sf_dir), P.Request(["JOIN"], join_rows=customers, join_tables=[customers.where("value >= 5000")])).withColumn("value", F.round("value", 2))


@query("chain_canonical_order", f"SELECT key, round(value, 2) AS value FROM (SELECT key, sum(value * 3) AS value FROM {ROWS} r WHERE key >= 'c' AND key < 'v' AND value >= 3 GROUP BY key) g ORDER BY value DESC, key LIMIT 10")
def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.run(rows(spark, sf_dir), P.Request(["LIMIT", "ORDER_BY", "GROUP_BY", "PROJECT", "FILTER"], start="c", end="v", threshold=3.0, descending=True, limit=10))
    return out.withColumn("value", F.round("value", 2))


@query("chain_repeated_operator", f"SELECT key, round(value * 4, 4) AS value FROM {ROWS} r")
def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(P.run(rows(spark, sf_dir), P.Request(["PROJECT", "PROJECT"], threshold=2.0)), "value")


@query("single_operator_passes_window", f"SELECT key, value FROM {ROWS} r WHERE key >= 'view'")
def single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.run_one(rows(spark, sf_dir), P.Request(["WINDOW"], start="view", window="RANK"))


# Keyed joins and aggregates.


@query("j1_hash_join", "SELECT o_orderkey::VARCHAR AS key, o_orderstatus || '|' || c_mktsegment AS value FROM orders JOIN customer ON o_custkey = c_custkey")
def hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(ready(spark), sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("value"), "o_custkey")
    right = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("value"), "c_custkey")
    return R.hash_join(left, right, F.col("o_custkey"), F.col("c_custkey"))


@query("a1_sql_aggregates", "SELECT count(*) AS n, sum(floor(o_totalprice - 250000)::BIGINT)::BIGINT AS total, (sum(floor(o_totalprice - 250000)::BIGINT) // count(*))::BIGINT AS mean FROM orders")
def sql_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.floor(F.col("o_totalprice") - 250000)
    return table(ready(spark), sf_dir, "orders").agg(R.aggregate_column("COUNT", number).alias("n"), R.aggregate_column("SUM", number).alias("total"), R.aggregate_column("AVG", number).alias("mean"))


@query("a2_sql_group_by", "SELECT o_orderpriority AS group_key, (sum(o_orderkey - 5000) // count(*))::BIGINT AS result FROM orders GROUP BY o_orderpriority")
def sql_group_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.group_aggregate(table(ready(spark), sf_dir, "orders"), R.latin1(F.col("o_orderpriority")), "AVG", F.col("o_orderkey") - 5000)


_PART = "(SELECT o_orderkey % 8 AS shard, count(*) AS count, sum(o_orderkey)::BIGINT AS sum, min(o_orderkey) AS min, max(o_orderkey) AS max FROM orders GROUP BY 1)"


def _partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.partials(table(ready(spark), sf_dir, "orders"), F.col("o_orderkey") % 8, F.col("o_orderkey"))


@query("a5_partial_aggregate", f"SELECT * FROM {_PART} p")
def partial_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _partials(spark, sf_dir)


@query("a6_merge_aggregate", f"SELECT (sum(sum) // sum(count))::BIGINT AS result FROM {_PART} p")
def merge_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_partials(_partials(spark, sf_dir), "AVG")


@query("j4_merge_regions", "SELECT key, arg_min(value, region) AS value, min(region) AS region FROM (SELECT o_custkey::VARCHAR AS key, max(o_totalprice) AS value, 0 AS region FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 UNION ALL SELECT o_custkey::VARCHAR, min(o_totalprice), 1 FROM orders GROUP BY 1) u GROUP BY key")
def merge_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(ready(spark), sf_dir, "orders").withColumn("key", F.col("o_custkey").cast("string"))
    return R.merge_regions([orders.where("o_orderstatus = 'F'").groupBy("key").agg(F.max("o_totalprice").alias("value")), orders.groupBy("key").agg(F.min("o_totalprice").alias("value"))])


@query("j5_federated_join", "SELECT l.key, l.value AS left_value, r.right_value FROM (SELECT o_custkey AS key, o_orderkey AS value FROM orders) l JOIN (SELECT o_custkey AS key, arg_max(o_orderpriority, o_orderkey) AS right_value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) r ON l.key = r.key ORDER BY l.key, l.value")
def federated_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(ready(spark), sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    right = orders.where("o_orderstatus = 'F'").select("key", F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    return R.federated_join(orders.select("key", F.col("o_orderkey").alias("value")), right)


_SHARDS = "(SELECT l_suppkey % 7 AS shard, ['aws', 'gcp', 'azure'][(l_suppkey % 3 + 1)::INT] AS cloud, 'eu' AS residency, round(avg(l_quantity), 6) AS value, count(*) AS count FROM lineitem GROUP BY 1, 2)"


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cloud = F.element_at(F.array(F.lit("aws"), F.lit("gcp"), F.lit("azure")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return table(ready(spark), sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("shard"), cloud.alias("cloud")).agg(F.round(F.avg("l_quantity"), 6).alias("value"), F.count(F.lit(1)).alias("count")).withColumn("residency", F.lit("eu"))


_FEDERATED = {"SUM": ("sum(value)", "count(*)"), "COUNT": ("sum(count)::DOUBLE", "sum(count)::BIGINT"), "AVG": ("sum(value * count) / sum(count)", "sum(count)::BIGINT"), "MIN": ("min(value)", "count(*)"), "MAX": ("max(value)", "count(*)")}
for _kind, (_value, _count) in _FEDERATED.items():

    @query(f"a7_federated_{_kind.lower()}", f"SELECT round({_value}, 4) AS value, {_count} AS count FROM {_SHARDS} s")
    def federated(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return _rounded(R.federated_aggregate(_shards(spark, sf_dir), kind), "value")


@query("a8_cloud_aggregate", f"SELECT round(sum(value * count) / sum(count), 4) AS value, sum(count)::BIGINT AS count, string_agg(DISTINCT cloud, ',' ORDER BY cloud) AS clouds, count(DISTINCT residency) <= 1 AS compliant FROM {_SHARDS} s")
def cloud_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.cloud_aggregate(_shards(spark, sf_dir), "AVG"), "value")


@query("f7_role_predicate", "SELECT n_name FROM nation WHERE list_contains(CASE WHEN n_regionkey % 2 = 0 THEN ['admin', 'analyst'] ELSE ['admin'] END, 'analyst')")
def role_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.when(F.col("n_regionkey") % 2 == 0, F.array(F.lit("admin"), F.lit("analyst"))).otherwise(F.array(F.lit("admin")))
    return R.allowed(table(ready(spark), sf_dir, "nation").withColumn("allowed_roles", roles), "analyst").select("n_name")


_COST = "(SELECT 't' || (l_suppkey % 9) AS tenant, 'cloud' || (l_partkey % 3) AS cloud, l_returnflag AS domain, l_quantity AS cost FROM lineitem)"


@query("a11_cost_attribution", f"SELECT 'total' AS level, '' AS name, sum(cost) AS cost FROM {_COST} c UNION ALL SELECT 'tenant', tenant, sum(cost) FROM {_COST} c GROUP BY tenant UNION ALL SELECT 'cloud', cloud, sum(cost) FROM {_COST} c GROUP BY cloud UNION ALL SELECT 'domain', domain, sum(cost) FROM {_COST} c GROUP BY domain")
def cost_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    return R.cost_attribution(table(ready(spark), sf_dir, "lineitem").select(named("t", "l_suppkey", 9).alias("tenant"), named("cloud", "l_partkey", 3).alias("cloud"), F.col("l_returnflag").alias("domain"), F.col("l_quantity").alias("cost")))


@query("a13_recurring_revenue", "SELECT c_mktsegment AS tenant, round(sum(c_acctbal), 2) AS mrr, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END), 2) AS active_mrr FROM customer GROUP BY 1")
def recurring_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    subscriptions = table(ready(spark), sf_dir, "customer").select(F.col("c_mktsegment").alias("tenant"), F.col("c_acctbal").alias("price"), (F.col("c_acctbal") > 0).alias("active"))
    return R.recurring_revenue(subscriptions).withColumns({c: F.round(c, 2) for c in ("mrr", "active_mrr")})


@query("a13_churn_rate", "SELECT count(*) FILTER (WHERE c_acctbal < 1000)::DOUBLE / count(*) AS rate FROM customer")
def churn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ratio(table(ready(spark), sf_dir, "customer"), F.col("c_acctbal") < 1000, F.lit(True))


@query("a14_metered_bill", "SELECT l_suppkey AS tenant, round(sum(l_quantity * price), 2) AS amount FROM lineitem JOIN (VALUES ('A', 0.5::DOUBLE), ('N', 0.25), ('R', 2.0)) p(kind, price) ON l_returnflag = kind GROUP BY 1")
def metered_bill(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = ready(spark).createDataFrame([("A", 0.5), ("N", 0.25), ("R", 2.0)], "kind string, price double")
    usage = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tenant"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("quantity"))
    return R.metered_bill(usage, prices).withColumn("amount", F.round("amount", 2))


@query("a15_position_percentiles", "WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events) SELECT max(CASE WHEN i = n // 2 THEN value END) AS p50, max(CASE WHEN i = floor(n * 0.95) - 1 THEN value END) AS p95, max(value) AS max FROM s")
def position_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.position_percentiles(table(ready(spark), sf_dir, "events"), "value")


@query("a12_weighted_mean", "SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(R.weighted_mean(table(ready(spark), sf_dir, "lineitem"), "l_extendedprice", "l_quantity"), "mean")


# Snapshots and the SQL subset.

_AS_OF = f"(SELECT key, arg_max(value, commit_ts) AS value, arg_max(write_type, commit_ts) AS write_type FROM {VERSIONS} v WHERE write_type <> 'LOCK' AND commit_ts <= 700 GROUP BY key)"


@query("sc1_snapshot_scan", f"SELECT key, value FROM {_AS_OF} a WHERE write_type <> 'DELETE' AND key >= 'u0010' AND key < 'u0100' ORDER BY key")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.snapshot_scan(versions(spark, sf_dir), "u0010", "u0100", 700)


@query("sc2_snapshot_read", f"SELECT key, value FROM {_AS_OF} a WHERE write_type <> 'DELETE' AND key = 'u0046'")
def snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.snapshot_read(versions(spark, sf_dir), "u0046", 700)


@query("sc3_as_of", f"SELECT key, value FROM {_AS_OF} a WHERE write_type <> 'DELETE'")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.as_of(versions(spark, sf_dir), 700)


@query("sc4_latest", f"SELECT key, value FROM (SELECT key, arg_max(value, commit_ts) AS value, arg_max(write_type, commit_ts) AS w FROM {VERSIONS} v WHERE write_type <> 'LOCK' GROUP BY key) a WHERE w <> 'DELETE'")
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.as_of(versions(spark, sf_dir))


@query("sc5_history", f"SELECT * FROM {VERSIONS} v WHERE key = 'u0046' ORDER BY commit_ts")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.history(versions(spark, sf_dir), "u0046")


@query("sc6_sql_scan", f"SELECT key, value FROM {_AS_OF} a WHERE write_type <> 'DELETE' AND key >= 'u0020' AND key < 'u0099' ORDER BY key LIMIT 12")
def sql_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv_sql.execute("SELECT * FROM kv WHERE key >= 'U0020' AND key < 'u0099' LIMIT 12", versions(spark, sf_dir), 700)


@query("sc6_sql_point_ignores_limit", f"SELECT key, value FROM {_AS_OF} a WHERE write_type <> 'DELETE' AND key = 'u0046'")
def sql_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv_sql.execute("select * from kv where key = 'U0046' limit 0", versions(spark, sf_dir), 700)


@query("f12_explain", "SELECT 'SCAN kv -> FILTER key >= ''a'' AND key < ''b'' -> LIMIT 5' AS plan")
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).createDataFrame([(kv_sql.explain("SELECT * FROM kv WHERE key >= 'A' AND key < 'b' LIMIT 5"),)], "plan string")


_SOURCES = "(SELECT o_custkey AS key, max(o_orderkey) AS value, max(o_orderkey) % 11 = 0 AS deleted, CASE WHEN max(o_orderkey) % 5 = 0 THEN 500::BIGINT END AS expire_ms, 0 AS source FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 UNION ALL SELECT o_custkey, min(o_orderkey), false, NULL, 1 FROM orders GROUP BY 1)"


@query("sc8_merge_scan", f"SELECT key, value FROM (SELECT key, arg_min(struct_pack(value := value, deleted := deleted, expire_ms := expire_ms), source) AS f FROM {_SOURCES} s GROUP BY key) m, (SELECT 1) WHERE NOT f.deleted AND (f.expire_ms IS NULL OR f.expire_ms > 1000)".replace("SELECT key, value FROM (SELECT key, arg_min", "SELECT key, f.value AS value FROM (SELECT key, arg_min"))
def merge_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(ready(spark), sf_dir, "orders").withColumnRenamed("o_custkey", "key")
    new = orders.where("o_orderstatus = 'O'").groupBy("key").agg(F.max("o_orderkey").alias("value")).withColumn("deleted", F.col("value") % 11 == 0).withColumn("expire_ms", F.when(F.col("value") % 5 == 0, F.lit(500).cast("long")))
    old = orders.groupBy("key").agg(F.min("o_orderkey").alias("value")).withColumn("deleted", F.lit(False)).withColumn("expire_ms", F.lit(None).cast("long"))
    return V.merge_scan([new, old], 1000)


@query("sc7_live_entries", f"SELECT key, value FROM {_SOURCES} s WHERE source = 0 AND NOT deleted AND (expire_ms IS NULL OR expire_ms > 400)")
def live_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(ready(spark), sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("value")).withColumn("deleted", F.col("value") % 11 == 0).withColumn("expire_ms", F.when(F.col("value") % 5 == 0, F.lit(500).cast("long")))
    return new.where(V.live(400)).select("key", "value")


@query("x5_time_to_live", f"SELECT key, CASE WHEN deleted OR expire_ms <= 400 THEN -2 WHEN expire_ms IS NULL THEN -1 ELSE expire_ms - 400 END::BIGINT AS ttl FROM {_SOURCES} s WHERE source = 0")
def time_to_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(ready(spark), sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("value")).withColumn("deleted", F.col("value") % 11 == 0).withColumn("expire_ms", F.when(F.col("value") % 5 == 0, F.lit(500).cast("long")))
    return new.select("key", V.time_to_live(400).alias("ttl"))


@query("sc12_scan_page", "SELECT position, key FROM (SELECT c_name AS key, row_number() OVER (ORDER BY c_name) - 1 AS position FROM customer) c WHERE position >= 40 AND position < 140 AND regexp_matches(key, '^Customer#.*7.$') ORDER BY key")
def scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.scan_page(table(ready(spark), sf_dir, "customer").select(F.col("c_name").alias("key")), "Customer#*7?", 40, 100)


@query("f8_glob", "SELECT DISTINCT p_name FROM part WHERE regexp_matches(p_name, '^.*ed w.dget$')")
def glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ready(spark), sf_dir, "part").where(V.glob(F.col("p_name"), "*ed w?dget")).select("p_name").distinct()


@query("sc13_key_facts", "SELECT count(*) AS dbsize, count(*) FILTER (WHERE e = 'int') AS ints, count(*) FILTER (WHERE e = 'embstr') AS embedded, count(*) FILTER (WHERE e = 'raw') AS raws FROM (SELECT CASE WHEN try_cast(v AS BIGINT) IS NOT NULL THEN 'int' WHEN strlen(v) <= 44 THEN 'embstr' ELSE 'raw' END AS e FROM (SELECT substr(text, 1, 30 + (doc_id % 30)::INT) AS v FROM documents UNION ALL SELECT doc_id::VARCHAR FROM documents) u) t")
def key_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(ready(spark), sf_dir, "documents")
    values = docs.select(F.substring("text", F.lit(1), (F.col("doc_id") % 30 + 30).cast("int")).alias("v")).union(docs.select(F.col("doc_id").cast("string")))
    e = values.select(V.encoding(F.col("v")).alias("e"))
    return e.agg(F.count(F.lit(1)).alias("dbsize"), *(F.count_if(F.col("e") == k).alias(n) for k, n in (("int", "ints"), ("embstr", "embedded"), ("raw", "raws"))))


@query("t15_point_in_time", f"SELECT key, value FROM (SELECT key, arg_max(value, commit_ts) AS value, arg_max(write_type, commit_ts) AS w FROM {VERSIONS} v WHERE write_type <> 'LOCK' AND commit_ts <= 650 GROUP BY key) a WHERE w <> 'DELETE'")
def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = versions(spark, sf_dir)
    return V.restore(v.where("commit_ts <= 300"), v.where("commit_ts > 300"), 650)


_AGED = f"(SELECT *, row_number() OVER (PARTITION BY key ORDER BY commit_ts DESC) AS age FROM {VERSIONS} v)"


@query("t16_version_gc", f"SELECT key, value, start_ts, commit_ts, write_type FROM {_AGED} a WHERE age > 1 AND commit_ts < 800")
def version_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.garbage(versions(spark, sf_dir), 800)


@query("t16_version_gc_batch", f"SELECT key, value, start_ts, commit_ts, write_type FROM {_AGED} a WHERE age > 1 AND commit_ts < 800 AND write_type <> 'LOCK'")
def version_gc_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.garbage(versions(spark, sf_dir), 800, keep_locks=True)


@query("k2_transactions", "WITH o AS (SELECT user_id * 1000 + event_id // 50 AS txn, event_id AS seq, event_type AS t, 'k' || (user_id % 40) AS key, props AS value FROM events), c AS (SELECT DISTINCT txn FROM o WHERE t = 'purchase'), l AS (SELECT key, arg_max(t, seq) AS t, arg_max(value, seq) AS value FROM o WHERE t IN ('click', 'error') AND txn IN (SELECT txn FROM c) GROUP BY key) SELECT key, value FROM l WHERE t = 'click'")
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "SET").when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "purchase", "COMMIT").otherwise("ROLLBACK")
    ops = table(ready(spark), sf_dir, "events").select((F.col("user_id") * 1000 + F.floor(F.col("event_id") / 50)).alias("txn"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("k"), (F.col("user_id") % 40).cast("string")).alias("key"), F.col("props").alias("value"))
    return kv_sql.fold_operations(ops)


@query("f6_shard_pruning", "SELECT l_orderkey // 500 AS shard, count(*) AS n FROM lineitem WHERE l_orderkey >= 1200 AND l_orderkey < 2600 GROUP BY 1")
def shard_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(ready(spark), sf_dir, "lineitem")
    count = (lines.agg(F.max("l_orderkey")).first()[0] or 0) // 500 + 1
    shards = sharding.prune(sharding.plan_shards(count, ["eu", "us"], 0, 500 * count), 1200, 2600)
    lines = lines.where("l_orderkey >= 1200 and l_orderkey < 2600")
    return lines.groupBy(sharding.shard_column(F.col("l_orderkey"), shards).cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query("x7_routes")
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return table(ready(spark), sf_dir, "customer").select("c_name", sharding.hash_slot(name).alias("slot"), sharding.fnv_route(name, 8).alias("route"), sharding.java_hash(name).alias("java"))


# Planning figures.


@query("o11_pareto_front", "WITH c AS (SELECT p_partkey AS name, p_size / 50.0::DOUBLE AS slo, (p_partkey % 97) / 100.0::DOUBLE AS cost, (p_partkey % 89) / 100.0::DOUBLE AS risk FROM part) SELECT name, slo, cost, risk FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.slo >= a.slo AND b.cost <= a.cost AND b.risk <= a.risk AND (b.slo > a.slo OR b.cost < a.cost OR b.risk < a.risk))")
def pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.skyline(_candidates(spark, sf_dir))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ready(spark), sf_dir, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") / 50.0).alias("slo"), ((F.col("p_partkey") % 97) / 100.0).alias("cost"), ((F.col("p_partkey") % 89) / 100.0).alias("risk"))


@query("o11_weighted_choice", "SELECT p_partkey AS name FROM part ORDER BY round(2 * (p_size / 50.0::DOUBLE) - (p_partkey % 97) / 100.0::DOUBLE - 0.5 * ((p_partkey % 89) / 100.0::DOUBLE), 9) DESC, p_partkey LIMIT 1")
def weighted_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.weighted_choice(_candidates(spark, sf_dir).withColumn("ord", F.col("name")), 2.0, 1.0, 0.5).select("name")


_OPTIONS = "(SELECT s_suppkey AS ord, s_name AS cloud, round(s_acctbal / 1000, 1) AS price, (s_suppkey % 10) / 20.0::DOUBLE AS interruption_rate, s_suppkey % 50 AS quota, s_suppkey % 3 <> 0 AS meets_slo, CASE WHEN s_nationkey < 15 THEN 'eu' ELSE 'us' END AS residency FROM supplier)"


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(ready(spark), sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("cloud"), F.round(F.col("s_acctbal") / 1000, 1).alias("price"), ((F.col("s_suppkey") % 10) / 20.0).alias("interruption_rate"), (F.col("s_suppkey") % 50).alias("quota"), (F.col("s_suppkey") % 3 != 0).alias("meets_slo"), F.when(F.col("s_nationkey") < 15, "eu").otherwise("us").alias("residency"))


@query("o12_cheapest_option", f"SELECT cloud, price FROM {_OPTIONS} o WHERE residency = 'eu' AND quota >= 10 AND meets_slo ORDER BY price, ord LIMIT 1")
def cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.cheapest(_options(spark, sf_dir), "eu", 10, True).select("cloud", "price")


@query("x84_spot_cost", f"SELECT cloud, round(price * (1 + interruption_rate * 2), 4) AS expected, 5.0 >= price AND interruption_rate <= 0.2 AS wins FROM {_OPTIONS} o")
def spot_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _options(spark, sf_dir).select("cloud", F.round(L.expected_spot_cost(), 4).alias("expected"), L.bid_wins(5.0, 0.2).alias("wins"))


@query("w12_rolling_compliance", "SELECT slo, seq, compliance, CASE WHEN compliance >= 0.85 THEN 'COMPLIANT' WHEN compliance >= 0.85::DOUBLE - 0.10::DOUBLE THEN 'AT_RISK' ELSE 'BREACHED' END AS status FROM (SELECT user_id % 10 AS slo, event_id AS seq, avg((event_type <> 'error')::INT) OVER (PARTITION BY user_id % 10 ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS compliance FROM events) c")
def rolling_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(ready(spark), sf_dir, "events").select((F.col("user_id") % 10).alias("slo"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("success"))
    return L.rolling_compliance(outcomes, 20, 0.85).select("slo", "seq", "compliance", "status")


@query("x82_slo_budget", "SELECT s_suppkey, CASE WHEN c >= 0.9 THEN n ELSE least(40, n + greatest(1, ceil(n * ((0.9::DOUBLE - c) / 0.9::DOUBLE) * 2.0)::INT)) END::INT AS suggested, CASE WHEN c >= 0.9 THEN 'MAINTAIN' ELSE 'SCALE_UP' END AS action FROM (SELECT s_suppkey, (s_suppkey % 100) / 100.0::DOUBLE AS c, (s_suppkey % 20 + 1)::INT AS n FROM supplier) s")
def slo_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = table(ready(spark), sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 100) / 100.0).alias("compliance"), (F.col("s_suppkey") % 20 + 1).cast("int").alias("nodes"))
    return L.slo_budget(rows_, 0.9, 40).select("s_suppkey", "suggested", "action")


@query("x83_negotiation", "WITH s AS (SELECT n_name AS slo, (n_nationkey * 13 % 25) / 25.0::DOUBLE AS attainment, 0.8::DOUBLE AS target, (n_nationkey % 4)::DOUBLE AS weight, n_nationkey AS ord FROM nation), d AS (SELECT *, greatest(0, (target - attainment) / target) AS deficit FROM s) SELECT arg_min(slo, (-deficit, ord)) AS worst_slo, round(max(deficit), 6) AS worst_deficit, round(sum(weight * deficit) / sum(weight), 6) AS weighted_deficit FROM d")
def negotiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    slos = table(ready(spark), sf_dir, "nation").select(F.col("n_name").alias("slo"), ((F.col("n_nationkey") * 13 % 25) / 25.0).alias("attainment"), F.lit(0.8).alias("target"), (F.col("n_nationkey") % 4).cast("double").alias("weight"), F.col("n_nationkey").alias("ord"))
    return L.negotiate(slos).withColumns({c: F.round(c, 6) for c in ("worst_deficit", "weighted_deficit")})


@query("x72_cost_suggestions", "WITH p AS (SELECT c_custkey AS tenant, c_custkey % 40 AS reads, c_custkey % 70 AS writes, c_custkey % 150 AS storage_gb, c_custkey % 90 AS value_kb, c_custkey::DOUBLE AS cost FROM customer) SELECT tenant, 'SCALE_DOWN' AS kind, round(cost * 0.3, 4) AS saving, CASE WHEN storage_gb >= 100 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM p WHERE reads + writes < 30 AND storage_gb > 0 UNION ALL SELECT tenant, 'COLD_TIER', round(cost * 0.5, 4), 'MEDIUM' FROM p WHERE reads + writes > 0 AND writes / (reads + writes)::DOUBLE >= 0.7 AND storage_gb >= 50 UNION ALL SELECT tenant, 'COMPRESSION', round(cost * 0.15, 4), 'LOW' FROM p WHERE value_kb >= 64")
def cost_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    profiles = table(ready(spark), sf_dir, "customer").select(k.alias("tenant"), (k % 40).alias("reads"), (k % 70).alias("writes"), (k % 150).alias("storage_gb"), (k % 90).alias("value_kb"), k.cast("double").alias("cost"))
    return _rounded(L.cost_suggestions(profiles, 30, 0.7, 64), "saving")


@query("x73_capacity", "SELECT p_partkey, (p_size * 1000::BIGINT * (p_partkey % 500 + 96) * 3)::DOUBLE AS memory_bytes, round(p_retailprice * 0.25 * (p_partkey % 500) * 86400 * 7 * 3, 0) AS disk_bytes, round(p_retailprice * 1.2, 4) AS required_qps, 5.0::DOUBLE AS latency_ms FROM part")
def capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = table(ready(spark), sf_dir, "part").select("p_partkey", (F.col("p_size") * F.lit(1000).cast("long")).alias("active_keys"), (F.col("p_partkey") % 500).alias("value_bytes"), F.col("p_retailprice").alias("qps"), F.lit(0.75).alias("read_ratio"), F.lit(3).alias("replication"), F.lit(7).alias("retention_days"))
    return L.capacity(inputs).select("p_partkey", "memory_bytes", F.round("disk_bytes", 0).alias("disk_bytes"), F.round("required_qps", 4).alias("required_qps"), "latency_ms")


@query("x71_alerts", "SELECT metric, round(m.value, 4) AS value FROM (SELECT event_type AS metric, avg(value) AS value FROM events GROUP BY 1) m JOIN (VALUES ('click', '>', 1.0::DOUBLE), ('view', '<', 1.0), ('error', '>', 1e6)) r(metric, comparison, threshold) USING (metric) WHERE CASE WHEN comparison = '>' THEN m.value > threshold ELSE m.value < threshold END")
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ready(spark).createDataFrame([("click", ">", 1.0), ("view", "<", 1.0), ("error", ">", 1e6)], "metric string, comparison string, threshold double")
    metrics = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return _rounded(L.alerts(metrics, rules).select("metric", "value"), "value")


@query("x78_rebalance", "WITH l AS (SELECT s_nationkey AS node, count(*) AS load FROM supplier GROUP BY 1) SELECT a.node AS source, b.node AS target, least(a.load - 4, 4 - b.load) AS amount FROM l a, l b WHERE a.load > 4 AND b.load < 4")
def rebalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rebalance(table(ready(spark), sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("node")).agg(F.count(F.lit(1)).alias("load")), 4)


@query("x79_placement", "WITH p AS (SELECT n, count(*) AS c FROM (SELECT unnest([n_nationkey % 5, n_nationkey * 7 % 5, n_regionkey]) AS n FROM nation WHERE n_nationkey % 6 <> 0) u GROUP BY n) SELECT max(c) AS most, min(c) AS least, max(c) - min(c) AS skew, max(c) - min(c) <= 3 AS balanced FROM p")
def placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    peers = F.array(F.col("n_nationkey") % 5, F.col("n_nationkey") * 7 % 5, F.col("n_regionkey"))
    return L.placement(table(ready(spark), sf_dir, "nation").select(F.when(F.col("n_nationkey") % 6 != 0, "NORMAL").otherwise("MERGING").alias("state"), peers.alias("peers")), 3)


@query("x80_clause_changes", """WITH a AS (SELECT DISTINCT n_name || CASE WHEN n_nationkey % 3 = 0 THEN ':' || n_regionkey ELSE '' END AS clause FROM nation WHERE n_nationkey < 18), b AS (SELECT DISTINCT n_name || CASE WHEN n_nationkey % 2 = 0 THEN ':' || n_regionkey || ':x' ELSE '' END AS clause FROM nation WHERE n_nationkey > 4)
SELECT clause, 'added' AS change FROM b WHERE clause NOT IN (FROM a) UNION ALL SELECT clause, 'removed' FROM a WHERE clause NOT IN (FROM b) UNION ALL SELECT b.clause, 'changed' FROM a, b WHERE starts_with(a.clause, b.clause || ':') OR starts_with(b.clause, a.clause || ':')""")
def clause_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(ready(spark), sf_dir, "nation")
    region = F.col("n_regionkey").cast("string")
    old = nation.where("n_nationkey < 18").select(F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(":"), region)).otherwise("")).alias("clause"))
    new = nation.where("n_nationkey > 4").select(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(":"), region, F.lit(":x"))).otherwise("")).alias("clause"))
    return L.clause_changes(old, new)


@query("x81_trace_sampling")
def trace_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.sampled(table(ready(spark), sf_dir, "customer").select("c_name"), F.col("c_name"), 0.1)


@query("sc21_invoice_csv", "SELECT concat_ws(',', l_orderkey::VARCHAR, l_returnflag, l_quantity::BIGINT::VARCHAR) AS line FROM lineitem")
def invoice_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyglint.sources.exports import csv_lines

    return csv_lines(table(ready(spark), sf_dir, "lineitem").withColumn("quantity", F.col("l_quantity").cast("long")), "l_orderkey", "l_returnflag", "quantity")


@query("sc22_audit_csv", r"""SELECT '"' || replace(replace(props, '"', '\"'), ',', '\,') || '","' || event_type || '",' || event_id AS line FROM events""")
def audit_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyglint.sources.exports import quoted_csv_lines

    return quoted_csv_lines(table(ready(spark), sf_dir, "events"), ["props", "event_type"], ["event_id"])


@query("sc22_audit_json", """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS line FROM events""")
def audit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyglint.sources.exports import json_lines

    return json_lines(table(ready(spark), sf_dir, "events"), "event_id", "event_type")
