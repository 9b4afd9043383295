"""Queries over change logs, streams, replicated state and maintained views."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.catalog import query
from polyglint.catalog.inputs import CHANGES, changes
from polyglint.runtime import ready, table
from polyglint.streaming import changes as C
from polyglint.streaming import replicas as R
from polyglint.streaming import streams as X
from polyglint.streaming.views import Views


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that executors share; a local one only where spark.checkpoint.dir is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{os.path.join(tempfile.gettempdir(), 'polyglint')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_CURRENT = f"(SELECT key, arg_max(value, seq) AS value FROM {CHANGES} c GROUP BY key HAVING NOT arg_max(deleted, seq))"


@query("t7_current_state", f"SELECT key, value FROM {_CURRENT} s")
def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.current(changes(spark, sf_dir))


_VIEW = {"SUM": "round(sum(value), 2)", "COUNT": "count(*)::DOUBLE", "AVG": "round(avg(value), 4)", "MIN": "min(value)", "MAX": "max(value)"}
for _kind, _sql in _VIEW.items():

    @query(f"a9_view_{_kind.lower()}", f"SELECT {_sql} AS value, count(*) AS count FROM {_CURRENT} s")
    def view(spark: SparkSession, sf_dir: str, kind: str = _kind) -> DataFrame:
        return C.maintained_view(changes(spark, sf_dir), kind).withColumn("value", F.round("value", 2 if kind == "SUM" else 4))


@query("a9_view_empty", "SELECT 0.0::DOUBLE AS value, 0::BIGINT AS count")
def empty_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.maintained_view(changes(spark, sf_dir).where("false"), "SUM")


@query("sc14_change_log", f"SELECT seq, key, value FROM {CHANGES} c")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changes(spark, sf_dir)
    path = scratch(spark, "log")
    C.append(log.where("seq < 5000"), path)
    C.append(log.where("seq >= 5000"), path)
    return C.read_all(spark, path).select("seq", "key", "value")


@query("sc15_watermark", f"SELECT region, max(seq) AS watermark FROM {CHANGES} c GROUP BY region")
def watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.watermarks(changes(spark, sf_dir))


@query("t5_resume", f"SELECT seq, key FROM {CHANGES} c WHERE seq > 900 ORDER BY seq LIMIT 64")
def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changes(spark, sf_dir)
    return C.consume(log.union(log.where("seq < 950")), 900, 64).select("seq", "key")


@query("t11_skip_applied", f"SELECT seq, region FROM {CHANGES} c WHERE seq > CASE region WHEN 'r0' THEN 600 WHEN 'r1' THEN 700 ELSE -1 END")
def skip_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = ready(spark).createDataFrame([("r0", 600), ("r1", 700)], "region string, watermark long")
    return C.unapplied(changes(spark, sf_dir), marks).select("seq", "region")


_ARRIVED = f"""
WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq % 7, seq) AS n, ts // 1440 AS day FROM {CHANGES} c),
s AS (SELECT key, n, region, seq, day, cluster, value FROM a WHERE n = 1
    UNION ALL SELECT s.key, a.n, CASE WHEN w THEN a.region ELSE s.region END, CASE WHEN w THEN a.seq ELSE s.seq END, CASE WHEN w THEN a.day ELSE s.day END, CASE WHEN w THEN a.cluster ELSE s.cluster END, CASE WHEN w THEN a.value ELSE s.value END
    FROM s JOIN a ON a.key = s.key AND a.n = s.n + 1, LATERAL (SELECT NOT (a.region = s.region AND a.seq <= s.seq) AND (a.day > s.day OR a.day = s.day AND a.cluster > s.cluster) AS w) l)
SELECT key, arg_max(value, n) AS value, arg_max(day, n) AS ts, arg_max(seq, n) AS seq FROM s GROUP BY key
"""


@query("t12_last_writer_wins", _ARRIVED)
def last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changes(spark, sf_dir).withColumns({"ts": F.floor(F.col("ts") / 1440), "arrival": F.struct(F.col("seq") % 7, "seq")})
    return C.last_writer(log).select("key", "value", "ts", "seq")


@query("t13_counters", "SELECT counter, sum(n)::BIGINT AS value FROM (SELECT event_type AS counter, user_id % 8 AS node, max(event_id) AS n FROM events GROUP BY 1, 2) g GROUP BY counter")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counter_value(table(ready(spark), sf_dir, "events").select(F.col("event_type").alias("counter"), (F.col("user_id") % 8).alias("node"), F.col("event_id").alias("count")))


@query("t13_register", "SELECT user_id AS key, arg_max(props, (event_id // 3, event_type, event_id)) AS value FROM events GROUP BY 1")
def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.register(table(ready(spark), sf_dir, "events").select(F.col("user_id").alias("key"), F.col("props").alias("value"), F.floor(F.col("event_id") / 3).alias("ts"), F.struct("event_type", "event_id").alias("node")))


@query("t13_version_vector", "SELECT event_type AS node, max(event_id) AS clock FROM events GROUP BY 1")
def version_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.version_vector(table(ready(spark), sf_dir, "events").select(F.col("event_type").alias("node"), F.col("event_id").alias("clock")))


@query("t14_conflicts", f"WITH m AS (SELECT *, count(*) FILTER (WHERE type = 'REGION_MOVE') OVER (PARTITION BY key ORDER BY seq) AS epoch FROM {CHANGES} c), f AS (SELECT *, first_value(region) OVER (PARTITION BY key, epoch ORDER BY seq) AS first_region FROM m WHERE type <> 'REGION_MOVE') SELECT seq, key, region, first_region FROM f WHERE region <> first_region")
def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conflicts(changes(spark, sf_dir)).select("seq", "key", "region", "first_region")


@query("t14_lag", f"WITH a AS (SELECT region, max(seq) AS s, max(ts_ms) AS t FROM {CHANGES} c WHERE seq < 700 GROUP BY region) SELECT c.region, count(*) FILTER (WHERE seq > s) AS pending, 1706745600000 - max(t) AS behind_ms FROM {CHANGES} c JOIN a ON c.region = a.region GROUP BY c.region")
def lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changes(spark, sf_dir)
    return C.lag(log, log.where("seq < 700"), F.lit(1706745600000))


_ENTRIES = "(SELECT 'u' || (user_id % 5) AS stream, epoch_us(ts) // 1000 AS ms, event_id % 3 AS seq, event_id AS arrival, event_type FROM events)"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polyglint.catalog.inputs import event_ms

    return table(ready(spark), sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("stream"), event_ms().alias("ms"), (F.col("event_id") % 3).alias("seq"), F.col("event_id").alias("arrival"), "event_type")


@query("t1_accepted_entries", f"SELECT stream, ms, seq FROM (SELECT *, max(ms * 1000000 + seq) OVER (PARTITION BY stream ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM {_ENTRIES} e) q WHERE h IS NULL OR ms * 1000000 + seq > h")
def accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.accepted(_entries(spark, sf_dir)).select("stream", "ms", "seq")


@query("t2_stream_range", f"SELECT stream, ms, seq FROM {_ENTRIES} e WHERE stream = 'u2' AND ms >= 1704240000000 AND ms < 1706000000000 ORDER BY ms, seq LIMIT 40")
def stream_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.ranged(_entries(spark, sf_dir), "u2", 1704240000000 * 1_000_000, 1706000000000 * 1_000_000 - 1, 40).select("stream", "ms", "seq")


@query("t2_stream_trim", f"SELECT stream, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY ms DESC, seq DESC) AS k FROM {_ENTRIES} e) q WHERE k <= 15")
def stream_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.trimmed(_entries(spark, sf_dir), 15).select("stream", "ms", "seq")


@query("t3_stream_after", f"SELECT stream, ms, seq FROM {_ENTRIES} e WHERE stream = 'u1' AND ms * 1000000 + seq > 1705500000000000000 ORDER BY ms, seq LIMIT 30")
def stream_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.after(_entries(spark, sf_dir), "u1", 1705500000000 * 1_000_000, 30).select("stream", "ms", "seq")


_GROUPS = """WITH d AS (SELECT 's' || (user_id % 2) AS stream, 'g' AS "group", 'c' || (event_id % 3) AS consumer, event_id // 2 AS id, event_id AS "at", event_type = 'signup' AS claim FROM events WHERE event_type IN ('click', 'view', 'signup')), a AS (SELECT DISTINCT 's' || (user_id % 2) AS stream, 'g' AS "group", event_id // 2 AS id FROM events WHERE event_type = 'purchase'), w AS (SELECT *, claim AND coalesce(lag(consumer) OVER (PARTITION BY stream, "group", id ORDER BY "at", claim) = consumer, false) AS again FROM d), s AS (SELECT stream, "group", id, arg_max(consumer, ("at", claim)) AS consumer, count(*) AS delivered, count(*) FILTER (WHERE again) AS dead_letters FROM w GROUP BY 1, 2, 3) """


def _group_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(ready(spark), sf_dir, "events").select(F.concat(F.lit("s"), (F.col("user_id") % 2).cast("string")).alias("stream"), F.lit("g").alias("group"), F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("consumer"), F.floor(F.col("event_id") / 2).alias("id"), F.col("event_id").alias("at"), "event_type")
    own = ["stream", "group", "consumer", "id", "at"]
    return X.group_state(e.where("event_type in ('click', 'view')").select(own), e.where("event_type = 'purchase'").select("stream", "group", "id"), e.where("event_type = 'signup'").select(own))


@query("t4_group_pending", _GROUPS + 'SELECT stream, "group", consumer, id, delivered, dead_letters FROM s ANTI JOIN a USING (stream, "group", id)')
def group_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group_state(spark, sf_dir)


@query("t4_group_summary", _GROUPS + 'SELECT stream, "group", consumer, count(*) AS pending, min(id) AS first_id, max(id) AS last_id FROM s ANTI JOIN a USING (stream, "group", id) GROUP BY 1, 2, 3')
def group_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pending(_group_state(spark, sf_dir))


@query("t17_receivers", "SELECT event_id AS message, (coalesce(n, 0) + (event_type LIKE 'c%')::INT + (event_type LIKE '%i%')::INT)::BIGINT AS n FROM events LEFT JOIN (VALUES ('click', 2), ('view', 1)) s(channel, n) ON event_type = channel")
def receivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = ready(spark).createDataFrame([("click", "a"), ("click", "b"), ("view", "a")], "channel string, subscriber string")
    messages = table(spark, sf_dir, "events").select(F.col("event_id").alias("message"), F.col("event_type").alias("channel"))
    return X.receivers(messages, channels, [("c", "c*"), ("d", "*i*")])


@query("t10_tumbling_window", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type AS key, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(ready(spark), sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("key"), "value")
    return C.tumbling(rows, "6 hours", "1 hour").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "key", "n", F.round("total", 2).alias("total"))


@query("t7_streamed_view", f"SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM {CHANGES} c GROUP BY key HAVING NOT arg_max(deleted, seq)")
def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, root = changes(spark, sf_dir).select("seq", "key", "value", "deleted"), scratch(spark, "streamed")
    schema = "seq long, key string, value double, deleted boolean"
    generations = 0
    for part in (log.where("seq % 2 = 0"), log.where("seq % 2 = 1")):
        C.append(part, f"{root}/log")
        run = C.maintain(spark, f"{root}/log", schema, f"{root}/checkpoint", f"{root}/state")
        run.awaitTermination()
        generations += 1
    state = spark.read.parquet(f"{root}/state/generation={generations - 1}")
    return state.where("not deleted").select("key", "value", "seq")


@query("t8_view_lifecycle", "SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def view_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = Views(ready(spark), scratch(spark, "views"))
    views.create("by_type", lambda: table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n")), 1000)
    views.refresh_if_due("by_type", 5000)
    views.refresh_if_due("by_type", 5500)
    views.reload("by_type", lambda: table(spark, sf_dir, "events"))
    return views.query("by_type")
