"""Small fixtures with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyglint.functions import json_path as J
from polyglint.functions import places as G
from polyglint.functions import ranking as Z
from polyglint.functions import series as TS
from polyglint.functions import sets as S
from polyglint.functions import values as X
from polyglint.functions import vectors as V
from polyglint.operators import pipeline as P
from polyglint.operators import relational as R
from polyglint.plans import kv_sql, sharding
from polyglint.sources import versions as MV
from polyglint.streaming import changes as C


def rows(spark, data, schema="key string, value double"):
    return spark.createDataFrame(data, schema)


def values(df, column="value"):
    return [r[column] for r in df.collect()]


@pytest.mark.parametrize(
    ("name", "expected"),
    [("LAG", [0, 0, 10]), ("LEAD", [10, 20, 0]), ("SUM_OVER", [0, 10, 30]), ("COUNT_OVER", [1, 2, 3]), ("AVG_OVER", [0, 5, 10]), ("ROW_NUMBER", [1, 2, 3]), ("NONE", [0, 10, 20])],
)
def test_windows(spark, name, expected):
    data = rows(spark, [("a", 0.0), ("a", 10.0), ("a", 20.0)])
    assert sorted(values(P.run(data, P.Request(["WINDOW"], window=name)))) == sorted(expected)


def test_rank_has_no_gaps(spark):
    data = rows(spark, [("a", 10.0), ("a", 10.0), ("a", 20.0), ("b", 5.0)])
    out = P.run(data, P.Request(["WINDOW"], window="RANK")).where("key = 'a'")
    assert sorted(values(out)) == [1, 1, 2]


def test_filter_comes_before_window(spark):
    data = rows(spark, [("a", 0.0), ("a", 10.0), ("a", 20.0)])
    assert values(P.run(data, P.Request(["WINDOW", "FILTER"], start="a", end="z", threshold=20.0, window="SUM_OVER"))) == [20]


def test_chained_joins(spark):
    data = rows(spark, [(f"k{i}", i * 100.0) for i in range(4)])
    out = P.run(data, P.Request(["JOIN"], start="k0", end="zz", join_rows=data, join_tables=[data]))
    assert sorted(values(out)) == [0, 300, 600, 900]
    assert values(P.run(data, P.Request(["JOIN"], join_rows=data.limit(0)))) == values(data)
    with pytest.raises(ValueError):
        P.run(data, P.Request(["SORT"]))


def test_averages_divide_towards_zero_and_sums_wrap(spark):
    data = rows(spark, [("a", -7), ("b", 0)], "key string, value long")
    assert R.aggregate(data, "AVG", F.col("value")).first()[0] == -3
    top = rows(spark, [("a", 2**63 - 1), ("b", 1)], "key string, value long")
    assert R.aggregate(top, "SUM", F.col("value")).first()[0] == -(2**63)
    for kind in R.AGGREGATES:
        assert R.aggregate(data.where("false"), kind, F.col("value")).first()[0] == 0


def test_hash_join_and_regions(spark):
    left, right = rows(spark, [("a1", "x"), ("a2", "y")], "key string, value string"), rows(spark, [("a1", "p"), ("a3", "q")], "key string, value string")
    assert [tuple(r) for r in R.hash_join(left, right, F.col("key"), F.col("key")).collect()] == [("a1", "x|p")]
    merged = {r["key"]: r["value"] for r in R.merge_regions([left, right]).collect()}
    assert merged == {"a1": "x", "a2": "y", "a3": "q"}


def test_federated(spark):
    shards = rows(spark, [(10.0, 1), (30.0, 3)], "value double, count long")
    assert tuple(R.federated_aggregate(shards, "AVG").first()) == (25.0, 4)
    assert tuple(R.federated_aggregate(shards, "MIN").first()) == (10.0, 2)
    assert tuple(R.federated_aggregate(shards.where("false"), "MAX").first()) == (0.0, 0)
    left = rows(spark, [("c", 1), ("a", 2), ("b", 3), ("a", 4)], "key string, value long")
    right = rows(spark, [("a", 5, 1), ("a", 6, 2), ("b", 7, 1)], "key string, value long, seq long")
    assert [tuple(r) for r in R.federated_join(left, right).collect()] == [("a", 2, 6), ("a", 4, 6), ("b", 3, 7)]


def test_snapshots(spark):
    schema = "key string, value string, start_ts long, commit_ts long, write_type string"
    data = rows(spark, [("k", "v1", 9, 10, "PUT"), ("k", "v2", 19, 20, "PUT"), ("d", "v", 9, 10, "PUT"), ("d", None, 19, 20, "DELETE"), ("k", "x", 24, 25, "LOCK")], schema)
    assert values(MV.snapshot_read(data, "k", 15)) == ["v1"]
    assert values(MV.snapshot_read(data, "k")) == ["v2"]
    assert values(MV.snapshot_read(data, "d")) == []
    ten = rows(spark, [(f"k{i}", "v", 0, (i + 1) * 10, "PUT") for i in range(10)], schema)
    assert kv_sql.execute("SELECT * FROM kv WHERE key >= 'k0' AND key < 'k5'", ten).count() == 5
    assert kv_sql.execute("SELECT * FROM kv LIMIT 3", ten).count() == 3


@pytest.mark.parametrize("sql", ["SELECT * FROM kv", "select * from kv where key='a'", "SELECT * FROM kv WHERE key >= 'a' LIMIT 5", "SELECT * FROM kv WHERE key>='a' AND key<'b';"])
def test_accepted_sql(sql):
    kv_sql.parse(sql)


@pytest.mark.parametrize("sql", ["", "SELECT key FROM kv", "SELECT * FROM other", "SELECT * FROM kv WHERE key > 'a'", "SELECT * FROM kv WHERE key < 'b'", "SELECT * FROM kv LIMIT -1"])
def test_rejected_sql(sql):
    with pytest.raises(kv_sql.SqlError):
        kv_sql.parse(sql)


def test_literals_are_lower_cased():
    assert kv_sql.parse("SELECT * FROM kv WHERE key = 'ABC'").key == "abc"


def test_transaction_script():
    script = ["BEGIN", "SET 'a' = '1'", "SET 'b' = '2'", "COMMIT", "BEGIN", "DELETE FROM kv WHERE key = 'a'", "ROLLBACK"]
    assert kv_sql.transaction_writes(script) == [("a", "1"), ("b", "2")]
    for bad in (["BEGIN", "BEGIN"], ["SET 'a' = '1'"], ["BEGIN", "DROP"]):
        with pytest.raises(kv_sql.SqlError):
            kv_sql.transaction_writes(bad)


def test_error_kinds(spark):
    for sql, kind in (("SELEC 1", "SYNTAX"), ("SELECT nope FROM range(1)", "UNKNOWN_COLUMN"), ("SELECT array(1) + 1", "TYPE")):
        with pytest.raises(Exception) as caught:
            spark.sql(sql)
        assert kv_sql.error_kind(caught.value) == kind


def test_series(spark):
    data = rows(spark, [("k", i, t, v) for i, (t, v) in enumerate([(1000, 1.0), (2000, 2.0), (3000, 3.0), (4100, 4.0), (5000, 5.0)])], "series string, seq long, ts_ms long, value double")
    assert [tuple(r) for r in TS.ranged(data, "k", kind="AVG", width=2000).collect()] == [(0, 1.0), (2000, 2.5), (4000, 4.5)]
    expected = {"SUM": 5, "MIN": 2, "MAX": 3, "COUNT": 2, "FIRST": 2, "LAST": 3}
    for kind, value in expected.items():
        assert TS.ranged(data, "k", kind=kind, width=2000).where("ts_ms = 2000").first()["value"] == value
    assert values(TS.ranged(data, "k", count=2), "ts_ms") == [1000, 2000]
    early = rows(spark, [("k", 0, -1000, 1.0), ("k", 1, 0, 2.0), ("k", 2, 1000, 3.0)], "series string, seq long, ts_ms long, value double")
    assert [tuple(r) for r in TS.ranged(early, "k", kind="AVG", width=2000).collect()] == [(-2000, 1.0), (0, 2.5)]


def test_trend_of_a_line_and_of_a_constant(spark):
    data = rows(spark, [("line", float(x), 2.0 * x + 1) for x in range(10)] + [("flat", 3.0, y) for y in (1.0, 5.0)] + [("grow", float(x), float(np.exp(0.5 * x))) for x in range(10)], "series string, x double, y double")
    out = {r["series"]: r for r in TS.trend(data, 20).collect()}
    assert out["line"]["model"] == "linear" and abs(out["line"]["value"] - 41) < 1e-9 and abs(out["line"]["upper"] - 41) < 1e-6
    assert out["flat"]["lower"] == out["flat"]["upper"] == 3.0
    assert out["grow"]["model"] == "exponential" and abs(out["grow"]["value"] / np.exp(10) - 1) < 1e-9


def test_trend_query_agrees_with_its_sql_where_a_fit_is_missing(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from polyglint import catalog

    catalog.load()
    series = {"zero": [1.0, 0.0, 5.0, 8.0], "minus": [1.0, -1.0, 5.0, 8.0], "gap": [1.0, None, 5.0, 8.0], "one": [3.0], "none": [None, None], "inf": [1.0, float("inf"), 2.0], "nan": [float("nan"), 1.0, 2.0], "line": [3.0, 5.0, 7.5, 9.0], "zeros": [0.0, 0.0]}
    events = [(name, 19_990 + k, y) for name, values_ in series.items() for k, y in enumerate(values_)] + [("flat", 19_995, 1.0), ("flat", 19_995, 2.0), (None, 19_991, 2.0), (None, 19_992, 3.0)]
    rows(spark, events, "event_type string, event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    own = duckdb.connect()
    own.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    expected = sorted(own.execute(catalog.ORACLES["x70_trend"]).fetchall())
    assert sorted(tuple(r) for r in catalog.QUERIES["x70_trend"](spark, str(tmp_path)).collect()) == expected
    assert ("zero", "exponential", None, None, None) in expected and ("line", "linear") in [e[:2] for e in expected]


def test_json_paths(spark):
    doc = '{"store":{"book":[{"title":"A","price":8.95},{"title":"B","price":12.99}],"bicycle":{"color":"red","price":19.95}}}'
    one = rows(spark, [(doc,), (None,)], "doc string")

    def of(column):
        return one.select(column.alias("c")).collect()[0]["c"]

    d = F.col("doc")
    assert of(J.get(d, ".store.bicycle.color")) == '"red"'
    assert of(J.get(d, "$.store.book[0].title")) == '["A"]'
    assert of(J.matches(d, "$..price")) == ["8.95", "12.99", "19.95"]
    assert of(J.get(d, "$.nope")) == "[]" and of(J.get(d, "nope")) is None
    assert of(J.get(d, "store.book[-1].title")) == '"B"'
    assert of(J.matches(d, "$.store.book[*].title")) == ['"A"', '"B"']
    assert of(J.put(d, "$.store.book[0].title", '"C"', "NX")) == doc
    assert of(J.length(J.append(d, "$.store.book", "1", "2"), "$.store.book")) == 4
    assert of(J.get(J.increment(d, "$.store.bicycle.price", 0.05), "store.bicycle.price")) == "20"
    with pytest.raises(ValueError):
        J.put(d, "$..price", "1")


def test_places(spark):
    data = rows(spark, [("Palermo", 13.361389, 38.115556), ("Catania", 15.087269, 37.502669)], "member string, lon double, lat double")
    a, b = F.lit(13.361389), F.lit(38.115556)
    metres = data.where("member = 'Catania'").select(G.distance(a, b, F.col("lon"), F.col("lat")).alias("m")).first()["m"]
    assert abs(metres - 166274.1516) < 0.5
    hashes = {r["member"]: r["hash"] for r in G.with_hash_text(data).collect()}
    assert hashes == {"Palermo": "sqc8b49rny0", "Catania": "sqdtr74hyu0"}
    assert values(G.within_radius(data, 15.0, 37.0, 200, "km"), "member") == ["Catania", "Palermo"]


def test_vectors(spark):
    data = rows(spark, [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("z", [0.0, 0.0]), ("l", [1.0, 0.0, 0.0])], "id string, embedding array<float>")
    assert [tuple(r) for r in V.search(data, [1.0, 0.0], 2).collect()] == [("a", 1.0), ("b", 0.0)]
    pairs = {r["id"]: r["c"] for r in data.select("id", V.cosine(F.col("embedding"), F.array(F.lit(1.0).cast("float"), F.lit(0.0).cast("float"))).alias("c")).collect()}
    assert pairs == {"a": 1.0, "b": 0.0, "z": 0.0, "l": 0.0}


def test_cell_index_recall(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, (2000, 64)).astype(np.float32)
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    index = V.CellIndex(data, cells=16)
    table = index.table.cache()
    index.table = table
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in rng.uniform(-1, 1, (10, 64)):
        best = set(np.argsort(-(unit @ (q / np.linalg.norm(q))))[:10].tolist())
        hits += len(best & set(values(index.search(q.tolist(), 10, probes=14), "id")))
    assert hits >= 90
    table.unpersist()


def test_cell_index_with_registered_parameters(spark):
    rng = np.random.default_rng(8)
    x = rng.uniform(-1, 1, (2000, 64)).astype(np.float32)
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    index = V.CellIndex(data)
    index.table = index.table.cache()
    for q in rng.uniform(-1, 1, (6, 64)):
        assert values(index.search(q.tolist(), 10), "id") == values(V.search(data, q.tolist(), 10), "id")
    index.table.unpersist()


def test_sorted_sets(spark):
    data = rows(spark, [("z", "c", 3.0), ("z", "a", 1.0), ("z", "b", 2.0)], "key string, member string, score double")
    assert values(Z.by_index(data, "z", 0, -1), "member") == ["a", "b", "c"]
    assert values(Z.by_score(data, "z", "(1", "+inf"), "member") == ["b", "c"]
    assert values(Z.by_lex(data, "z", "[b", "+"), "member") == ["b", "c"]


def test_bits(spark):
    one = rows(spark, [("foobar",)], "v string").select(F.encode("v", "UTF-8").alias("v"))
    got = one.select(S.bit_count(F.col("v")).alias("n"), S.bit_count(F.col("v"), 1, 1).alias("second"), S.bit_position(F.col("v"), 1).alias("p"), S.bit_operation("NOT", [F.col("v")]).alias("inv")).first()
    assert (got["n"], got["second"], got["p"], got["inv"]) == (26, 6, 1, "99909D9D9E8D".replace("9D9D9E8D", "909D9E8D"))


def test_routes(spark):
    one = rows(spark, [("123456789",), ("foo{bar}x",), ("hello",)], "k string")
    got = one.select(sharding.hash_slot(F.col("k")).alias("slot"), sharding.java_hash(F.col("k")).alias("java")).collect()
    assert got[0]["slot"] == 0x31C3 and got[1]["slot"] == 5061 and got[2]["java"] == 99162322


def test_shards():
    shards = sharding.plan_shards(4, ["eu", "us"], 0, 10)
    assert [(s.start, s.end) for s in shards] == [(0, 2), (2, 4), (4, 6), (6, 10)] and shards[3].region == "us"
    assert [s.shard for s in sharding.prune(shards, 3, 6)] == [1, 2]


def test_cache_needs_the_same_watermark(spark):
    cache = sharding.QueryCache()
    cache.put("q", 5, spark.range(3))
    assert cache.get("q", 6) is None and cache.get("q", 5).count() == 3
    cache.invalidate("q")
    assert cache.get("q", 5) is None


def test_views_of_changes(spark):
    schema = "seq long, key string, value double, deleted boolean"
    replaced = rows(spark, [(1, "k1", 10.0, False), (2, "k1", 20.0, False)], schema)
    assert C.maintained_view(replaced, "SUM").first()["value"] == 20
    deleted = rows(spark, [(1, "k1", 10.0, False), (2, "k2", 5.0, False), (3, "k1", None, True), (4, "zz", None, True)], schema)
    assert tuple(C.maintained_view(deleted, "SUM").first()) == (5.0, 1)


def test_lists(spark):
    one = rows(spark, [([1, 2, 3, 2],)], "i array<int>")
    i = F.col("i")
    got = one.select(X.list_range(i, -2, -1).alias("a"), X.list_range(i, 5, 9).alias("b"), X.list_index(i, -9).alias("c"), X.list_insert(i, F.lit(2), F.lit(9), True).alias("d"), X.list_remove(i, -1, F.lit(2)).alias("e")).first()
    assert tuple(got) == ([3, 2], [], None, [1, 9, 2, 3, 2], [1, 2, 3])
