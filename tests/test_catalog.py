"""Every registered query of the library runs on the smallest tables and, where it has SQL, gives the SQL's rows."""

import datetime
import os

import duckdb
import pytest

from polyglint import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

catalog.load()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return connection


def plain(value):
    if isinstance(value, float):
        return f"{value:.7g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return "" if value is None else str(value)


def table(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted([plain(r[i]) for i in order] for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    found = catalog.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in found.collect()]
    if name in catalog.ORACLES:
        expected = duck.execute(catalog.ORACLES[name])
        columns = [d[0] for d in expected.description]
        assert table(rows, found.columns) == table(expected.fetchall(), columns)
    else:
        assert rows or name == "x81_trace_sampling"  # a sample of few names may be empty
