import os

import duckdb
import pytest

import __spark_entry__
from strada.plans import oracle, queries, services

SF = "/root/testdata/sf0.001"
TABLES = ("customer", "supplier", "part", "orders")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_agree_with_their_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(columns).collect()
    if name not in oracle.ORACLES:
        assert rows
        return
    want = con.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({oracle.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_every_sql_text_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_one_way_is_told_without_the_network(spark, monkeypatch):
    built = services.inspect(queries.net(spark, SF), 1000).collect()
    monkeypatch.setattr(queries, "net", lambda s, d: pytest.fail("the whole network was built"))
    assert [r["path"] for r in queries.inspect_way(spark, SF).collect()] == [r["path"] for r in built]
