"""The queries SQL can express, against their SQL on the smallest tables; the others at least run on them."""

import decimal
import os

import duckdb
import pytest

from shelfscope.llm import queries as llm

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 6))
    return "NULL" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = llm.QUERIES[name](spark, SF)
    cursor = con.execute(llm.ORACLES[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == sorted(got.columns)
    expected = sorted(tuple(plain(r[named.index(c)]) for c in got.columns) for r in cursor.fetchall())
    rows = got.collect()
    assert sorted(tuple(map(plain, r)) for r in rows) == expected and rows


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in llm.QUERIES] == [f"op{i}" for i in range(1, 14)]
