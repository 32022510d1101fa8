"""Every registered query against its SQL on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from checks import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 6))
    return "NULL" if value is None else str(value)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = duck.execute(ORACLES[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    expected = sorted(tuple(plain(r[named.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == expected
