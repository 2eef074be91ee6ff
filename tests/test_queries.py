"""Every registered query of the engine on the smallest tables, against its SQL where it has one."""

import math
import os

import duckdb
import pytest

from larkspur.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{SF}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.ORACLE_SQL:
        return
    result = sql.sql(catalog.ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in places) for r in result.fetchall()), key=repr)
    assert got == want
