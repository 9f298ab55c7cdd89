"""Every registered query outside the llm subpackage against its SQL."""

import os
from collections import Counter

import duckdb
import pytest

from tidewater.plans import catalog


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(sf):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())
