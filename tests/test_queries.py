"""Every query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from tallyforge.plans import QUERIES, SQL
from tallyforge.plans.bindings import TABLES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)
    if name in SQL:
        other = con.sql(SQL[name])
        assert sorted(other.columns) == cols
        assert rows == sorted((tuple(r[other.columns.index(c)] for c in cols) for r in other.fetchall()), key=str)
