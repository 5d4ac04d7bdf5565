"""Every query against its SQL twin in DuckDB, and the kinds of all others."""

import os

import duckdb
import pytest

from wavelake.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SF).toPandas()
    assert len(ours)
    if name in SQL:
        theirs = duck.execute(SQL[name]).df()
        cols = sorted(ours.columns)
        assert cols == sorted(theirs.columns)
        a, b = (d[cols].sort_values(cols, ignore_index=True) for d in (ours, theirs))
        assert len(a) == len(b)
        for c in cols:
            assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
