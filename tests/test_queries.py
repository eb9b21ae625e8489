"""Every query with SQL against DuckDB, on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

from tessera.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return "NULL"
    if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)):
        return f"{float(v):.6f}"
    return str(v)


def normal(df):
    df = df[sorted(df.columns)].map(cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, duck, name):
    own, sql = queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.SQL[name]).fetchdf()
    assert sorted(own.columns) == sorted(sql.columns)
    pd.testing.assert_frame_equal(normal(own), normal(sql), check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).columns


def test_entry_has_the_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
