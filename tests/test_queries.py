"""Every registered query of the library that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def told(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and np.isnan(v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return repr(round(float(v), 6) + 0.0)
    return str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(map(str, map(told, r))) for r in df[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for file in os.listdir(SF):
        c.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    assert not [c for c, kind in df.dtypes if kind.startswith("decimal")]
    assert rows(df.toPandas()) == rows(duck.sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
