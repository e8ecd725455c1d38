"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from axonloom.plans import inputs, measures, responses, signals, units  # noqa: F401
from axonloom.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return None
    x = x.item() if hasattr(x, "item") else x
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x if isinstance(x, bool) else str(x)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    x, y = rows(got), rows(want)
    assert len(x) == len(y)
    assert all(len(p) == len(q) and all(map(same, p, q)) for p, q in zip(x, y))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert df.count() >= 0 and df.columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(ORACLE_SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
