from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from shoebox import queries


@pytest.fixture(scope="module")
def tables(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return con


def plain(df):
    cell = lambda v: "null" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(map(tuple, df[sorted(df.columns)].astype(object).map(cell).to_numpy().tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, small, tables, name):
    got, want = queries.QUERIES[name](spark, small).toPandas(), tables.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_queries_give_rows(spark, small):
    for name in sorted(set(queries.QUERIES) - set(queries.ORACLE)):
        assert queries.QUERIES[name](spark, small).count() > 0


def test_a_catalogue_is_never_sent_to_the_driver(spark, tiny):
    plan = queries.QUERIES["older_catalogue"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
