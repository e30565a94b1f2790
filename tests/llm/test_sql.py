from __future__ import annotations

import os

import duckdb
import pytest

from shoebox.llm import queries
from tests.test_queries import plain


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    got, want = queries.QUERIES[name](spark, small).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
