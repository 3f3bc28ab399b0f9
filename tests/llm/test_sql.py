"""Operators that SQL can express, against DuckDB at the smallest scale."""

import pytest

from commitlens.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), c.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = c.sql(f"select {', '.join(columns)} from want").fetchall()
    assert sorted(map(repr, rows)) == sorted(repr(tuple(r)) for r in got.select(*columns).collect()) and rows
