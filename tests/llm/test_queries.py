"""The registered queries that SQL can express, against DuckDB; and that all run on a whole table."""

import duckdb
import pytest

from keyloom.llm import queries

from .conftest import SF


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(spark, name):
    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    rows = sorted(repr(tuple(r[c] for c in sorted(got.columns))) for r in got.collect())
    assert rows == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall()) and rows


def test_every_operator_has_a_query():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
