"""Every query of keyed tables against DuckDB."""

import glob
import os

import duckdb
import pytest

from keyloom import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f).removesuffix('.parquet')} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", core.QUERIES)
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, SF)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    if name in core.ORACLE_SQL:
        want = duck.sql(core.ORACLE_SQL[name])
        order = [want.columns.index(c) for c in sorted(want.columns)]
        assert sorted(got.columns) == sorted(want.columns)
        assert rows == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    else:
        assert len(rows) == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 1000
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["merge_combo", "string_key_merge"])
def test_keys_behind_the_table_reach_into_it(spark, tmp_path, name):
    """As in a table of 9 million orders, of which these are some: keys upserted twice, and deleted too."""
    duck = duckdb.connect()
    duck.sql(f"""copy (select i as o_orderkey, i % 15000 as o_custkey, 'O' as o_orderstatus, i / 100 as o_totalprice, timestamp '2020-01-01' as o_orderdate, 'x' as o_orderpriority
        from (select unnest(range(8000000, 8030000)) as i union all select unnest(range(2, 39000, 300)))) to '{tmp_path}/orders.parquet' (format parquet)""")
    duck.sql(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    got, want = core.QUERIES[name](spark, str(tmp_path)), duck.sql(core.ORACLE_SQL[name])
    rows = want.fetchall()
    assert len({r[0] for r in rows}) < len(rows)
    assert sorted(map(repr, map(tuple, got.select(want.columns).collect()))) == sorted(map(repr, rows))
