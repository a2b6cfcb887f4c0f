"""Every registered query with an SQL oracle, against DuckDB at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    got, gcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLES[name])
    exp, ecols = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert gcols == ecols
    assert got == exp


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "net_revenue_usd" in df.columns


def test_every_query_has_a_builder():
    assert set(ORACLES) <= set(E.queries())
