"""Every registered query against its SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got
        return
    cur = con.execute(SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == rows_of(cols, cur.fetchall())


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
