"""Every registered query with a DuckDB twin agrees with it on sf0.001 (rows, columns, values)."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from tessera.plans.fixtures import TABLES
from tools.oracle_check import digest

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = duck.execute(SQL[name])
    cols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows) == digest(cols, drows)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"query_id", "rank", "doc_id", "score"} <= set(df.columns)
