"""Every registered query against its DuckDB oracle (the driver's gate), at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from mnemo.sources.tables import TABLES, table_path
from tools.check_oracle import rows_of

from .conftest import SF_SMALL

QUERIES = entry.queries()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF_SMALL, t)}')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["request_id", "rank", "doc_id"]
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(SQL[name])
    drows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(srows) == len(drows)
    assert rows_of(df.columns, srows) == rows_of(rel.columns, drows)


def test_every_query_has_an_oracle():
    from mnemo.plans import registry
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL) and set(SQL) <= set(QUERIES)
