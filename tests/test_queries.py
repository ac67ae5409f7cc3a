"""Every registered core query against its SQL on DuckDB, over whole tables."""

from pathlib import Path

import duckdb
import pytest

from compare import canonical
from loreweave.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) <= {"code_facts", "called_symbols"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    if Path("/root/testdata/sf0.001").exists():
        assert e.entry(spark).columns == ["doc_id", "source", "score"] and e.entry(spark).count() == 10
    assert set(registry.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
