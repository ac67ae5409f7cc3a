"""All registered queries of the problems over whole tables; those with SQL against DuckDB."""

import sys
from pathlib import Path

import duckdb
import pytest

from loreweave.llm import queries as L

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import canonical  # noqa: E402

COLUMNS = {"p1_found": ["id", "line_no"], "p2_found": ["id_a", "id_b"], "p3_found": ["file_path", "project"], "p4_found": ["session_id"], "p5_found": ["id", "line_no"], "p8_found": ["doc_id", "end_pos", "start_pos"]}


@pytest.mark.parametrize("name", sorted(L.queries()))
def test_runs(spark, sf_dir, name):
    df = L.queries()[name](spark, sf_dir)
    rows = df.toPandas()
    assert len(rows) > 0
    if name in COLUMNS:
        assert sorted(df.columns) == COLUMNS[name] and not rows.duplicated().any()


@pytest.mark.parametrize("name", sorted(L.oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    assert canonical(L.queries()[name](spark, sf_dir).toPandas()) == canonical(con.sql(L.oracle_sql()[name]).df())


def test_library_stands_without_this_package():
    source = Path(L.__file__).resolve().parents[1]
    for p in source.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text()
