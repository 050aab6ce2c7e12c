"""Every query with SQL equals it on the smallest tables; every other one runs; nothing outside llm imports it."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def rows(columns, values):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    fine = lambda v: f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(columns), sorted(tuple(fine(r[i]) for i in at) for r in values)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    got = df.collect()
    if name in SQL:
        cur = duck.execute(SQL[name])
        assert rows(df.columns, got) == rows([d[0] for d in cur.description], cur.fetchall())


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_the_core_does_without_the_text_operators():
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p3_found' not in q and 'p8_found' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for p in (ROOT / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text()


def test_entry(spark, small):
    assert __spark_entry__.entry(spark).count() > 0
