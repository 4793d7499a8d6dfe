"""The driver's contract: every query with SQL gives the same rows in DuckDB."""

from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = ("ingest", "chunks", "parents", "queries", "scored", "documents", "embeddings", "eval_items", "source_weights")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not DATA.exists():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, str(DATA))
    rel = duck.sql(entry.oracle_sql()[name])
    columns, kinds = rel.columns, dict(zip(rel.columns, map(str, rel.types)))
    assert sorted(df.columns) == sorted(columns)
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted(map(tuple, rel.fetchall()), key=repr)


def test_flagship(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    assert entry.entry(spark).count() > 0
