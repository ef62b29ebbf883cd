"""Every query with SQL, against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def cell(v):
    return "null" if v is None else str(int(v)) if isinstance(v, bool) else f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


def test_names_and_columns_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if not n.startswith(("p1_", "p2_", "p8_", "p9_", "p10_"))))
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.collect(), df.columns) == rows(cur.fetchall(), columns)


def test_core_stands_without_text_operators(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m.startswith("palimpsest.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "palimpsest.llm", None)
    left = entry.queries()
    assert "p3_found" in left and not any(n.startswith(("p1_", "p2_", "p8_", "p9_", "p10_")) for n in left)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
