"""The driver's contract on the smallest tables, where they are at hand."""

import os

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def test_entry(spark):
    assert entry.entry(spark).columns == ["name", "file", "n_calls"]


@pytest.mark.parametrize("name", ["p1_found", "p3_found", "p4_found", "p5_found", "hotspots", "dead_symbols", "call_cascade", "backlinks", "context_query", "find_context"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(ROOT):
        con.sql(f"create view {f.split('.')[0]} as select * from '{ROOT}/{f}'")
    df = entry.queries()[name](spark, ROOT)
    want = con.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(str(tuple(r[c] for c in order)) for r in df.collect()) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
