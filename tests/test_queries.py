import sys

import duckdb
import pytest

import __spark_entry__ as entry
from ductwise.plans import oracle
from ductwise.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF), duck.sql(oracle.SQL[name])
    columns = sorted(got.columns)
    assert sorted(want.columns) == columns
    a = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=key)
    b = sorted((tuple(dict(zip(want.columns, r, strict=True))[c] for c in columns) for r in want.fetchall()), key=key)
    assert a == b


def test_hulls(spark):
    rows = plans.QUERIES["q48_convex_hulls"](spark, SF).collect()
    assert all(r["n"] > 3 and r["area"] > 0 for r in rows if r["n"])


def test_entry(spark):
    assert entry.entry(spark).columns == ["node", "flow", "n", "depth"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_corpus_operators(monkeypatch):
    import importlib

    monkeypatch.setitem(sys.modules, "ductwise.llm", None)
    monkeypatch.setitem(sys.modules, "ductwise.llm.queries", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry)
    assert set(alone.queries()) == set(plans.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
