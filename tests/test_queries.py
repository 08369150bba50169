"""Every query of the library with SQL gives the same rows as that SQL in DuckDB."""

import os
from datetime import date, datetime

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import rank as R

SF = "/root/testdata/sf0.001"
NAMES = [k for m in entry._modules() if m.__name__.startswith("tessera.plans.") for k in m.QUERIES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, float):
        return round(v, 9) + 0.0
    return v if v is None or isinstance(v, (str, bool, date, datetime)) else float(v)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    got = entry.queries()[name](spark, SF)
    rows = sorted(repr([plain(r[c]) for c in sorted(got.columns)]) for r in got.collect())
    assert rows
    if sql := entry.oracle_sql().get(name):
        found = con.sql(sql)
        assert sorted(found.columns) == sorted(got.columns)
        order = [found.columns.index(c) for c in sorted(found.columns)]
        want = sorted(repr([plain(r[i]) for i in order]) for r in found.fetchall())
        assert rows == want


def test_pagerank_conserves_mass(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 0.5)], "src string, dst string, w double")
    m = {(r.src, r.dst): r.w for r in G.transition(edges).collect()}
    assert m["a", "b"] == pytest.approx(2 / 3) and m["b", "a"] == 1 and m["c", "a"] == 1
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    assert sum(r.p for r in G.pagerank(nodes, G.transition(edges)).collect()) == pytest.approx(1, abs=1e-9)


def test_rank_cut_keeps_a_prefix(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([1.0, 0.95, 0.9, 0.6, 0.58])], "qid int, item int, score double")
    assert sorted(r.item for r in R.rank_cut(df, quantile=None).collect()) == [0, 1, 2]


def test_parse_capital(spark):
    df = spark.createDataFrame([("100万(元)",), ("50000元",), ("9000元",), ("--",), ("1,200万",)], "raw string")
    assert [r[0] for r in df.select(X.parse_capital(df.raw)).collect()] == [100.0, 5.0, 9000.0, None, 1200.0]


def test_entry(spark):
    assert entry.queries()["retrieve_e2p_eval"](spark, SF).count() == 25
