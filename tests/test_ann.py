"""The inverted-file index against the exact search: recall, what is read, and that all lists give the exact answer."""

import numpy as np
import pytest

from tessera.operators import ann as A
from tessera.operators import nearest as N


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(8)
    middles = rnd.normal(size=(40, 16))
    v = [(int(i), (middles[i % 40] + rnd.normal(0, 0.25, 16)).tolist()) for i in range(2000)]
    v += [(2000, [0.0] * 16), (2001, None), (None, [1.0] * 16), (2002, v[5][1]), (2003, v[5][1])]
    return spark.createDataFrame(v, "item long, v array<double>")


def test_recall_rises_and_rows_read_with_the_probes(spark, rows, tmp_path):
    index = A.build(rows, str(tmp_path / "index"), 40, sample=800)
    assert index.lists.agg({"n": "sum"}).first()[0] == 2003 == index.postings.count()
    asked = rows.where("item % 20 = 0 and item < 2000").selectExpr("item qid", "v q")
    exact = N.top_k(asked, rows, 10)
    found, read = [], []
    for probes in (1, 4, 40):
        got = A.search(index, asked, 10, probes, block=64)
        row = A.recall(got, exact).first()
        assert row.queries == 100
        found.append(row.recall)
        read.append(index.rows_read(asked.where("qid = 0"), probes))
    assert found[0] <= found[1] and found[1] >= 0.9 and found[2] == 1.0
    assert read[0] < 2003 / 8 and read[0] < read[1] < read[2] == 2003
    probes, share = A.probes_for(index, asked, rows, 10, 0.9, 50)
    assert probes <= 6 and share >= 0.9
    assert A.recall(A.search(index, asked, 10, probes), exact).first().recall >= 0.85
    same = lambda df: sorted(map(tuple, df.collect()))
    assert same(A.search(A.load(spark, str(tmp_path / "index")), asked, 10, 40)) == same(exact)


def test_unprobed_lists_are_not_read(spark, rows, tmp_path):
    index = A.build(rows, str(tmp_path / "index"), 40)
    one = rows.where("item = 0").selectExpr("item qid", "v q")
    df = A.search(index, one, 5, 1)
    assert len(df.collect()) == 5
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()


def test_empty_and_tiny_tables(spark, rows, tmp_path):
    none = A.build(rows.limit(0), str(tmp_path / "none"), 4)
    asked = rows.where("item < 3").selectExpr("item qid", "v q")
    assert A.search(none, asked, 3, 2).collect() == []
    few = A.build(rows.where("item < 2"), str(tmp_path / "few"), 16)
    assert sorted((r.qid, r.item) for r in A.search(few, asked.where("qid < 2"), 3, 16).collect()) == [(0, 1), (1, 0)]
    assert A.search(few, asked.limit(0), 3, 2).collect() == []


@pytest.mark.parametrize("measure", ["dot", "l1"])
def test_other_measures_and_items_with_names(spark, measure):
    v = np.random.default_rng(6).integers(-2, 3, (50, 3)).astype(float)
    df = spark.createDataFrame([(f"n{i:02}", i, x.tolist()) for i, x in enumerate(v)], "item string, qid long, v array<double>")
    asked = df.where("qid < 20").selectExpr("qid", "v q")
    got = {}
    for r in N.top_k(asked, df, 4, block=16, measure=measure, own=True).collect():
        got.setdefault(r.qid, []).append((r.item, r.score))
    score = (lambda a, b: float(a @ b)) if measure == "dot" else (lambda a, b: -float(np.abs(a - b).sum()))
    for q in range(20):
        want = sorted(((f"n{i:02}", score(v[q], v[i])) for i in range(50)), key=lambda x: (-x[1], x[0]))[:4]
        assert sorted(got[q], key=lambda x: (-x[1], x[0])) == want
    with pytest.raises(ValueError):
        N.top_k(asked, df, 4, measure="other")
