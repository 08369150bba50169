"""Each retrieval mode on a graph that can be followed by hand."""

import pytest

from tessera.operators import retrieve as T


@pytest.fixture(scope="module")
def hits(spark):
    nodes = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "qid long, item string, pos int")
    relations = spark.createDataFrame([(1, "b", "c", 1), (1, "c", "d", 2)], "qid long, src string, dst string, pos int")
    chunks = spark.createDataFrame([(1, "k9", 1), (1, "k2", 2)], "qid long, item string, pos int")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 5.0), ("c", "e", 1.0)], "src string, dst string, w double")
    held = spark.createDataFrame([("a", "k1"), ("b", "k1"), ("a", "k2"), ("c", "k3"), ("b|c", "k2"), ("c|d", "k4")], "item string, chunk string")
    return nodes, relations, chunks, edges, held


def found(hits, mode, most=40):
    out = {}
    for r in T.search(mode, *hits, most=most).orderBy("qid", "kind", "pos").collect():
        out.setdefault((r.qid, r.kind), []).append(r.item)
    return out


def test_local(hits):
    got = found(hits, "local")
    assert got[1, "entity"] == ["a", "b"] and got[1, "relation"] == ["b|c", "a|b"] and got[1, "chunk"] == ["k1", "k2"]
    assert got[2, "relation"] == ["b|c", "c|d", "c|e"]  # 2 + 3 edges, then 3 + 1 by weight


def test_global(hits):
    got = found(hits, "global")
    assert got == {(1, "entity"): ["b", "c", "d"], (1, "relation"): ["b|c", "c|d"], (1, "chunk"): ["k2", "k4"]}


def test_hybrid_and_mix_interleave(hits):
    got = found(hits, "hybrid")
    assert got[1, "entity"] == ["a", "b", "c", "d"] and got[1, "relation"] == ["b|c", "a|b", "c|d"] and got[1, "chunk"] == ["k1", "k2", "k4"]
    assert found(hits, "mix")[1, "chunk"] == ["k1", "k2", "k9", "k4"]
    assert found(hits, "mix", most=1)[1, "entity"] == ["a"]


def test_naive_and_bypass(hits):
    assert found(hits, "naive") == {(1, "chunk"): ["k9", "k2"]}
    assert found(hits, "bypass") == {}
    with pytest.raises(ValueError):
        T.search("other", *hits)


def test_nothing_found(hits):
    nodes, relations, chunks, edges, held = hits
    assert T.search("mix", nodes.limit(0), relations.limit(0), chunks.limit(0), edges.limit(0), held.limit(0)).count() == 0
