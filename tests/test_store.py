"""Deleting documents from a stored graph gives what a build without them gives, and leaves other buckets alone."""

import os
import random

import pytest

from tessera.operators.store import DocumentGraph

NODE = "entity string, entity_type string, description string, source_id string, ts long, pos long"
EDGE = "src string, dst string, weight double, keywords string, source_id string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(9)
    chunk = lambda: f"c{rnd.randrange(30)}"
    nodes = [(f"e{rnd.randrange(60)}", rnd.choice("xyz"), f"d{rnd.randrange(20)}", chunk(), rnd.randrange(50), i) for i in range(400)]
    nodes += [("only", "x", "d", "c3", 1, 400), (None, "x", "d", "c1", 1, 401)]
    edges = [(f"e{rnd.randrange(60)}", f"e{rnd.randrange(60)}", float(rnd.randrange(5)), rnd.choice(["a, b", "b", "c,a", ""]), chunk()) for _ in range(300)]
    edges += [("e1", "e1", 1.0, "loop", "c1")]
    chunks = [(f"d{c // 3}", f"c{c}") for c in range(30)] + [("d0", "c29"), ("d1", "c5")]  # c29 is also d9's
    return nodes, edges, chunks


def tables(spark, rows):
    return spark.createDataFrame(rows[0], NODE), spark.createDataFrame(rows[1], EDGE), spark.createDataFrame(rows[2], "doc string, chunk string")


def state(store):
    return {name: sorted(map(repr, store.read(name).select(*sorted(set(store.read(name).columns) - {"bucket"})).collect())) for name in ("nodes", "edges", "node_rows", "edge_rows", "chunks")}


def test_delete_equals_a_build_without_the_documents(spark, rows, tmp_path):
    store = DocumentGraph(spark, str(tmp_path / "all"), buckets=16)
    store.build(*tables(spark, rows))
    for gone in (["d0"], ["d1", "d2", "nobody"], []):
        report = store.delete(spark.createDataFrame([(d,) for d in gone], "doc string"))
        if gone == ["d2"] or gone == ["d0"]:
            assert report["node"]["rebuilt"] > 0
    left = [(d, c) for d, c in rows[2] if d not in ("d0", "d1", "d2")]
    kept = {c for _, c in left}
    assert "c29" in kept  # another document has it
    fresh = DocumentGraph(spark, str(tmp_path / "fresh"), buckets=16)
    fresh.build(*tables(spark, ([r for r in rows[0] if r[3] in kept], [r for r in rows[1] if r[4] in kept], left)))
    assert state(store) == state(fresh)
    assert not [r for r in state(store)["nodes"] if "'only'" in r]


def test_other_buckets_are_not_touched(spark, rows, tmp_path):
    nodes, edges, _ = rows
    nodes = [*nodes, ("rare", "x", "d", "c99", 1, 999)]
    store = DocumentGraph(spark, str(tmp_path / "g"), buckets=64)
    store.build(*tables(spark, (nodes, edges, [*rows[2], ("dx", "c99")])))
    files = lambda: {p: os.listdir(tmp_path / "g" / "node_rows" / p) for p in os.listdir(tmp_path / "g" / "node_rows") if p.startswith("bucket")}
    before = files()
    report = store.delete(spark.createDataFrame([("dx",)], "doc string"))
    assert report == {"node": {"deleted": 1, "rebuilt": 0, "buckets": 1}, "edge": {"deleted": 0, "rebuilt": 0, "buckets": 0}}
    after = files()
    assert len([p for p in before if before[p] != after.get(p)]) == 1


def test_a_failed_deletion_can_be_repeated(spark, rows, tmp_path, monkeypatch):
    store = DocumentGraph(spark, str(tmp_path / "g"), buckets=8)
    store.build(*tables(spark, rows))
    twin = DocumentGraph(spark, str(tmp_path / "twin"), buckets=8)
    twin.build(*tables(spark, rows))
    docs = spark.createDataFrame([("d4",)], "doc string")
    whole = DocumentGraph._replace

    def broken(self, df, name, keys, buckets):
        if name == "edges":
            raise OSError("lost")
        whole(self, df, name, keys, buckets)

    monkeypatch.setattr(DocumentGraph, "_replace", broken)
    with pytest.raises(OSError):
        store.delete(docs)
    monkeypatch.setattr(DocumentGraph, "_replace", whole)
    store.delete(docs)
    twin.delete(docs)
    assert state(store) == state(twin)
