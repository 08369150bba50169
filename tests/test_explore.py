"""Bounded exploration and centralities against plain Python and numpy on a small graph."""

from collections import Counter, deque
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import community as C
from tessera.operators import explore as E
from tessera.operators import graph as G
from tessera.sources import surrogate as S

PAIRS = [("Pa", "Pb"), ("Pa", "Ec"), ("Pb", "Sd"), ("Ec", "Sd"), ("Sd", "Ee"), ("Ee", "Sf"), ("Sf", "Pg"), ("Pa", "Pa"), ("Pb", "Pa"), ("Ph", "Si")]
NEAR = {n: sorted({b for a, b in PAIRS + [(b, a) for a, b in PAIRS] if a == n and b != n}) for n in {x for p in PAIRS for x in p}}
KIND = {"P": 0, "E": 1, "S": 2}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, 1.0) for a, b in PAIRS], "src string, dst string, w double")


def test_both_ways(edges):
    assert {(r.src, r.dst) for r in E.both_ways(edges).collect()} == {(a, b) for a in NEAR for b in NEAR[a]}
    assert E.both_ways(edges.limit(0)).count() == 0


@pytest.mark.parametrize("budget", [1, 2, 3, 5, 7, 50])
def test_bfs_budget_is_the_order_of_a_queue(spark, edges, budget):
    kinds = spark.createDataFrame([(n, KIND[n[0]]) for n in NEAR], "node string, kind int")
    got = [r.node for r in E.bfs_budget(edges, kinds, spark.createDataFrame([("Pa",)], "node string"), budget).orderBy("pos").collect()]
    want, queue, seen = [], deque(["Pa"]), set()
    while queue and len(want) < budget:
        u = queue.popleft()
        if u not in seen:
            seen.add(u)
            want.append(u)
            queue += sorted((v for v in NEAR[u] if v not in seen), key=lambda v: (KIND[v[0]], v))
    assert got == want


def test_bfs_degree_bounds(spark, edges):
    source = spark.createDataFrame([("Pa",)], "node string")
    rows = E.bfs_degree(edges, source, 2, 3).collect()
    assert len(rows) == 3 and all(r.truncated for r in rows) and {r.dist for r in rows} == {0, 1}
    rows = E.bfs_degree(edges, source, 2, 100).collect()
    assert {r.node for r in rows} == {"Pa", "Pb", "Ec", "Sd"} and not any(r.truncated for r in rows)


def test_eigenvector(edges):
    names = sorted(NEAR)
    a = np.array([[float(q in NEAR[p]) for q in names] for p in names])
    values, vectors = np.linalg.eigh(a)
    want = np.abs(vectors[:, -1])
    got = {r.node: r.x for r in E.eigenvector(edges, 300, 1e-9).collect()}
    assert np.allclose([got[n] for n in names], want, atol=1e-4)


def paths(a, b):
    found, queue = [], deque([[a]])
    while queue:
        p = queue.popleft()
        if found and len(p) > len(found[0]):
            break
        if p[-1] == b:
            found.append(p)
            continue
        queue += [[*p, v] for v in NEAR[p[-1]] if v not in p]
    return found


def test_betweenness(spark, edges):
    want, n = Counter(), len(NEAR)
    for a, b in permutations(NEAR, 2):
        found = paths(a, b)
        for p in found:
            for v in p[1:-1]:
                want[v] += 1 / len(found)
    got = {r.node: r.b for r in E.betweenness(edges).collect()}
    assert got.keys() == NEAR.keys() and all(got[v] == pytest.approx(want[v] / ((n - 1) * (n - 2))) for v in NEAR)
    assert E.betweenness(edges.limit(0)).count() == 0


def brandes(near):
    """node: the sum over all sources of what depends on it, in plain Python."""
    total = dict.fromkeys(near, 0.0)
    for s in near:
        dist, count, order, before = {s: 0}, {s: 1.0}, [s], {s: []}
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], count[w], before[w] = dist[v] + 1, 0.0, []
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    count[w] += count[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order[1:]):
            for v in before[w]:
                share[v] += count[v] / count[w] * (1 + share[w])
            total[w] += share[w]
    return total


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def test_betweenness_of_pivots_is_near(spark):
    import random

    rnd = random.Random(4)
    pairs = [(i, rnd.randrange(i)) for i in range(1, 150)] + [(rnd.randrange(150), rnd.randrange(150)) for _ in range(80)]
    near = neighbours(pairs)
    df = spark.createDataFrame(pairs, "src long, dst long")
    want, scale = brandes(near), 1 / ((len(near) - 1) * (len(near) - 2))
    exact = {r.node: r.b for r in E.betweenness(df).collect()}
    assert all(exact[v] == pytest.approx(want[v] * scale, abs=1e-12) for v in near)
    some = {r.node: r.b for r in E.betweenness(df, most=100).collect()}
    assert max(abs(some[v] - exact[v]) for v in near) < 0.1 and some != exact
    assert E.pivots(df.select(df.src.alias("node")).distinct(), 7).count() == 7


@pytest.mark.parametrize(("sent", "most"), [(0, 12), (4_000_000, 12), (4_000_000, 4096)])
def test_betweenness_folds_without_loss(spark, monkeypatch, sent, most):
    """Trees, a chain, a pair and a core: the values of the same pivots on the whole graph, by blocks and by tables."""
    import random

    monkeypatch.setattr(E, "_SENT", sent)
    rnd = random.Random(9)
    pairs = [(i, rnd.randrange(8)) for i in range(8, 24)] + [(i, i - 8) for i in range(24, 30)] + [(rnd.randrange(8), rnd.randrange(8)) for _ in range(16)]
    pairs += [(100, 101), (101, 102), (102, 103), (200, 201)] + [(300 + i, 300 + (i + 1) % 4) for i in range(4)] + [(300, 310), (310, 311)]
    names = sorted({x for p in pairs for x in p})
    n = len(names)
    a = np.zeros((n, n))
    for x, y in pairs:
        if x != y:
            a[names.index(x), names.index(y)] = a[names.index(y), names.index(x)] = 1
    dist, count = np.where(np.eye(n) > 0, 0.0, np.nan), np.eye(n)
    for d in range(n):
        near = np.where(dist == d, count, 0) @ a
        new = (near > 0) & np.isnan(dist)
        dist[new], count[new] = d + 1, near[new]
    df = spark.createDataFrame(pairs, "src long, dst long")
    chosen = {r.node for r in E.pivots(df.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), most).collect()}
    want = np.zeros(n)
    for s in (i for i, x in enumerate(names) if x in chosen):
        for v in (v for v in range(n) if v != s):
            through = (dist[s, v] + dist[v] == dist[s]) & (np.arange(n) != v)
            want[v] += (count[s, v] * count[v, through] / count[s, through]).sum()
    want *= n / min(n, most) / ((n - 1) * (n - 2))
    got = {r.node: r.b for r in E.betweenness(df, most=most).collect()}
    assert sorted(got) == names and np.allclose([got[x] for x in names], want, atol=1e-12)


def test_a_star_folds_into_its_middle(spark):
    """Nothing is walked from node to node where each has one way out."""
    both = E.both_ways(spark.createDataFrame([(0, i) for i in range(1, 300)], "src long, dst long"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    nodes = both.select(F.col("src").alias("node"), one.alias("size"), one.alias("p"), none.alias("q"), none.alias("x")).distinct()
    edges, left, gone = E.folded(both, nodes)
    assert edges.isEmpty() and [tuple(r) for r in left.collect()] == [(0, 300, 300, 299, 299)] and len(gone) == 1


def slow_modularity(pairs, label):
    m = sum(w for _, _, w in pairs)
    k, inner = Counter(), 0.0
    for a, b, w in pairs:
        k[label[a]] += w
        k[label[b]] += w
        inner += w * (label[a] == label[b])
    return inner / m - sum(v * v for v in k.values()) / (4 * m * m)


def partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in partitions(nodes[1:]):
        yield [[nodes[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [nodes[0], *rest[i]], *rest[i + 1 :]]


def test_communities_reach_the_best_of_all_partitions(spark):
    ring = [(a + x, a + y, 1.0) for a in (0, 3, 6) for x, y in ((0, 1), (1, 2), (0, 2))] + [(2, 3, 1.0), (5, 6, 1.0), (8, 0, 0.5), (9, 8, 2.0), (9, 9, 1.0)]
    want = max(slow_modularity(ring, {v: i for i, p in enumerate(parts) for v in p}) for parts in partitions(list(range(10))))
    df = spark.createDataFrame(ring, "src long, dst long, w double")
    label = {r.node: r.community for r in C.communities(df, "w").collect()}
    assert set(label) == set(range(10)) and all(label[c] == c for c in set(label.values()))
    found = slow_modularity(ring, label)
    assert found == pytest.approx(want)
    labels = spark.createDataFrame(list(label.items()), "node long, label long")
    assert C.modularity(C.weighted(df, "w"), labels) == pytest.approx(found)
    assert C.communities(df.limit(0)).count() == 0


def test_communities_are_no_worse_than_label_propagation(spark):
    e = G.cut(S.message_edges(spark, "/root/testdata/sf0.001").select("src", "dst"))
    graph = C.weighted(e)
    ours = C.modularity(graph, C.communities(e).withColumnRenamed("community", "label"))
    assert ours >= C.modularity(graph, E.label_propagation(e, 5))
    assert ours > 0.3


def test_nodes_of_one_link_join_their_neighbour(spark):
    """a star, a pair, a loop, and one whose loop may be worth more than its link."""
    links = [(0, 1, 1.0), (0, 2, 0.5), (0, 3, 1.0), (3, 4, 1.0), (4, 5, 0.0), (6, 7, 2.0), (8, 8, 1.0), (9, 9, 5.0), (9, 0, 1.0)]
    graph = C.weighted(spark.createDataFrame(links, "src long, dst long, w double"), "w")
    assert {r.node: r.label for r in C.hanging(graph).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9}


def test_parents_of_policies_without_pairs(spark, tmp_path):
    """equal to the SQL with sizes of any sign, missing names and repeated keys; no join of a brand's policies with each other."""
    rows = [(i % 97, 1 + i * 7 % 13 - 5, [None, "a", "b"][i % 3], ["x", None, "y", "y"][i % 4]) for i in range(150)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.sql("select id as l_partkey, timestamp '1995-01-01' as l_shipdate from range(90)").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = S.transmits(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql("with " + S.SQL.split("enterprises AS")[0] + S.SQL[S.SQL.index("transmits AS") : S.SQL.index(",\nsupports")] + " select parent, child from transmits").fetchall()
    assert want and sorted(tuple(r) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # of parts and their lines


def test_lone_nodes_count_but_do_not_move(spark):
    links = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 0.5), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (6, 6, 2.0), (5, 5, 0.5)]
    labels, found = C.local_moves(C.weighted(spark.createDataFrame(links, "src long, dst long, w double"), "w"))
    label = {r.node: r.label for r in labels.collect()}
    assert sorted(label) == list(range(7)) and label[6] == 6 and found == pytest.approx(slow_modularity(links, label))


def test_a_try_of_moves_is_one_pass(spark, monkeypatch):
    """the modularity of a try comes with the next wishes. Wishes, labels and modularity were three passes, two of them
    checkpoints, whose rows are made twice."""
    ring = [(a + x, a + y, 1.0) for a in range(0, 60, 5) for x in range(5) for y in range(x)] + [(a, (a + 6) % 60, 1.0) for a in range(0, 60, 5)]
    df = spark.createDataFrame(ring, "src long, dst long, w double")
    passes = []
    for cls, name in ((type(df), "checkpoint"), (type(df), "first"), (type(df.write), "parquet")):
        real = getattr(cls, name)
        monkeypatch.setattr(cls, name, lambda self, *a, real=real, **k: (passes.append(1), real(self, *a, **k))[1])
    labels, found = C.local_moves(C.weighted(df, "w"))
    assert len(passes) <= 8
    label = {r.node: r.label for r in labels.collect()}
    assert found == pytest.approx(slow_modularity(ring, label)) and found > 0.7


def test_label_propagation_keeps_to_components(edges):
    labels = {r.node: r.label for r in E.label_propagation(edges, 4).collect()}
    assert labels.keys() == NEAR.keys() and {labels["Ph"], labels["Si"]} <= {"Ph", "Si"}


def test_energy(spark, edges):
    covered = spark.createDataFrame([("Pa", "Ec"), ("Pa", "Ee"), ("Pa", "Ex")], "seed string, node string")
    seeds = spark.createDataFrame([("Pa",)], "node string")
    ppr = G.seeded_pagerank(edges, seeds)
    p = {r.node: r.p for r in ppr.collect()}
    row = E.energy(covered, G.bfs(edges, seeds, 5).withColumnRenamed("source", "seed"), ppr, 10).first()
    hops, mass = (1 + 3) / 2, (p["Ec"] + p["Ee"]) / 3
    assert (row.covered, row.hops, row.coverage) == (3, hops, 0.3)
    assert row.tei == pytest.approx(0.4 * 0.3 + 0.3 / hops + 0.3 * (1 - mass))
    assert sum(p.values()) == pytest.approx(1)
    assert E.energy(covered.where(F.lit(False)), covered.withColumn("dist", F.lit(1)), ppr, 10).count() == 0


def test_centrality_takes_every_edge(spark):
    """The betweenness of the query is that of the whole graph."""
    from tessera.plans.retrieval import QUERIES
    from tessera.sources import surrogate as S

    sf = "/root/testdata/sf0.001"
    near = neighbours((r.src, r.dst) for r in S.message_edges(spark, sf).select("src", "dst").collect())
    want, scale = brandes(near), 1 / ((len(near) - 1) * (len(near) - 2))
    got = {r.node: r.betweenness for r in QUERIES["graph_centrality"](spark, sf).collect()}
    assert set(want) == set(got)
    assert all(abs(b - want[node] * scale) < 2e-6 for node, b in got.items())
