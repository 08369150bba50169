"""Forward push against the power iteration on the whole matrix."""

import random

import numpy as np
import pytest

from tessera.operators import graph as G


def exact(pairs, nodes, seed, restart=0.15):
    at = {v: i for i, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b in pairs:
        m[at[a], at[b]] += 1
    for i in range(len(nodes)):
        m[i] = m[i] / m[i].sum() if m[i].sum() else np.eye(len(nodes))[i]
    start = np.zeros(len(nodes))
    start[at[seed]] = 1
    p = start.copy()
    for _ in range(500):
        p = restart * start + (1 - restart) * p @ m
    return dict(zip(nodes, p))


def test_within_what_is_left(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(200)] + [(0, 1), (0, 1), (5, 77), (60, 60)]
    df = spark.createDataFrame(pairs, "src long, dst long")
    nodes = sorted({v for p in pairs for v in p} | {99})
    seeds = [0, 5, 7, 99]
    rows = {}
    for least in (1e-2, 1e-4):
        p, left = G.push_pagerank(df, spark.createDataFrame([(s,) for s in [*seeds, 0, None]], "node long"), least=least)
        p, left = p.collect(), {r.seed: r.left for r in left.collect()}
        assert set(left) == set(seeds)
        for seed in seeds:
            want, found = exact(pairs, nodes, seed), {r.node: r.p for r in p if r.seed == seed}
            assert sum(found.values()) + left[seed] == pytest.approx(1)
            assert sum(want[v] - found.get(v, 0.0) for v in nodes) == pytest.approx(left[seed], abs=1e-9)
            assert all(found.get(v, 0.0) <= want[v] + 1e-9 for v in nodes)
        assert left[99] == 0
        rows[least] = len(p), max(left.values())
    assert rows[1e-2][0] < rows[1e-4][0] and rows[1e-4][1] < 0.05


def test_rows_do_not_grow_with_the_graph(spark):
    counts = []
    for n in (200, 2000):
        ring = spark.range(n).selectExpr("id src", f"(id + 1) % {n} dst")
        p, left = G.push_pagerank(ring, spark.createDataFrame([(3,)], "node long"), least=0.05)
        counts.append(p.count())
        assert left.first().left < 0.06
    assert counts[0] == counts[1] < 30
