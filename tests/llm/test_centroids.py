import hashlib
import math
import random

import numpy as np
import pytest

from tessera.llm import centroids


def whole(v, scale):
    top, bottom = float(v).as_integer_ratio()
    return top * scale // bottom


def brute(rows, k, rounds, dim, scale, seed=1):
    """rows: (id, vector). The contract in plain Python integers."""
    kept = [(i, [whole(v, scale) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    starts = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:k]
    c = [x for _, x in starts]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        at = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            mine = [x for (_, x), a in zip(kept, at) if a == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    out = [(i, *near(x)) for i, x in kept]
    fits = lambda v: v if v < 2**63 else None
    inertia = {j: sum(d for _, d, a in out if a == j) for j in range(len(c))}
    clear = {j: all(d < 2**63 for _, d, a in out if a == j) for j in range(len(c))}
    every = fits(sum(inertia.values())) if all(clear.values()) else None
    digest = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    return sorted(repr((i, a, fits(d), fits(inertia[a]) if clear[a] else None, every, digest(a))) for i, d, a in out)


def got(df):
    return sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256)) for r in df.collect())


def table(spark, rows):
    clashing = [(i, x, 1, "d", [0.0]) for i, x in rows]
    return spark.createDataFrame(clashing, "vec_id long, embedding array<double>, cluster int, distance string, x array<double>").repartition(5)


@pytest.mark.parametrize("size", [1.0, 3e4, 1e9, 1e20, 1e300])
def test_every_magnitude_matches_whole_numbers(spark, size):
    rnd = random.Random(3)
    rows = [(i, [rnd.gauss(0, size if i % 7 == 0 else 1) for _ in range(6)]) for i in range(120)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (200, None), (201, []), (202, [1.0] * 5), (203, [1.0] * 7)]
    rows += [(204, [1.0] * 5 + [None]), (205, [1.0] * 5 + [math.nan]), (206, [math.inf] + [1.0] * 5), (207, [-math.inf] + [1.0] * 5), (208, [-0.0] * 6)]
    df = centroids.cluster(table(spark, rows), k=9, rounds=3, dim=6)
    assert got(df) == brute(rows, 9, 3, 6, 64)


def test_ties_repeats_few_and_none(spark):
    alike = [(i, [0.25, -0.5]) for i in range(40)] + [(3, [0.25, -0.5])] * 3  # all centroids alike: the smallest number takes all
    assert got(centroids.cluster(table(spark, alike), k=5, dim=2)) == brute(alike, 5, 3, 2, 64)
    few = [(1, [1.0, 2.0]), (2, [-1.0, 0.015])]
    assert got(centroids.cluster(table(spark, few), k=16, dim=2)) == brute(few, 16, 3, 2, 64)
    assert centroids.cluster(table(spark, [(1, [1.0]), (2, None)]), dim=2).count() == 0
    assert centroids.cluster(table(spark, few).limit(0), dim=2).count() == 0
    assert centroids.cluster(table(spark, [(None, [1.0, 1.0])]), dim=2).count() == 0


def test_the_product_is_used_and_exact_below_the_bound():
    rnd = np.random.default_rng(4)
    most = centroids.bound(64)
    assert 64 * (2 * most) ** 2 <= 2**52
    x, c = (rnd.integers(-most + 1, most, (50, 64)).astype(np.float64) for _ in range(2))
    x[0], c[0] = most - 1, 1 - most
    far = centroids.distances(x, c)
    assert far.dtype == np.float64
    assert [[int(v) for v in row] for row in far] == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    mixed = x.copy()
    mixed[1, 3] = 2.0**50  # one row beyond the bound: only that row goes another way
    far = centroids.distances(mixed, c)
    assert far.dtype == object
    assert int(far[1, 2]) == sum((int(a) - int(b)) ** 2 for a, b in zip(mixed[1], c[2]))


def test_query_reads_the_whole_table(spark):
    df = centroids.op11_centroids(spark, "/root/testdata/sf0.001")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert got(df) == brute(rows, 16, 3, 64, 64)
