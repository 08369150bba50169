"""Nearest vectors against plain numpy, over several blocks; contexts without vectors."""

import numpy as np

from tessera.operators import nearest as N


def test_blocks_give_the_same_as_one_product(spark):
    v = np.random.default_rng(5).integers(-2, 3, (60, 4)).astype(float)  # many ties
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "item long, v array<double>")
    got = sorted(map(tuple, N.top_k(df.select(df.item.alias("qid"), df.v.alias("q")), df, 3, 0.5, block=16).collect()))
    want = []
    for q in range(60):
        size = np.linalg.norm(v, axis=1) * np.linalg.norm(v[q])
        s = np.round((v @ v[q]) / np.where(size > 0, size, np.inf), 9)
        want += [(q, i, s[i]) for i in sorted(range(60), key=lambda i: (-s[i], i)) if i != q and s[i] > 0.5][:3]
    assert [x[:2] for x in got] == [x[:2] for x in sorted(want)] and np.allclose([x[2] for x in got], [x[2] for x in sorted(want)])
    assert N.top_k(df.limit(0).selectExpr("item qid", "v q"), df, 3).collect() == []


def test_context(spark):
    hits = spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2), (1, 3, 0.7, 3), (2, 1, 0.5, 1)], "qid long, item long, score double, rank int")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "item long, v array<double>")
    got = {(r.qid, r.item): r.context for r in N.struct_context(hits, vectors, 1).collect()}
    assert got == {(1, 1): 0.5, (1, 2): 0.5, (1, 3): None, (2, 1): None}
