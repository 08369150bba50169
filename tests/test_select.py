"""Exact quantiles against numpy, and the cut of rankings against plain Python."""

import random

import numpy as np
import pytest

from tessera.operators import rank as R
from tessera.operators.select import exact_quantile


@pytest.mark.parametrize("q", [0.0, 0.75, 0.9])
def test_quantiles(spark, q):
    rnd = random.Random(5)
    groups = {
        "hot": [rnd.gauss(0, 1) for _ in range(3000)], "tied": [rnd.choice([1.0, 1.0, 2.0]) for _ in range(400)], "one": [3.5], "two": [1.0, 9.0],
        "same": [0.1] * 7, "steep": [10.0**k for k in range(-300, 300, 7)], "far": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0], "close": [1.0 + k * 2.0**-52 for k in range(50)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None), ("nan", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r.quantile for r in exact_quantile(df, ["k"], "v", q, buckets=64, few=3).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        vs = sorted(vs)
        at = (len(vs) - 1) * q
        low, high = vs[int(at)], vs[min(int(at) + 1, len(vs) - 1)]
        if at == int(at) or low == high:
            assert got[k] == low
        elif k != "far":
            assert got[k] == pytest.approx(low + (at - int(at)) * (high - low), rel=1e-12) and low <= got[k] <= high
    assert {r.k: r.quantile for r in exact_quantile(df, ["k"], "v", q).collect()} == got
    assert exact_quantile(df.limit(0), ["k"], "v", q).collect() == []


def slow_cut(scores, quantile, drop, cap):
    ranked = sorted(scores, key=lambda x: (-x[1], x[0]))
    ranked = [x for x in ranked if x[1] >= np.quantile([s for _, s in scores], quantile)]
    out = []
    for x in ranked:
        if out and out[-1][1] > 0 and (out[-1][1] - x[1]) / out[-1][1] > drop:
            break
        out.append(x)
    return [(i, k + 1) for k, (i, _) in enumerate(out[:cap])]


def test_rank_cut(spark):
    rnd = random.Random(6)
    data = {q: [(i, round(rnd.random() ** q, 2)) for i in range(rnd.choice([1, 5, 300]))] for q in range(1, 9)}
    df = spark.createDataFrame([(q, i, s) for q, rows in data.items() for i, s in rows], "qid int, item int, score double")
    for quantile, drop, cap in ((0.75, 0.15, 20), (0.5, 0.02, 100)):
        got = {}
        for r in R.rank_cut(df, quantile, drop, cap=cap).collect():
            got.setdefault(r.qid, []).append((r.item, r.rank))
        assert {q: sorted(v, key=lambda x: x[1]) for q, v in got.items()} == {q: slow_cut(rows, quantile, drop, cap) for q, rows in data.items()}
