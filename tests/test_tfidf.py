"""The k best by tf-idf against all pairs in plain Python."""

import math
import random
from collections import Counter

import pytest

from tessera.operators import tfidf as T


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    common, rare = [f"c{i}" for i in range(5)], [f"r{i}" for i in range(80)]
    out = [(i, " ".join(rnd.choices(common, k=rnd.randrange(1, 30)) + rnd.choices(rare, k=rnd.randrange(0, 6)))) for i in range(150)]
    return out + [(150, ""), (151, None), (152, "Only HERE"), (153, out[3][1]), (154, "c0"), (155, "c0")]


def brute(texts, asked, k):
    tf = {i: Counter((t or "").lower().split()) for i, t in texts}
    tf = {i: c for i, c in tf.items() if c}
    df = Counter(t for c in tf.values() for t in c)
    w = {i: {t: n * (math.log((1 + len(tf)) / (1 + df[t])) + 1) for t, n in c.items()} for i, c in tf.items()}
    w = {i: {t: x / math.sqrt(sum(y * y for y in c.values())) for t, x in c.items()} for i, c in w.items()}
    out = []
    for q in asked:
        s = [(i, round(sum(x * w[i].get(t, 0) for t, x in w.get(q, {}).items()), 9)) for i in w if i != q]
        out += [(q, i) for i, x in sorted(s, key=lambda x: (-x[1], x[0]))[:k] if x > 0]
    return sorted(out)


@pytest.mark.parametrize("first, block", [(1, 7), (20, 1000), (10**9, 1000)])
def test_same_as_all_pairs(spark, texts, first, block):
    df = spark.createDataFrame(texts, "item int, text string")
    w = T.weights(df)
    asked = list(range(0, 156, 5)) + [152, 154]
    queries = w.where(w.item.isin(asked)).selectExpr("item qid", "term", "w v")
    got = sorted((r.qid, r.item) for r in T.search(queries, w, 4, first, block).collect())
    assert got == brute(texts, asked, 4)


def test_empty(spark):
    df = spark.createDataFrame([], "item int, text string")
    w = T.weights(df)
    assert w.count() == 0 and T.search(w.selectExpr("item qid", "term", "w v"), w, 3).count() == 0
