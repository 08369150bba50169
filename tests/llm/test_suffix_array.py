"""The difference-cover suffix array against plain sorting, and its repeats against counting."""

import random
from collections import Counter

import pytest

from tessera.llm import suffix_array as A


@pytest.mark.parametrize("text", ["", "a", "ab", "aaaa", "banana", "mississippi", "abcabcabcab"])
def test_ranks(spark, text):
    seq = spark.createDataFrame([(i, ord(c)) for i, c in enumerate(text)], "pos long, v long")
    want = {p: k + 1 for k, p in enumerate(sorted(range(len(text)), key=lambda i: text[i:]))}
    assert {r.pos: r["rank"] for r in A.ranks(seq, len(text)).collect()} == want


def test_repeats_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 16)
    rnd, width = random.Random(3), 6
    passage = "".join(rnd.choices("abé", k=20))
    rows = [(0, None), (1, ""), (2, "a" * 9), (None, passage + "x"), (4, "y" + passage[3:15]), (4, passage)]
    got = {r.pos for r in A.repeated(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), width).collect()}
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    want, base = set(), 0
    for d in data:
        want |= {base + i for i in range(len(d) - width + 1) if seen[d[i : i + width]] > 1}
        base += len(d) + 1
    assert got == want
