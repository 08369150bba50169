import hashlib
import random
from collections import Counter

import pytest

from tessera.llm import repeats


def slow(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + window] for d in texts for i in range(len(d) - window + 1))
    out = []
    for (ident, _), d in zip(rows, texts):
        gone = bytearray(len(d))
        for i in range(len(d) - window + 1):
            if seen[d[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        left = bytes(b for b, g in zip(d, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((repr(ident), len(d), sum(gone), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def rows(window, seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choices("abé ", k=n))
    passage = word(window * 3)
    out = [(0, None), (1, ""), (2, "short"), (3, "a" * (window * 2)), (4, "a" * window), (5, "b" * window), (6, "ab" * window)]
    for i in range(7, 40):
        a, b = sorted(rnd.sample(range(len(passage)), 2))
        text = word(rnd.randint(0, window)) + passage[a:b] + word(rnd.randint(0, window))
        if i % 3 == 0:
            text += word(5) + passage[: window + rnd.randint(-2, 2)]
        if i % 5 == 0 and text:
            at = rnd.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        out.append((i, text))
    return [*out, (40, out[20][1]), (41, out[21][1]), (41, out[21][1]), (None, out[22][1]), (None, word(window * 2))]


@pytest.mark.parametrize(("window", "k", "most"), [(40, 8, 16384), (40, 8, 2), (33, 16, 3), (400, 32, 16384)])
def test_matches_brute_force(spark, window, k, most):
    data = rows(window, window + most)
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in data], "doc_id long, text string, h long, data binary").repartition(5)
    got = repeats.removed(docs, window=window, k=k, most_in_task=most).collect()
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == slow(data, window)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_every_window_has_one_piece(monkeypatch):
    rnd = random.Random(1)
    monkeypatch.setattr(repeats, "_BLOCK", 64)
    for text in ("ab" * 200, "a" * 300, "".join(rnd.choices("ab", k=500)), "x" * 40, "x" * 39):
        got = [i for _, a, b, p in repeats.pieces(text.encode(), 40, 8) for i in range(a, b + 1) if a <= b <= p <= a + 32]
        assert got == list(range(len(text) - 39))


def test_empty_table(spark):
    assert repeats.removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
