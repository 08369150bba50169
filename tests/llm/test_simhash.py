import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash

SCHEMA = "doc_id long, text string, fp string, node long"


def slow_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs, bits=4):
    """pairs: (id, fp)."""
    root = {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(pairs):
        for j, b in pairs[:n]:
            if (a ^ b).bit_count() <= bits:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in pairs}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    vocab = ["".join(rnd.choices("abcdeé", k=4)) for _ in range(60)]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one two three"), (5, "ONE two\nthree")]
    base = rnd.choices(vocab, k=400)
    for i in range(6, 60):
        words = list(base) if i % 2 else rnd.choices(vocab, k=rnd.randint(1, 300))
        for _ in range(i % 7):
            words[rnd.randrange(len(words))] = "zz"
        out.append((i, " ".join(words)))
    return [*out, (60, out[20][1]), (60, out[20][1]), (None, out[20][1]), (None, "nothing like it")]


def test_matches_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.simhash_groups(docs).collect()
    assert len(got) == len(rows)
    want = {i: slow_fingerprint(t) for i, t in rows if i is not None}
    parts = slow_components(sorted(want.items()))
    assert max(sum(v == x for v in parts.values()) for x in parts.values()) > 5
    for r in got:
        if r.doc_id is not None:
            assert r.fingerprint == f"{want[r.doc_id]:016x}"
            assert r.component_id == parts[r.doc_id]
    assert sorted((r.component_id is None) for r in got if r.doc_id is None) == [False, True]


@pytest.mark.parametrize("bits", [0, 3, 4, 5])
def test_every_link_at_every_distance_is_found(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base.tolist():
        for d in range(1, 8):
            fps.add(x ^ sum(1 << int(b) for b in rng.choice(64, d, replace=False)))
    fps = sorted(fps)
    frame = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)), i) for i, x in enumerate(fps)], "fp long, node long")
    found = simhash.find_links(frame, bits).collect()
    from tessera.llm.common import components

    roots = {r.node: r.root for r in components(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long")).collect()}
    assert {i: roots.get(i, i) for i in range(len(fps))} == slow_components(list(enumerate(fps)), bits)


def test_dense_ball_is_one_component_without_all_pairs(spark):
    fps = [0, *[1 << b for b in range(64)], *[1 << b | 1 << c for b in range(64) for c in range(b)]]
    fps = [int(np.uint64(x).astype(np.int64)) for x in fps]
    frame = spark.createDataFrame(list(zip(fps, range(len(fps)))), "fp long, node long")
    links = simhash.find_links(frame, 4)
    assert links.count() < 200 * len(fps)
    from tessera.llm.common import components

    roots = components(links).collect()
    assert len(roots) == len(fps) - 1 and {r.root for r in roots} == {0}


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e", 5, 6), (2, "a b c d e", 7, 8)], SCHEMA.replace("fp string", "fp long"))
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]
