import random
import re

import numpy as np
import pytest

from tessera.llm import jaccard_join as join


def slow_set(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({" ".join(words)} if words else set())


def brute(rows, percent=85):
    """rows: (id, text), each row a document: (id, shingles, least id of its component)."""
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    linked = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
                linked += 1
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(repr((k, len(s), least.get(find(i)))) for i, ((k, _), s) in enumerate(zip(rows, sets))), linked


def got(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


def table(spark, rows):
    schema = "doc_id long, text string, node long, key long, size int, tokens string, mark int, digest string, n int"
    return spark.createDataFrame([(*r, 1, 2, 3, "t", 4, "d", 5) for r in rows], schema).repartition(5)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**9)}"
    return words


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    vocab = ["".join(rnd.choices("abcdefgé", k=5)) for _ in range(300)]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "ONE"), (5, "one two three"), (6, "one two  three"), (7, "one two three four")]
    passage = rnd.choices(vocab, k=60)
    for family in range(6):
        base = rnd.choices(vocab, k=rnd.choice([30, 90, 300, 900]))
        for _ in range(14):  # at, just over and just under the similarity
            out.append((len(out), " ".join(edited(rnd, base, rnd.randrange(0, 1 + len(base) // 25)))))
    for _ in range(60):  # a passage that unlike documents share
        out.append((len(out), " ".join(rnd.choices(vocab, k=rnd.randrange(40, 200)) + passage)))
    out += [(len(out) + i, "la " * n) for i, n in enumerate((3, 4, 5, 50, 50_000))]  # long texts with one shingle
    long = rnd.choices(vocab, k=30_000)
    out += [(len(out), " ".join(long)), (len(out) + 1, " ".join(edited(rnd, long, 300))), (len(out) + 2, " ".join(edited(rnd, long, 3000)))]
    return out + [(20, out[21][1]), (20, out[21][1]), (20, "quite another text here"), (None, out[30][1]), (None, "all alone in this table"), (None, None), (None, out[40][1].upper())]


def test_matches_all_pairs(spark, rows):
    want, linked = brute(rows)
    assert linked > 100
    assert got(join.jaccard_groups(table(spark, rows))) == want


@pytest.mark.parametrize("block, star", [(4, 2), (16, 1)])
def test_small_blocks_and_other_similarities(spark, rows, monkeypatch, block, star):
    monkeypatch.setattr(join, "_BLOCK", block)
    monkeypatch.setattr(join, "_STAR", star)
    some = rows[:120]
    for percent in (70, 100):
        assert got(join.jaccard_groups(table(spark, some), percent=percent)) == brute(some, percent)[0]


def test_empty_tables_and_nothing_alike(spark):
    some = [(1, "a b c d e"), (2, "f g h i j"), (3, None)]
    assert got(join.jaccard_groups(table(spark, some))) == brute(some)[0]
    assert join.jaccard_groups(table(spark, some).limit(0)).count() == 0


def test_linked_sets_share_a_prefix_token_under_each_order():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 6, 7, 8, 40, 333):
        base = np.unique(rnd.integers(0, 1 << 63, n, np.uint64))
        for _ in range(40):
            take = base[rnd.random(len(base)) < 0.93]
            other = np.unique(np.concatenate((take, rnd.integers(0, 1 << 63, rnd.integers(0, 3), np.uint64))))
            if not len(other) or 100 * len(np.intersect1d(base, other)) < 85 * len(np.union1d(base, other)):
                continue
            for order in range(join.ORDERS):
                sides = []
                for s in (base, other):
                    room, mine, rest = join.ordered(s, order, 85)
                    sides.append({*np.sort(mine)[: max(0, len(mine) + room)].tolist(), *rest.tolist()})  # any order of the class
                assert sides[0] & sides[1]


def test_blocks_find_what_all_pairs_find():
    rnd = random.Random(3)
    base = np.arange(1000, dtype=np.uint64)
    sets = [np.array(sorted(rnd.sample(range(1000), rnd.randrange(850, 1000))), np.uint64) for _ in range(60)]
    sets[0] = base
    prefixes = [[s.view(np.int64)[: len(s) - 0] for s in sets]]
    a, b = join.links(sets, prefixes, np.arange(60), 85)
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in zip(a, b):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)
        root[find(i)] = find(j)
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert find(i) == find(j)
