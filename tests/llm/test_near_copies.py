import random

import numpy as np

from tessera.llm import near_copies, simhash


def slow_set(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} or ({" ".join(words)} if words else set())


def slow_roots(rows, similarity=0.8):
    sets, root = {i: slow_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in root}


def planted(seed=3, groups=120):
    """Texts of 40 to 200 words with copies that have a few words changed: similarities from 0.5 to 1."""
    rnd, out = random.Random(seed), []
    vocab = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(3000)]
    for _ in range(groups):
        base = rnd.choices(vocab, k=rnd.randint(40, 200))
        out.append(" ".join(base))
        for _ in range(4):
            words = list(base)
            for _ in range(rnd.randint(1, max(1, len(base) // 40))):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            out.append(" ".join(words))
    rnd.shuffle(out)
    return list(enumerate(out))


def test_keep_first_is_jaccard(spark):
    rows = planted()
    roots = slow_roots(rows)
    assert 200 < sum(i != r for i, r in roots.items()) < 480
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), words=5)
    assert {r.doc_id for r in kept.collect()} == {i for i, r in roots.items() if i == r}


def test_one_changed_word_in_fifty(spark):
    words = [f"w{i}" for i in range(50)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:25], "zz", *words[26:]])), (3, "a b"), (4, "A  B"), (5, "a c"), (None, "a b")]
    assert 0.8 <= len(slow_set(rows[0][1]) & slow_set(rows[1][1])) / len(slow_set(rows[0][1]) | slow_set(rows[1][1])) < 0.81
    kept = near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(repr(r.doc_id) for r in kept.collect()) == ["1", "3", "5", "None"]


def test_chains_that_no_star_joins(spark):
    """A text drifts word by word: neighbours are links, the ends of the chain are not."""
    rnd = random.Random(8)
    words, rows = [f"w{i}" for i in range(150)], []
    for i in range(40):
        rows.append((i, " ".join(words)))
        for _ in range(2):
            words[rnd.randrange(150)] = f"x{i}{rnd.random()}"
    assert set(slow_roots(rows).values()) == {0}
    assert [r.doc_id for r in near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_forest_is_all_links():
    rnd = random.Random(2)
    for most in (3, 9):
        sets = [np.unique(np.array(rnd.choices(range(12), k=rnd.randint(0, most)), np.uint64)) for _ in range(60)]
        comp = np.array([rnd.randrange(50) for _ in sets])
        near = {(i, j) for i in range(60) for j in range(i) if comp[i] != comp[j] and near_copies.alike(sets[i], sets[j], 0.8)}

        def roots(links):
            root = list(range(60))
            for _ in range(60):
                for i, j in links:
                    root[i] = root[j] = min(root[i], root[j])
            return root

        found = list(zip(*near_copies.forest(sets, comp, 0.8)))
        assert near and {(max(p), min(p)) for p in found} <= near and roots(found) == roots(near)
    assert near_copies.forest([np.empty(0, np.uint64)] * 2, np.array([1, 2]), 0.8) == ([0], [1])


def test_a_family_about_the_threshold(spark, monkeypatch):
    """Large bands go by blocks; the classes are those of all pairs, however small the blocks are."""
    rnd, base = random.Random(4), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rnd.choice((1, 2, 2, 3, 3, 3))):
            words[rnd.randrange(120)] = f"x{i}{rnd.random()}"
        rows.append((i, " ".join(words)))
    roots = slow_roots(rows)
    expected = {i for i, r in roots.items() if i == r}
    assert 5 < len(expected) < 155
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for few, block, total in ((32, 512, 1 << 18), (4, 16, 1 << 18), (4, 512, 1000), (1 << 30, 512, 1 << 18)):
        for name, value in (("_FEW", few), ("_BLOCK", block), ("_SHINGLES", total)):
            monkeypatch.setattr(near_copies, name, value)
        assert {r.doc_id for r in near_copies.keep_first(docs).collect()} == expected


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(3, None, 1, 1, "x"), (4, "", 2, 2, None), (5, " \n", 3, 3, "z"), (6, "a b c d e f", 0, 0, ""), (6, "a b c d e f", 0, 0, ""), (7, "A b c d e f", 1, 1, "k"), (None, None, 9, 9, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, key long, __a string")
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(repr(r) for r in (rows[0], rows[3], rows[4], rows[6]))
    assert near_copies.keep_first(docs.limit(0)).count() == 0
