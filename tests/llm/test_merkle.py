import hashlib
import random
import zlib

import pytest

from tessera.llm import merkle


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def lowered(text):
    return text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(level, fanout):
    """level: [(hash, [members])]; members: the leaves below. Appends siblings to each leaf's path; returns the root."""
    while len(level) > 1:
        above = []
        for low in range(0, len(level), fanout):
            run = level[low : low + fanout]
            for at, (_, members) in enumerate(run):
                for leaf in members:
                    leaf["path"].append(("".join(h for h, _ in run[:at]), "".join(h for h, _ in run[at + 1 :])))
            above.append((digest("".join(h for h, _ in run)), [m for _, members in run for m in members]))
        level = above
    return level[0]


def brute(rows, fanout):
    """rows: (doc_id, source, lang, n_chars, text)"""
    trees = {}
    for r in rows:
        leaf = digest("".join(map(field, r)))
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        new = digest("".join(map(field, (*r[:4], lowered(r[4]))))) if tampered else leaf
        trees.setdefault(r[1], []).append({"id": r[0], "leaf": leaf, "new": new, "path": []})
    tops = []
    for source in sorted(trees, key=lambda s: (s is not None, (s or "").encode())):
        mine = sorted(trees[source], key=lambda x: (x["id"] is not None, x["id"] or 0, x["leaf"]))
        top = climb([(x["leaf"], [x]) for x in mine], fanout)
        for x in mine:
            x["subroot"] = top[0]
        tops.append(top)
    root, every = climb(tops, fanout)
    out = []
    for x in every:
        h = x["new"]
        for left, right in x["path"]:
            h = digest(left + h + right)
        out.append((x["id"], x["leaf"], x["subroot"], root, digest("".join(a + b for a, b in x["path"])), h, h == root))
    return sorted(map(repr, out))


def got(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, hash string, at long, n int, path string, kids int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "t", "h", 1, 2, "p", 3) for r in rows], SCHEMA).repartition(6)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    sources = ["a", "B", "é", "\U0001f600", "￿", "", None, "-"]
    texts = [None, "", "plain", "Some UPPER", "ÄÖ kept, AZ not", "x" * 40, "Long " * 20_000]
    out = [(i, "hot" if i % 3 == 0 else rnd.choice(sources), rnd.choice(["en", None]), rnd.choice([None, i, -5]), rnd.choice(texts)) for i in range(240)]
    out += [(7, "a", "en", 1, "Twice")] * 3 + [(7, "a", "en", 1, "TWICE")] + [(None, "a", None, None, None)] * 2 + [(None, None, None, None, "N")]
    return [*out, (-(2**63), "alone", "en", 0, "A"), (2**63 - 1, "a", "en", 0, "B")]


@pytest.mark.parametrize("fanout", [2, 16])
def test_matches_brute_force(spark, rows, fanout):
    df = merkle.manifest(table(spark, rows), fanout=fanout)
    found = got(df)
    assert found == brute(rows, fanout)
    wrong = sum(x.endswith("False)") for x in found)
    assert 0 < wrong < len(rows) // 3


def test_one_source_one_row_and_none(spark):
    one = [(5, "s", "en", 3, "ABC")]
    assert got(merkle.manifest(table(spark, one))) == brute(one, 16)
    same = [(i, "s", "en", 3, "ABC") for i in range(300)]
    assert got(merkle.manifest(table(spark, same))) == brute(same, 16)
    assert merkle.manifest(table(spark, one).limit(0)).count() == 0


def test_a_large_tree_is_numbered_in_ranges(spark):
    df = spark.range(0, 5000, 1, 8).selectExpr("'t' as tree", "pmod(hash(id), 700) as k", "id")
    found = merkle.indexed(df, "tree", ["k"], "ranges").collect()
    assert sorted(r.at for r in found) == list(range(5000)) and {r.n for r in found} == {5000}
    assert [r.k for r in sorted(found, key=lambda r: r.at)] == sorted(r.k for r in found)
