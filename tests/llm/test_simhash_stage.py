"""The pipeline's near-duplicate stage goes through SimHash anchors."""

import random

from tessera.llm import near_copies, simhash


def test_links_come_from_fingerprints(spark, monkeypatch):
    rnd = random.Random(3)
    texts = []
    for _ in range(20):
        words = [str(rnd.randrange(10**6)) for _ in range(400)]
        texts += [" ".join(words), " ".join(words[:399] + ["other"])]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(100, "a b"), (101, "c d"), (102, ""), (103, None)], "doc_id long, text string")
    whole = {r.doc_id for r in near_copies.keep_first(docs).collect()}
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == whole == {*range(0, 40, 2), 100, 101, 102}
    sets = [simhash.fingerprint(t, 5) for t in texts]
    near = {2 * i + 1 for i in range(20) if (sets[2 * i] ^ sets[2 * i + 1]).bit_count() <= 4}
    assert len(near) > 5
    monkeypatch.setattr(near_copies, "find_links", lambda rows, words, similarity, known: known)  # without min-hashes
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == {*range(40), 100, 101, 102} - near


def test_equal_fingerprints_are_verified(spark, monkeypatch):
    monkeypatch.setattr(simhash, "fingerprint", lambda *_: 7)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "u v w x y z"), (3, "a b c d e f")], "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == {1, 2}
