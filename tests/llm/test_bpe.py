import hashlib
import random

import numpy as np
import pytest
import tiktoken

from tessera.llm import bpe


@pytest.fixture(scope="module")
def tok():
    return bpe.tokenizer(bpe.default_ranks(), bpe.default_pattern())


@pytest.fixture(scope="module")
def known(tok):
    return tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=tok.ranks, special_tokens={})


def texts():
    rnd = random.Random(3)
    out = ["", " ", "Hello world", "don't  stop\n\n now", "é" * 50, "a" * 3000, "ab" * 700, "日本語テキスト", "\x00\x01", "x" + " " * 500 + "y", "<|endoftext|>", "🙂🙃" * 20]
    out += ["".join(rnd.choices("abcdefgh ieou,.'ñß\n12", k=rnd.randint(1, 600))) for _ in range(150)]
    return out + ["".join(rnd.choices("aeiounrst", k=rnd.randint(200, 900))) for _ in range(20)]


def test_same_ids_as_the_library(tok, known):
    got = [[] for _ in texts()]
    for k, ids in tok.encode_blocks(texts()):
        got[k] += ids.tolist()
    for text, ids in zip(texts(), got):
        assert ids == known.encode_ordinary(text)
        assert tok.decode(np.array(ids, np.int64)) == text.encode()


def test_matrices_and_heap_agree(tok):
    rnd = random.Random(1)
    pieces = ["".join(rnd.choices("aentsh", k=rnd.randint(2, 200))).encode() for _ in range(60)]
    for piece, ids in zip(pieces, tok._matrix(pieces, 256)):
        assert ids.tolist() == tok._heap(piece).tolist()


def test_very_long_text_comes_in_blocks(tok, known, monkeypatch):
    monkeypatch.setattr(bpe, "_PIECES", 1000)
    text = "the quick brown fox " * 60000
    blocks = [ids for k, ids in tok.encode_blocks(["a b", text, None, "c"]) if k == 1]
    assert len(blocks) > 10 and np.concatenate(blocks).tolist() == known.encode_ordinary(text)


def test_query_digests(spark, known):
    rows = [*enumerate(texts()), (None, None), (3, None), (3, "again")]
    docs = spark.createDataFrame([(i, t, "other") for i, t in rows], "doc_id long, text string, ids string")
    got = sorted((r.ids_sha256, r.decoded_sha256, r.n_tokens) for r in bpe.digests(docs).collect())
    want = []
    for _, t in rows:
        ids = known.encode_ordinary(t or "")
        want.append((hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), len(ids)))
    assert got == sorted(want)
    assert bpe.digests(docs.limit(0)).count() == 0
    first = bpe.encode(docs).where("doc_id = 2").first()
    assert list(first.ids) == known.encode_ordinary("Hello world")
