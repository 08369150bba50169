"""Chunks against plain Python, over texts of none, one and a million characters."""

import pytest

from tessera.functions import chunking as C


def pairs():
    class Pairs:  # local, so that it is sent to the workers as it is
        """Two characters are a token: another tokenizer than the default."""

        def encode(self, text):
            return [ord(text[i]) << 32 | (ord(text[i + 1]) + 1 if i + 1 < len(text) else 0) for i in range(0, len(text), 2)]

        def decode(self, ids):
            return "".join(chr(i >> 32) + (chr((i & 0xFFFFFFFF) - 1) if i & 0xFFFFFFFF else "") for i in ids)

    return Pairs()


def plain(text, unit, size, overlap, separator=None):
    """By characters only: ``unit`` of them are a token."""
    out = []
    for part in [text] if separator is None else text.split(separator):
        n = -(-len(part) // unit)
        if separator is not None and n <= size:
            out.append((n, part.strip()))
            continue
        for low in range(0, n, size - overlap):
            piece = part[low * unit : (low + size) * unit]
            out.append((-(-len(piece) // unit), piece.strip()))
    return [(i, *x) for i, x in enumerate(out)] if text else []


TEXTS = ["", "a", None, " \n", "ab\n\ncd\n" + "x y" * 40, "é\U0001f600" * 9, ("word \n" * 200_000)[:1_000_000]]


@pytest.mark.parametrize("size, overlap, separator", [(7, 0, None), (7, 3, None), (1200, 100, None), (7, 2, "\n"), (50, 49, "\n\n")])
@pytest.mark.parametrize("tokenizer, unit", [(None, 1), (pairs(), 2)])
def test_same_as_plain_python(spark, size, overlap, separator, tokenizer, unit):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "id int, body string, tokens int")
    got = {}
    for r in C.chunk(df, "body", "id", tokenizer=tokenizer, size=size, overlap=overlap, separator=separator).collect():
        got.setdefault(r.id, []).append((r.chunk_order_index, r.tokens, r.content))
    for i, text in enumerate(TEXTS):
        assert sorted(got.get(i, [])) == plain(text or "", unit, size, overlap, separator)
    assert C.chunk(df.limit(0), "body", "id").collect() == []


def test_parts_that_are_too_long(spark):
    df = spark.createDataFrame([("short|" + "long" * 10,)], "t string")
    assert [r.content for r in C.chunk(df, "t", size=40, overlap=0, separator="|", only=True).collect()] == ["short", "long" * 10]
    with pytest.raises(Exception, match="a part has 40 tokens, a chunk may have 39"):
        C.chunk(df, "t", size=39, overlap=0, separator="|", only=True).collect()
    for bad in ({"size": 5, "overlap": 5}, {"size": 5, "overlap": -1}, {"separator": ""}):
        with pytest.raises(ValueError):
            C.chunker(**bad)


def test_sql(spark):
    C.register(spark, size=4, overlap=1)
    got = spark.sql("SELECT id, c.* FROM VALUES (1, 'abcdefg'), (2, NULL) AS t(id, body), LATERAL chunk_text(body) AS c ORDER BY id, chunk_order_index")
    assert [tuple(r) for r in got.collect()] == [(1, 0, 4, "abcd"), (1, 1, 4, "defg"), (1, 2, 1, "g")]
