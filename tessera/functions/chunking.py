"""Chunks of texts by tokens, as a table function: windows that overlap, or parts between separators.

The tokenizer is a parameter: any object with ``encode(text) -> list of ids`` and ``decode(ids) -> text`` that can be pickled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "chunk_order_index int, tokens int, content string"


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class Characters:
    """Each code point is a token."""

    def encode(self, text: str) -> list[int]:
        return list(map(ord, text))

    def decode(self, ids: list[int]) -> str:
        return "".join(map(chr, ids))


class Ranks:
    """A byte-level tokenizer of a file of ranks, which all executors must be able to open; special tokens count as text."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self._made = path, pattern, None

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "_made": None}  # made again where it is used

    def _own(self):
        if self._made is None:
            import tiktoken
            from tiktoken.load import load_tiktoken_bpe

            self._made = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=load_tiktoken_bpe(self.path), special_tokens={})
        return self._made

    def encode(self, text: str) -> list[int]:
        return self._own().encode(text, disallowed_special=())

    def decode(self, ids: list[int]) -> str:
        return self._own().decode(ids)


class TooLong(ValueError):
    """A part between separators has more tokens than a chunk may have."""


def windows(text: str, tokenizer: Tokenizer, size: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(tokens, content) of windows of ``size`` tokens, each ``overlap`` tokens before the end of the one before."""
    ids = tokenizer.encode(text)
    for low in range(0, len(ids), size - overlap):
        part = ids[low : low + size]
        yield len(part), tokenizer.decode(part)


def parts(text: str, tokenizer: Tokenizer, size: int, overlap: int, separator: str, only: bool) -> Iterator[tuple[int, str]]:
    """(tokens, content) of what lies between separators; a part of over ``size`` tokens is cut into windows, or is an error."""
    for part in text.split(separator):
        n = len(tokenizer.encode(part))
        if n <= size:
            yield n, part
        elif only:
            raise TooLong(f"a part has {n} tokens, a chunk may have {size}: {part[:120]!r}")
        else:
            yield from windows(part, tokenizer, size, overlap)


def chunker(tokenizer: Tokenizer | None = None, size: int = 1200, overlap: int = 100, separator: str | None = None, only: bool = False):
    """A table function of a text: chunk_order_index, tokens, content (without outer white space).

    ``separator`` splits the text first; ``only`` makes a part that is too long an error rather than several chunks. A null or
    empty text has no chunk, but an empty part between separators has an empty one. The number of tokens is that
    before white space is taken off. Can be registered for SQL: ``spark.udtf.register(name, chunker(...))``.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under size")
    if separator == "":
        raise ValueError("separator must not be empty")
    by = tokenizer or Characters()

    class Chunks:
        def eval(self, text: str):
            if text:
                found = windows(text, by, size, overlap) if separator is None else parts(text, by, size, overlap, separator, only)
                for at, (n, content) in enumerate(found):
                    yield at, n, content.strip()

    return F.udtf(Chunks, returnType=COLUMNS)


def chunk(df: DataFrame, text: str, *keep: str, **options) -> DataFrame:
    """The columns ``keep`` of each row beside each of its chunks; rows without chunks are left out."""
    rows = df.select(*keep, F.col(text).alias("__text"))
    return rows.lateralJoin(chunker(**options)(F.col("__text").outer())).select(*keep, "chunk_order_index", "tokens", "content")


def register(spark: SparkSession, name: str = "chunk_text", **options) -> None:
    spark.udtf.register(name, chunker(**options))
