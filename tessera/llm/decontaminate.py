"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur with up to k = floor(rate * m) edits. It is cut into k + 1 pieces: an
occurrence with k edits or fewer holds one piece at least unchanged. All pieces of a block of items are searched at
once (Aho-Corasick); each piece hit gives a window of the document, windows of an item that overlap are joined, and
Myers' bit-parallel distance finds the best occurrence there. Texts are compared in lower case with every run of
white space as one space; places are code points of that form.

Items are taken in blocks of ``block_bytes``; each block is sent to the executors and run against all documents, so
what is sent is bounded however many items there are. Null and blank items and texts match nothing. Repeated rows
of a document give one row. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_SPACE = re.compile(r"\s+")
RATE = 0.08


def normal(text: str | None) -> str:
    return _SPACE.sub(" ", (text or "").lower()).strip()


def budget(m: int, rate: float = RATE) -> int:
    return int(m * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, as (offset, piece)."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(eq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the pattern to any substring of text, the first end at which it is reached)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for i, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, i
        ph = ph << 1 & full  # an occurrence may begin anywhere: nothing comes in below
        mh = mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best, end


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, by_piece = [], {}
        for item_id, raw in items:
            item = normal(raw)
            if not item:
                continue
            n, k = len(self.items), budget(len(item), rate)
            self.items.append((item_id, item, k, bits(item), bits(item[::-1])))
            for offset, piece in pieces(item, k):
                by_piece.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            self.automaton.add_word(piece, (len(piece), places))
        if by_piece:
            self.automaton.make_automaton()
        self.empty = not by_piece

    def find(self, raw: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best, then first, occurrence of each item."""
        text = normal(raw)
        if self.empty or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                _, item, k, _, _ = self.items[n]
                begin = last + 1 - size - offset
                windows.setdefault(n, []).append((max(0, begin - k), min(len(text), begin + len(item) + k)))
        out = []
        for n, spans in windows.items():
            item_id, item, k, eq, back = self.items[n]
            spans.sort()
            best, joined = None, [list(spans[0])]
            for a, b in spans[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            for a, b in joined:
                d, end = myers(eq, len(item), text[a:b])
                if d <= k and (best is None or d < best[0]):
                    best = (d, a + end)
            if best:
                d, end = best
                low = max(0, end - len(item) - d)
                _, size = myers(back, len(item), text[low:end][::-1])
                out.append((item_id, d, end - size, end))
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", rate: float = RATE, block_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for every document and item that occurs in it."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null and text is not null")
    out = None
    for sent in blocks_of(benchmark, block_bytes):
        found = rows.mapInPandas(_search(sent, rate), "doc_id long, item_id long, distance int, start int, end int")
        out = found if out is None else out.unionByName(found)
    best = F.min(F.struct("distance", "start", "end")).alias("b")  # repeated rows of an id give one
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.distance", "b.start", "b.end")


def blocks_of(benchmark: DataFrame, block_bytes: int) -> list:
    """The items in broadcast blocks of about ``block_bytes``."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-size // block_bytes))
    return [spark.sparkContext.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block).collect()]) for block in range(n)]


def _search(sent, rate):
    def run(batches):
        matcher = Matcher(sent.value, rate)
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch["doc_id"], batch["text"]) for hit in matcher.find(text)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "start", "end"])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, decided row by row where they are."""
    for sent in blocks_of(benchmark, block_bytes):
        docs = docs.where(_clean(sent, rate)(F.col(text).cast("string")))
    return docs


def _clean(sent, rate):
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, rate)
        for texts in batches:
            yield pd.Series([not matcher.find(t) for t in texts], dtype="bool")

    clean.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}  # as types, not strings
    return F.pandas_udf(clean, "boolean")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLES: dict[str, str] = {}
