"""Byte-level BPE encoding and decoding with length-bucketed numpy matrices.

A text is cut by the pattern; each distinct piece is encoded once per block of text. Pieces that are tokens are
done. The others are put, by length, into padded matrices of token ids, one row a piece. In every round each row
looks all its neighbouring pairs up in a hash table of mergeable pairs, merges the leftmost pair of minimum rank
and is compacted; rows without a mergeable pair leave. A pair is mergeable if its joined bytes are a token, for any
split of that token, which is the rule of rank-based encoders. Pieces longer than ``_LONG`` bytes go through the
same rule with a heap of ranks, since one merge a round would take quadratic time there.

Null text counts as empty: no tokens. Decoding joins the ids' bytes and gives every text back byte for byte.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .hashing import Table

PAD, NONE = -1, 1 << 40
#: Longest piece for matrices, and pieces handled at a time.
_LONG, _PIECES, _MOST = 256, 1 << 17, 1 << 19


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Tokenizer:
    """Ranks and pattern, ready to encode and decode."""

    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find, self.n = regex.compile(pattern).findall, max(self.ranks.values()) + 1
        self.iter = regex.compile(pattern).finditer
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = [b""] * self.n
        for data, rank in self.ranks.items():
            tokens[rank] = data
        self.tokens = tokens
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, self.n)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        pairs = {}
        for data, rank in self.ranks.items():
            for i in range(1, len(data)):
                a, b = self.ranks.get(data[:i]), self.ranks.get(data[i:])
                if a is not None and b is not None:
                    pairs[a * self.n + b] = rank
        self.pairs = pairs
        self.known, self.flat_ids = {}, []  # pieces seen by this worker, cleared at _MOST
        self.merges = Table(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)), NONE)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair joins to, NONE if there is none."""
        return self.merges.get(np.where((a < 0) | (b < 0), -2, a * self.n + b))

    def _matrix(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """All pieces are ``width`` bytes or shorter."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(n, width)
        ids = np.where(np.arange(width)[None, :] < sizes[:, None], self.byte_ids[data], PAD)
        rank = self.lookup(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 0), NONE)
        rows, out = np.arange(n), [None] * n
        while len(rows):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)  # leftmost of the least
            value = rank[np.arange(len(rows)), best] if rank.shape[1] else np.full(len(rows), NONE)
            done = value == NONE
            if done.any():
                for r, row in zip(rows[done].tolist(), ids[done]):
                    out[r] = row[row != PAD]
                rows, ids, rank, best, value = rows[~done], ids[~done], rank[~done], best[~done], value[~done]
                if not len(rows):
                    break
            here, col = np.arange(len(rows)), np.arange(ids.shape[1] - 1)[None, :]
            ids[here, best] = value
            ids = np.concatenate((np.where(col <= best[:, None], ids[:, :-1], ids[:, 1:]),), axis=1)  # drop best + 1
            col = np.arange(rank.shape[1] - 1)[None, :]
            rank = np.where(col <= best[:, None], rank[:, :-1], rank[:, 1:])
            if rank.shape[1]:
                for shift in (-1, 0):  # only the merged token's two pairs are new
                    at = best + shift
                    ok = np.flatnonzero((at >= 0) & (at < rank.shape[1]))
                    rank[ok, at[ok]] = self.lookup(ids[ok, at[ok]], ids[ok, at[ok] + 1])
        return out

    def _heap(self, piece: bytes) -> np.ndarray:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, pairs, size = len(ids), self.pairs, self.n
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := pairs.get(ids[x] * size + ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            if (rank := self.ranks.get(piece)) is not None:
                out[k] = np.array([rank], np.int64)
            elif len(piece) > _LONG:
                out[k] = self._heap(piece)
            else:
                buckets.setdefault(len(piece) if len(piece) <= 16 else 1 << (len(piece) - 1).bit_length(), []).append(k)
        for width, mine in buckets.items():
            step = max(1, (1 << 20) // width)
            for i in range(0, len(mine), step):
                for k, ids in zip(mine[i : i + step], self._matrix([pieces[k] for k in mine[i : i + step]], width)):
                    out[k] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        at = np.repeat(self.offsets[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        return self.flat[at].tobytes()

    def encode_blocks(self, texts: list[str | None]):
        """Yields (index of text, ids) in order; a text too long for one block comes in several."""
        known, flat = self.known, self.flat_ids

        def ids_of(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            new = [x for x in dict.fromkeys(pieces) if x not in known]
            for x, ids in zip(new, self.encode_pieces([x.encode("utf-8", "surrogatepass") for x in new])):
                known[x] = len(flat)
                flat.append(ids)
            order = np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))
            used, inverse = np.unique(order, return_inverse=True)
            values = [flat[k] for k in used.tolist()]
            sizes = np.fromiter(map(len, values), np.int64, len(values))
            data, begin = np.concatenate(values), np.cumsum(sizes) - sizes
            count = sizes[inverse]
            at = np.repeat(begin[inverse] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            return data[at], np.cumsum(count)

        def flush(pieces, marks):
            if pieces:
                data, upto = ids_of(pieces)
            start = 0
            for index, end in marks:
                lo, hi = (int(upto[start - 1]) if start else 0), (int(upto[end - 1]) if end else 0)
                yield index, data[lo:hi] if end > start else np.empty(0, np.int64)
                start = end
            if len(known) > _MOST:
                known.clear()
                flat.clear()

        pieces: list[str] = []
        marks: list[tuple[int, int]] = []
        for index, text in enumerate(texts):
            if text and len(text) > 1 << 20:
                for m in self.iter(text):
                    pieces.append(m[0])
                    if len(pieces) >= _PIECES:
                        yield from flush(pieces, [*marks, (index, len(pieces))])
                        pieces, marks = [], []
            else:
                pieces += self.find(text or "")
            marks.append((index, len(pieces)))
            if len(pieces) >= _PIECES:
                yield from flush(pieces, marks)
                pieces, marks = [], []
        yield from flush(pieces, marks)


@lru_cache(maxsize=2)
def tokenizer(ranks_path: str, pattern: str) -> Tokenizer:
    return Tokenizer(ranks_path, pattern)


def encode(docs: DataFrame, ident: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every row. The rank file's path is opened on each executor, where it is installed."""
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    def run(batches):
        tok = tokenizer(path, pattern)
        for batch in batches:
            got: list[list[np.ndarray]] = [[] for _ in range(len(batch))]
            for k, ids in tok.encode_blocks(batch["text"].tolist()):
                got[k].append(ids)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [np.concatenate(x).astype(np.int32) for x in got]})

    rows = docs.selectExpr(f"cast(`{ident}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return rows.mapInPandas(run, "doc_id long, ids array<int>")


def digests(docs: DataFrame, ident: str = "doc_id", text: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256."""
    path, pattern = ranks_path or default_ranks(), pattern or default_pattern()

    def run(batches):
        tok = tokenizer(path, pattern)
        for batch in batches:
            n = len(batch)
            count, ids_hash, text_hash = [0] * n, [None] * n, [None] * n
            last, a, b = -1, None, None
            for k, ids in tok.encode_blocks(batch["text"].tolist()):
                if k != last:
                    if last >= 0:
                        ids_hash[last], text_hash[last] = a.hexdigest(), b.hexdigest()
                    last, a, b = k, hashlib.sha256(), hashlib.sha256()
                a.update(ids.astype("<u4").tobytes())
                b.update(tok.decode(ids))
                count[k] += len(ids)
            if last >= 0:
                ids_hash[last], text_hash[last] = a.hexdigest(), b.hexdigest()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": np.array(count, np.int64), "ids_sha256": ids_hash, "decoded_sha256": text_hash})

    rows = docs.selectExpr(f"cast(`{ident}` as long) as doc_id", f"cast(`{text}` as string) as text")
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op4_bpe": op4_bpe}
ORACLES: dict[str, str] = {}
