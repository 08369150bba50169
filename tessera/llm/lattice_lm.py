"""Language-model scoring by a subword lattice.

The pieces of an existing vocabulary are a unigram model: a word, with a space before it, has every segmentation
into pieces, and its probability is the sum over all of them and an end of word, found by a forward recursion in log
space. The words of the training text are arcs of the lattice too: P(word) = seen * c / N + (1 - seen) * P(pieces),
where 1 - seen is the share of training tokens that are words seen once (Good-Turing). A document is its words and
one end, so the score is the marginal over all paths. Every single byte is a piece: every text has a probability.

The vocabulary's scores start from the order in which it stores its pieces (Zipf) and are re-estimated by
``rounds`` of expectation-maximisation over all training words, each word once, since pieces only stand in for rare
words; pieces keep a small prior. Only piece totals, at most one for each piece, come to the driver.

The base score is an add-one unigram of words. Each distinct word of the corpus is counted once and scored once, in
one table. A document needs the scores of its own words: those of up to ``common`` most frequent words (chosen by a
count threshold, so their number is bounded) are sent to every executor, all rarer ones are joined by the word.

Training takes the documents whose crc32(doc_id as text) mod 7 is not 2, all of them. Null text counts as empty and
scores its end symbol; a null id counts as the text ''. Repeated rows each count and each get a score. Without
training documents, N and V are zero and the pieces keep their first scores. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .hashing import Table

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Words kept between batches in a task; bytes up to which words share matrices; bytes of a text, and tokens, in hand.
_KNOWN, _SHORT, _TEXT, _TOKENS = 1 << 19, 64, 1 << 22, 1 << 20


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words_of(data: bytes | None) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text with A-Z lowered, some megabytes of it at a time. bytes.split() and bytes.lower()
    know ASCII alone, which is what the separators and the letters here are."""
    at = 0
    while data and at < len(data):
        end = _SPACE.search(data, at + _TEXT) if len(data) - at > _TEXT else None
        yield data[at : end.start() if end else len(data)].lower().split()
        at = end.start() if end else len(data)


class Ids(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Vocabulary:
    """Pieces as a trie in a hash table: (node, byte) to node; piece_at[node] is the piece that ends there."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pieces = [base64.b64decode(line.split()[0]) for line in f]
        self.n, self.longest = len(pieces), max(map(len, pieces))
        nodes, ends = {}, {}
        count = 1
        for k, piece in enumerate(pieces):
            at = 0
            for b in piece:
                key = at << 8 | b
                if key not in nodes:
                    nodes[key] = count
                    count += 1
                at = nodes[key]
            ends[at] = k
        self.step = Table(np.fromiter(nodes, np.int64, len(nodes)), np.fromiter(nodes.values(), np.int64, len(nodes)))
        self.piece_at = np.full(count, -1, np.int64)
        self.piece_at[np.fromiter(ends, np.int64, len(ends))] = np.fromiter(ends.values(), np.int64, len(ends))

    def first_scores(self) -> np.ndarray:
        p = 1.0 / np.arange(2, self.n + 2)
        return np.log(p / p.sum() * 0.9)

    def edges(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """All pieces that occur in the rows: (row, begin, end, piece), sorted by end."""
        n, width = data.shape
        rows, begins = np.divmod(np.arange(n * width), width)
        live = np.flatnonzero(begins < sizes[rows])
        rows, begins = rows[live], begins[live]
        at, out, length = np.zeros(len(rows), np.int64), [], 0
        while len(rows):
            here = begins + length
            ok = here < sizes[rows]
            rows, begins, at, here = rows[ok], begins[ok], at[ok], here[ok]
            at = self.step.get(at << 8 | data[rows, here].astype(np.int64))
            ok = at >= 0
            rows, begins, at, here = rows[ok], begins[ok], at[ok], here[ok]
            length += 1
            piece = self.piece_at[at]
            hit = piece >= 0
            out.append((rows[hit], begins[hit], here[hit] + 1, piece[hit]))
        row, begin, end, piece = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(end, kind="stable")
        return row[order], begin[order], end[order], piece[order]

    def forward(self, data, sizes, logp, edges=None):
        """Log of the sum over all segmentations of each row[:j]: (rows, width + 1)."""
        row, begin, end, piece = edges or self.edges(data, sizes)
        n, width = data.shape
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0
        cut = np.searchsorted(end, np.arange(1, width + 2))
        for j in range(1, width + 1):
            s = slice(cut[j - 1], cut[j])
            if s.start < s.stop:
                alpha[:, j] = _logsum(n, row[s], alpha[row[s], begin[s]] + logp[piece[s]])
        return alpha

    def backward(self, data, sizes, logp, edges):
        row, begin, end, piece = edges
        n, width = data.shape
        beta = np.full((n, width + 1), -np.inf)
        beta[np.arange(n), sizes] = 0
        order = np.argsort(begin, kind="stable")
        row, begin, end, piece = row[order], begin[order], end[order], piece[order]
        cut = np.searchsorted(begin, np.arange(width + 1))
        for i in range(width - 1, -1, -1):
            s = slice(cut[i], cut[i + 1])
            if s.start < s.stop:
                value = _logsum(n, row[s], beta[row[s], end[s]] + logp[piece[s]])
                beta[:, i] = np.where(sizes == i, 0.0, value)
        return beta


def _logsum(n: int, row: np.ndarray, value: np.ndarray) -> np.ndarray:
    top = np.full(n, -np.inf)
    np.maximum.at(top, row, value)
    base = np.where(np.isfinite(top), top, 0)
    total = np.bincount(row, np.exp(value - base[row]), n)
    with np.errstate(divide="ignore"):
        return np.where(total > 0, np.log(total) + base, -np.inf)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _matrices(words: list[bytes] | list[str]):
    """The words as padded byte matrices by length, a space before each: (indices, data, sizes)."""
    raw = [b" " + (w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass")) for w in words]
    buckets: dict[int, list[int]] = {}
    for k, b in enumerate(raw):
        size = len(b)
        buckets.setdefault(-(-size // 4) * 4 if size <= _SHORT else 1 << (size - 1).bit_length(), []).append(k)
    for width, mine in buckets.items():
        step = max(1, (1 << 19) // width)
        for i in range(0, len(mine), step):
            part = mine[i : i + step]
            data = np.frombuffer(b"".join(raw[k].ljust(width, b"\0") for k in part), np.uint8).reshape(len(part), width)
            yield np.array(part), data, np.fromiter((len(raw[k]) for k in part), np.int64, len(part))


def word_scores(vocab: Vocabulary, logp: np.ndarray, words: list) -> np.ndarray:
    """The natural log of each word's probability, over all its segmentations."""
    out = np.empty(len(words))
    for index, data, sizes in _matrices(words):
        out[index] = vocab.forward(data, sizes, logp)[np.arange(len(index)), sizes]
    return out


def expected(vocab: Vocabulary, logp: np.ndarray, words: list, counts: np.ndarray) -> np.ndarray:
    """Expected number of times that each piece is used in the words, each seen ``counts`` times."""
    out = np.zeros(vocab.n)
    for index, data, sizes in _matrices(words):
        edges = vocab.edges(data, sizes)
        alpha, beta = vocab.forward(data, sizes, logp, edges), vocab.backward(data, sizes, logp, edges)
        row, begin, end, piece = edges
        share = np.exp(alpha[row, begin] + logp[piece] + beta[row, end] - beta[row, 0])
        out += np.bincount(piece, share * counts[index][row], vocab.n)
    return out


def _held(ident, mod: int, value: int):
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % mod == value


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c, t) over the whole texts of (data, held_out): c counts training rows alone, t all. The empty word
    stands for the end symbol. Words are combined before they are sent."""

    def sent(train, held):
        words = list(train.keys() | held.keys())
        c = np.fromiter((train[w] for w in words), np.int64, len(words))
        t = c + np.fromiter((held[w] for w in words), np.int64, len(words))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c), pa.array(t)], ["word", "c", "t"])

    def run(batches):
        train, held = Counter(), Counter()
        for batch in batches:
            for data, out in zip(batch.column("data"), batch.column("held_out").to_pylist()):
                counts = held if out else train
                counts[b""] += 1
                for words in words_of(data.as_py()):
                    counts.update(words)
                if len(train) + len(held) > _KNOWN:
                    yield sent(train, held)
                    train, held = Counter(), Counter()
        if train or held:
            yield sent(train, held)

    return rows.select("data", "held_out").mapInArrow(run, "word binary, c long, t long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))


def fit(counts: DataFrame, path: str, rounds: int = 2, prior: float = 0.01) -> tuple[np.ndarray, float]:
    """(log-probability of each piece, that of the end of a word), from all training words."""
    vocab, spark = vocabulary(path), counts.sparkSession
    logp, end = vocab.first_scores(), float(np.log(0.1))
    words = counts.where((F.col("c") > 0) & (F.length("word") > 0)).select("word")
    types = words.count()
    for _ in range(rounds if types else 0):
        sent = spark.sparkContext.broadcast(logp)

        def run(batches, sent=sent):
            v, total = vocabulary(path), None
            for batch in batches:
                got = expected(v, sent.value, batch["word"].tolist(), np.ones(len(batch)))
                total = got if total is None else total + got
            if total is not None:
                used = np.flatnonzero(total)
                yield pd.DataFrame({"piece": used, "c": total[used]})

        rows = words.mapInPandas(run, "piece long, c double").groupBy("piece").agg(F.sum("c").alias("c")).orderBy("piece").toPandas()
        total = np.full(vocab.n, prior)
        total[rows["piece"].to_numpy(np.int64)] += rows["c"].to_numpy(np.float64)
        whole = total.sum() + types
        logp, end = np.log(total / whole), float(np.log(types / whole))
    return logp, end


def word_table(counts: DataFrame, path: str, logp: np.ndarray, end: float, n: int, v: int, seen: float) -> DataFrame:
    """(word, c, t, base, score): the log10 scores of each distinct word, each made once."""
    sent = counts.sparkSession.sparkContext.broadcast(logp)
    floor = float(np.log10(n + v + 1))

    def run(batches):
        vocab = vocabulary(path)
        for batch in batches:
            c = batch.column("c").to_numpy()
            pieces = word_scores(vocab, sent.value, batch.column("word").to_pylist()) + end + np.log(1 - seen)
            with np.errstate(divide="ignore"):  # in log space: a long word's pieces underflow
                score = np.logaddexp(np.log(c * (seen / max(n, 1))), pieces) / np.log(10)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("word", "c", "t")), pa.array(np.log10(c + 1.0) - floor), pa.array(score)], ["word", "c", "t", "base", "score"])

    return counts.select("word", "c", "t").mapInArrow(run, "word binary, c long, t long, base double, score double")


def threshold(counts: DataFrame, most: int) -> int:
    """The least count such that ``most`` words or fewer have it."""
    level = (F.log2(F.col("t").cast("double")) * 16).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("least")).collect()
    total, least = 0, 1 << 62
    for row in sorted(sizes, key=lambda r: -r["level"]):  # at most some thousand levels
        total += row["n"]
        if total > most:
            break
        least = row["least"]
    return least


def score(docs: DataFrame, ident: str = "doc_id", text: str = "text", mod: int = 7, value: int = 2, path: str | None = None, common: int = 200_000, rounds: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    path = path or default_vocabulary()
    spark = docs.sparkSession
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("data"), _held(F.col(ident), mod, value).alias("held_out"))
    counts = materialize(count_words(rows), "words")
    n, v, once = counts.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count(F.when(F.col("c") == 1, 1))).first()
    seen = min(max(1 - once / n, 1e-6), 1 - 1e-6) if n else 0.0
    scored = materialize(word_table(counts, path, *fit(counts, path, rounds), n, v, seen), "word-scores")
    often = (F.col("t") >= threshold(counts, common)) | (F.length("word") == 0)
    known = scored.where(often).collect()  # ``common`` words and the end symbol at most
    known.sort(key=lambda r: len(r["word"]) > 0)  # the end symbol comes first
    sent = spark.sparkContext.broadcast(([bytes(r["word"]) for r in known], *(np.array([r[k] for r in known], np.float64) for k in ("base", "score", "c"))))
    kinds = {"row": pa.int64(), "word": pa.binary(), "f": pa.int64(), "doc_id": None, "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64()}

    def run(batches):
        words, base, model, count = sent.value
        first = Ids((w, k) for k, w in enumerate(words))
        ids, size, number = Ids(first), len(first), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33

        def made(like, **cols):
            n = len(next(iter(cols.values())))
            return pa.RecordBatch.from_arrays([cols[k] if k in cols else pa.nulls(n, t or like) for k, t in kinds.items()], list(kinds))

        for batch in batches:
            like, at = batch.column("doc_id").type, 0
            texts = batch.column("data")
            while at < len(texts):
                own, of, begin, held = [], [], at, 0
                while at < len(texts) and held < _TOKENS:
                    tokens = [np.fromiter(map(ids.__getitem__, part), np.int64, len(part)) for part in words_of(texts[at].as_py())]
                    own += [np.zeros(1, np.int64), *tokens]  # the end symbol is number 0
                    of.append(1 + sum(map(len, tokens)))
                    held += of[-1]
                    at += 1
                token, sizes = np.concatenate(own), np.array(of)
                doc, often = np.repeat(np.arange(len(of)), sizes), token < size
                total = lambda x: np.bincount(doc[often], x[token[often]], len(of))  # noqa: B023, E731
                # The document itself is a row under a key that no word can have.
                yield made(
                    like, row=pa.array(number + np.arange(len(of))), word=pa.array([b" %d" % k for k in range(number, number + len(of))], pa.binary()), doc_id=batch.column("doc_id").slice(begin, len(of)),
                    held_out=batch.column("held_out").slice(begin, len(of)), n_tokens=pa.array(sizes), n_known=pa.array(total(count > 0).astype(np.int64)), base=pa.array(total(base)), score=pa.array(total(model)),
                )
                pair, f = np.unique(doc[~often] * len(ids) + token[~often], return_counts=True)
                if len(pair):
                    names = list(ids)
                    yield made(like, row=pa.array(number + pair // len(ids)), word=pa.array([names[k] for k in (pair % len(ids)).tolist()], pa.binary()), f=pa.array(f))
                number += len(of)
                if len(ids) > size + _KNOWN:
                    ids = Ids(first)

    parts = rows.mapInArrow(run, f"row long, word binary, f long, doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, n_tokens long, n_known long, base double, score double")
    rare = scored.where(~often).select("word", F.col("c").alias("w_c"), F.col("base").alias("w_base"), F.col("score").alias("w_score"))
    joined = parts.join(rare, "word", "left")
    added = lambda name: F.max(name) + F.coalesce(F.sum(F.col("f") * F.col(f"w_{name}")), F.lit(0.0))
    total = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("w_c") > 0, F.col("f"))), F.lit(0))).alias("n_known"), added("base").alias("base_score"), added("score").alias("score"),
    )
    return total.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op2_lattice_lm": op2_lattice_lm}
ORACLES: dict[str, str] = {}
