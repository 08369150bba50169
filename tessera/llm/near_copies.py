"""Near-copies by the Jaccard similarity of word shingles: candidates by min-hashes, each link verified on whole sets.

Search: 150 min-hashes of a document's set of shingles in 30 bands of 5. Documents that agree in one band at least
are candidates: at similarity s a pair is missed with chance (1 - s^5)^30, which is 7e-6 at 0.8 and less above.

Verification: a candidate pair is a link if |A & B| >= similarity * |A | B| on the sets themselves. Stars come first,
each document against the least, then against the greatest document of each of its bands; what the links found so
far already connect needs no more comparing, so a large group of copies costs rows in its size, not its square. All
candidate pairs that are still apart are then compared, none is left out: those of bands of few documents one by one,
those of larger bands in blocks, whose pairs are never rows. A block has some ``_BLOCK`` documents or ``_SHINGLES``
shingles, each document goes to every pair of blocks that has its own, and a task counts the common shingles of two
blocks as a product of matrices, in the memory of two blocks. Both ways find the same links. The blocks of a band grow
with the square of its documents that are still apart (a family just below ``similarity``), at some 10^-5 CPU seconds a pair.

Shingles are XXH64 hashes of ASCII lower-case words with single spaces between; a text of fewer words is one shingle,
a text without words has none, and two such texts are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, join_counted, materialize

BANDS, ROWS = 30, 5
_RND = np.random.default_rng(42)
_MUL = _RND.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RND.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2)
_FOLD = _RND.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles hashed at a time: this bounds memory, never what it covers.
_AT_ONCE = 1 << 12
#: Documents of a band that are compared pair by pair; above, by blocks of some _BLOCK documents and _SHINGLES shingles.
_FEW, _BLOCK, _SHINGLES = 32, 512, 1 << 18
#: Columns of a matrix of common shingles.
_COLUMNS = 1 << 12


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The sorted distinct hashes of the shingles of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()
    if not found:
        return np.empty(0, np.uint64)
    data, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) < words:
        return np.array([digest(data, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1].tolist()
    return np.unique(np.fromiter((digest(data[s:e], seed) for s, e in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    mixed = hashes ^ (hashes >> np.uint64(31))
    for i in range(0, len(mixed), _AT_ONCE):
        x = mixed[i : i + _AT_ONCE, None] * _MUL + _ADD
        np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _FOLD).sum(axis=1, dtype=np.uint64)


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def _keys(docs: DataFrame, words: int) -> DataFrame:
    """(key, node, n) for each band of each row; n is the number of distinct shingles."""

    def run(batches):
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            if sets:
                keys = np.concatenate([bands(s) for s in sets]).view(np.int64)
                node = np.repeat(batch.column("node").to_numpy(), BANDS)
                n = np.repeat(np.array([len(s) for s in sets], np.int64), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node), pa.array(n)], ["key", "node", "n"])

    return docs.mapInArrow(run, "key long, node long, n long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) that are links."""

    def near(batches):
        for left, right in batches:
            sets: dict[str, np.ndarray] = {}
            for t in right:  # a star has one text on this side many times
                if t not in sets:
                    sets[t] = shingles(t, words)
            yield pd.Series([alike(shingles(x, words), sets[y], similarity) for x, y in zip(left, right)], dtype="bool")

    near.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}  # as types, not strings
    near = F.pandas_udf(near, "boolean")
    side = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(near("text_a", "text_b")).select("a", "b")


def forest(sets: list[np.ndarray], comp: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links, by position, that span what all links between sets of different ``comp`` connect."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    row, column = np.repeat(np.arange(len(sets)), sizes)[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)))
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        part = slice(*np.searchsorted(column, (low, low + _COLUMNS)))
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[row[part], column[part] - low] = 1
        both += has @ has.T
    near = (both >= similarity * (sizes[:, None] + sizes[None, :] - both)) & (comp[:, None] != comp[None, :])
    a: list[int] = []
    b: list[int] = []
    left = near.any(axis=1)
    for first in np.flatnonzero(left).tolist():
        reach = [first] if left[first] else []
        left[first] = False
        while reach:
            at = reach.pop()
            found = np.flatnonzero(near[at] & left).tolist()
            left[found] = False
            a += [at] * len(found)
            b += found
            reach += found
    return a, b


def _in_blocks(rows: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links among the rows (key, node, n, comp, many, total) of each key; ``many`` rows and ``total`` shingles have it."""

    def hashed(batches):
        for batch in batches:
            sets = [shingles(t, words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    def compare(batches):
        kept = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            kept = now if kept is None else pa.concat_tables([kept, now])
            pair = kept.column("pair").to_numpy()
            ends = np.flatnonzero(pair[1:] != pair[:-1]) + 1
            for low, high in zip([0, *ends[:-1].tolist()], ends.tolist()):
                yield linked(kept.slice(low, high - low))
            kept = kept.slice(int(ends[-1])) if len(ends) else kept  # the rest may go on in the next batch
        if kept is not None and kept.num_rows:
            yield linked(kept)

    def linked(group):
        sets = [np.frombuffer(x, np.uint64) for x in group.column("shingles").to_pylist()]
        a, b = forest(sets, group.column("comp").to_numpy(), similarity)
        node = group.column("node").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], ["a", "b"])

    sets = materialize(texts.join(rows.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(hashed, "node long, shingles binary"), "sets")
    blocks = F.greatest(F.ceil(F.col("many") / _BLOCK), F.ceil(F.col("total") / _SHINGLES)).cast("int")
    own, other = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.col("other")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.where("other <> own or blocks = 1")  # two rows of one block meet beside any other block
    dealt = dealt.select(F.xxhash64("key", F.least("own", other), F.greatest("own", other)).alias("pair"), "node", "comp")
    sent = dealt.join(sets, "node").repartition("pair").sortWithinPartitions("pair")
    return sent.select("pair", "node", "comp", "shingles").mapInArrow(compare, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Those of the pairs (a, b) of rows (node, text) whose sets reach ``similarity``."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return _verified(pairs, docs.join(nodes, "node", "left_semi"), words, similarity).distinct()


def find_links(docs: DataFrame, words: int = 5, similarity: float = 0.8, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) among the rows (node, text) that span the components of all candidate pairs of ``similarity`` and of the
    ``known`` links: what these connect is not compared again."""
    rows = materialize(_keys(docs, words), "bands")
    shared = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("key")
    rows = materialize(rows.join(shared, "key"), "shared-bands")
    texts = materialize(docs.join(rows.select("node").distinct(), "node", "left_semi"), "candidates")
    sized = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")  # else the sets can't be that similar
    links, tried = known, None
    for pick in (F.min, F.max, None):
        if links is None:
            now = rows.withColumn("comp", F.col("node"))
        else:
            roots = components(links, "near-copies")
            now = rows.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("comp"))
        found = [F.count(F.lit(1)).alias("many"), F.sum("n").alias("total")]
        if pick:
            found.append(pick(F.struct("node", "n", "comp")).alias("middle"))
        apart = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), *found).where("low < high").drop("low", "high")
        # rows of a frequent band stay where they are
        now = join_counted(now, materialize(apart.withColumn("n", F.col("many")), "bands-apart"), ["key"]).where("many is not null")
        now = materialize(now, "apart")
        if now.isEmpty():
            break
        if pick is None:
            blocks = materialize(_in_blocks(now.where(F.col("many") > _FEW), texts, words, similarity), "links")
            links, now = links.unionByName(blocks), now.where(F.col("many") <= _FEW)
            left = now.select("key", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"))
            right = now.select("key", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("comp").alias("comp_b"))
            pairs = left.join(right, (left["key"] == right["key"]) & (F.col("comp_a") < F.col("comp_b")) & sized)
        else:
            ends = now.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"), "middle.*")
            ends = ends.withColumnsRenamed({"node": "b", "n": "n_b", "comp": "comp_b"})
            pairs = ends.where((F.col("comp_a") != F.col("comp_b")) & sized)
        # the end that many pairs share is b, the star's middle
        pairs = pairs.select("a", "b").distinct()
        if tried is not None:
            turned = tried.select(F.col("b").alias("a"), F.col("a").alias("b"))
            pairs = pairs.join(tried.unionByName(turned), ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        found = materialize(_verified(pairs, texts, words, similarity), "links")
        links = found if links is None else links.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
    return docs.sparkSession.createDataFrame([], "a long, b long") if links is None else links


def keep_first(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, known=None) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component of near-copies, with all their columns.

    Rows with a null id stay. Null texts count as empty; of the texts without words one id stays. Rows of one id stay or
    go together, whatever their texts. An empty table gives an empty table. ``known`` gives links of the rows (node, text) that are
    already found, by another search.
    """
    rows = docs.select(F.col(ident).cast("long").alias("node"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where("node is not null")
    gone = components(find_links(rows, words, similarity, known(rows) if known else None), "near-copies").select(F.col("node").alias("__gone_id"))
    return docs.join(gone, F.col(ident).cast("long") == F.col("__gone_id"), "left_anti")
