"""SimHash near-duplicates found through anchor points of a covering code.

Fingerprint: every shingle of words votes on 64 bits with its XXH64; a bit is set if it is set in over half of the
shingle hashes. Two fingerprints are linked at ``bits`` or fewer differing bits.

Search: the 64 bits are cut into blocks of 22, 21 and 21. In one block at least, linked fingerprints differ in
t = bits // 3 bits or fewer. Each block's space is covered by the anchors of one code: the perfect [15, 11] Hamming
code on its first 15 bits, all words on the rest. Its covering radius R is 1, so each fingerprint has one home
anchor within R, and is replicated to every anchor within R + t. If x and y are within t, then y is within R + t of
x's home anchor: comparing, per anchor, the fingerprints at home there with all that were sent there finds every
link. Distinct fingerprints are searched, once each. A task reports a spanning forest of the links it finds, not
all pairs of a group; components are then joined by star contraction (common.components).

Null text counts as empty. A text without words has fingerprint zero and is linked like any other. Rows with a
null id take the component of other rows with their fingerprint, or null. Repeated rows share a component.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import components, join_counted, materialize, table

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: (first bit, bits) of each block.
BLOCKS = ((0, 22), (22, 21), (43, 21))
_HAMMING = 15
#: Shingles hashed, and pairs compared, at a time: these bound a task's memory, never what it covers.
_AT_ONCE, _PAIRS = 1 << 16, 1 << 21


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a whole text."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    data, digest = b" ".join(found), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    starts, ends = starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for i in range(0, len(starts), _AT_ONCE):
        hashes = b"".join([digest(data[s:e], seed) for s, e in zip(starts[i : i + _AT_ONCE], ends[i : i + _AT_ONCE])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def with_fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(x, words, seed) for x in texts), np.uint64, len(texts)).view(np.int64))

    return docs.select(F.col(ident).cast("long").alias("doc_id"), fp(F.col(text).cast("string")).alias("fp"))


def _syndromes(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for bit in range(_HAMMING):
        out ^= ((values >> bit) & 1) * (bit + 1)
    return out


def _errors(size: int, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By syndrome: the error patterns of weight up to ``reach`` that lead to an anchor, and which one leads home."""
    patterns: list[tuple[int, int]] = [(0, 0)]
    for weight in range(1, reach + 1):
        patterns += [(e | 1 << b, weight) for e, w in patterns if w == weight - 1 for b in range(e.bit_length(), size)]
    values, weights = np.array([e for e, _ in patterns]), np.array([w for _, w in patterns])
    code, out = _syndromes(values & ((1 << _HAMMING) - 1)), []
    for s in range(_HAMMING + 1):
        mine = np.flatnonzero(code == s)
        home = (values[mine] == (1 << (s - 1) if s else 0)) & (weights[mine] <= 1)
        out.append((values[mine], home))
    return out


def anchors(fps: np.ndarray, bits: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor within covering radius plus threshold of each fingerprint, block by block."""
    rows, keys, homes = [], [], []
    for number, (first, size) in enumerate(BLOCKS):
        part = ((fps >> np.uint64(first)) & np.uint64((1 << size) - 1)).astype(np.int64)
        code = _syndromes(part)
        for s, (patterns, home) in enumerate(_errors(size, 1 + bits // len(BLOCKS))):
            mine = np.flatnonzero(code == s)
            rows.append(np.repeat(mine, len(patterns)))
            keys.append((part[mine][:, None] ^ patterns[None, :] | number << 24).ravel())
            homes.append(np.tile(home, len(mine)))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) that span the same components as the links (a, b)."""
    nodes, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links(batch: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links among rows (anchor, fp, node, home) that are sorted by anchor."""
    key, fp, node, home = batch
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    seg = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64))))
    ends = np.concatenate((starts[1:], [len(key)]))
    at_home = np.flatnonzero(home & (ends - starts > 1)[seg])
    lo, n = starts[seg[at_home]], (ends - starts)[seg[at_home]]
    found_a, found_b, i = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    total = np.cumsum(n)
    while i < len(at_home):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _PAIRS, "right")))
        for part in range(0, int(n[i]) if j == i + 1 else 1, _PAIRS):  # one home row against a very large anchor
            count = np.minimum(n[i:j] - part, _PAIRS)
            left = np.repeat(at_home[i:j], count)
            right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[i:j] + part, count)
            near = (np.bitwise_count(fp[left] ^ fp[right]) <= bits) & (node[left] != node[right])
            if near.any():
                a, b = _forest(np.concatenate((found_a[0], node[left[near]])), np.concatenate((found_b[0], node[right[near]])))
                found_a, found_b = [a], [b]
        i = j
    return found_a[0], found_b[0]


def find_links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Links (a, b) between the nodes of (fp, node), each fp once, that span the components of all links."""

    def replicate(batches):
        for batch in batches:
            fp, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(0, len(fp), 1 << 14):
                row, key, home = anchors(fp[i : i + (1 << 14)].view(np.uint64), bits)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i + row]), pa.array(node[i + row]), pa.array(home)], ["anchor", "fp", "node", "home"])

    def compare(batches):
        kept = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if kept is not None:
                now = [np.concatenate(x) for x in zip(kept, now)]
            last = int(np.searchsorted(now[0], now[0][-1]))  # its rows may go on in the next batch
            kept = [x[last:] for x in now]
            if last:
                yield made(*links((now[0][:last], now[1][:last].view(np.uint64), now[2][:last], now[3][:last]), bits))
        if kept is not None:
            yield made(*links((kept[0], kept[1].view(np.uint64), kept[2], kept[3]), bits))

    def made(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    sent = fps.select("fp", "node").mapInArrow(replicate, "anchor long, fp long, node long, home boolean")
    return sent.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest id that links reach."""
    marked = materialize(with_fingerprints(docs, ident, text, words, seed), "fingerprints")
    fps = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n"))
    fps = materialize(fps, "distinct-fingerprints")
    roots = components(find_links(fps, bits), "simhash")
    named = materialize(fps.join(roots, "node", "left").select("fp", "n", F.coalesce("root", "node").alias("component_id")), "components-by-fingerprint")
    # many rows may have one fingerprint, all empty texts have: those rows stay where they are
    return join_counted(marked, named, ["fp"]).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_links(rows: DataFrame, words: int = 5, bits: int = 4, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) among the rows (node, text): of equal fingerprints or found through anchors, each verified on the whole sets."""
    marked = materialize(with_fingerprints(rows, "node", "text", words), "fingerprints")
    fps = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    same = join_counted(marked, fps.where("n > 1"), ["fp"]).where("node is not null and node <> doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    pairs = materialize(same.unionByName(find_links(fps, bits)).distinct(), "pairs")
    return materialize(near_copies.verified(pairs, rows, words, similarity), "links")


def keep_first(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 5, bits: int = 4, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component of near-copies, with all their columns.

    Near-copies have sets of shingles with a Jaccard similarity of ``similarity`` or more. Those of ``bits`` or fewer differing
    bits are found by their fingerprints (near_links); what these leave apart is searched by min-hashes, as at 0.8 most
    fingerprints differ in more bits. Rows with a null id stay. Null texts count as empty; of the texts without words one id stays. Rows
    of one id stay or go together, whatever their texts. An empty table gives an empty table.
    """
    return near_copies.keep_first(docs, ident, text, words, similarity, lambda rows: near_links(rows, words, bits, similarity))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}
