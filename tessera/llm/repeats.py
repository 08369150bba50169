"""Removal of long byte strings that occur more than once, across and within documents.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts anywhere else. Suffixes of the whole corpus
are not sorted: see the README for why, with figures. Instead every window gets an anchor that depends on its bytes
alone, the leftmost K-byte string of least hash in it, so that equal windows have their anchors at equal places, and
only windows with one anchor string need comparing:

1. Count the pieces (anchor string, places of the windows it anchors, hash of the bytes they span). A piece counted
   twice or more is settled: all its windows repeat. An anchor string counted once is settled too: none does.
2. Read the texts again and pick, through two Bloom filters of fixed size, the pieces whose anchor string is shared;
   an exact join then gives each its state. Filters only save rows: what they let through wrongly, the join drops.
3. Where an anchor string has unsettled pieces, one piece of each content is compared with the others of the string,
   window by window. An anchor string with more than ``most_in_task`` contents is compared by shuffling its windows'
   hashes instead, which are combined before they are sent; both ways are exact.
4. The spans of repeated windows are united for each document and cut out of its bytes.

Anchor strings are grouped with 64-bit hashes, and what decides is a further 64-bit hash within the group.
Null text counts as empty. Documents are known by (id, hash of the text), so repeated rows are occurrences of each
other: each then loses every window. Windows never cross documents. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

WINDOW, K = 400, 32
#: Windows seen at a time: long documents go in blocks. Bits of each Bloom filter.
_BLOCK, _BITS = 1 << 20, 1 << 24
#: Bits of a place within a block and the windows that begin in it.
_PLACE = 22
#: Hashes made at a time; bytes of pieces compared at a time.
_CACHED, _COMPARED = 1 << 14, 1 << 22
_KEY = ["km", "dlo", "dhi", "ex"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15)
    x += b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return x


#: A random number for each byte: the hash of a string of one.
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every string of ``size`` bytes (any size), by doubling."""
    if len(data) < size:
        return np.empty(0, np.uint64)
    out = np.empty(len(data) - size + 1, np.uint64)
    for at in range(0, len(out), _CACHED):  # pieces that stay in the processor's cache
        h, n = _BYTES[data[at : at + _CACHED + size - 1]], 1
        while 2 * n <= size:
            h = _join(h[:-n], h[n:])
            n *= 2
        m = min(_CACHED, len(out) - at)
        # two overlapping strings of the largest power that fits
        out[at : at + m] = h[:m] if n == size else _mix(_join(h[:m], h[size - n : size - n + m]))
    return out


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    n = len(h)
    blocks = np.concatenate((h, np.full((-n) % width, np.iinfo(np.uint64).max))).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def pieces(text: bytes, window: int = WINDOW, k: int = K):
    """Yields (anchor hash, first window, last window, anchor place) for all windows of a text, each in one piece."""
    width, low = window - k + 1, np.uint64((1 << _PLACE) - 1)
    for base in range(0, max(len(text) - window + 1, 0), _BLOCK):
        h = string_hashes(np.frombuffer(text, np.uint8)[base : base + _BLOCK + window - 1], k)
        # The place fills the low bits, so the least number is the leftmost of the least hashes.
        at = (window_minima(h & ~low | np.arange(len(h), dtype=np.uint64), width) & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        last = np.concatenate((first[1:], [len(at)])) - 1
        yield from zip(h[at[first]].tolist(), (base + first).tolist(), (base + last).tolist(), (base + at[first]).tolist())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bit_places(km: np.ndarray) -> list[np.ndarray]:
    x = km.astype(np.int64).view(np.uint64)
    return [(_mix(x + np.uint64(i)) % np.uint64(_BITS)).astype(np.int64) for i in range(3)]


def _bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size of the column km: at most _BITS / 64 words come to the driver."""

    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_bit_places(batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.uint64(1) << (at & 63).astype(np.uint64)).cast(pa.uint64()).view(pa.int64())], ["word", "bits"])

    words = keys.select("km").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(_BITS >> 6, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def _inside(filter_words: np.ndarray, km: np.ndarray) -> np.ndarray:
    out = np.ones(len(km), bool)
    for at in _bit_places(km):
        out &= (filter_words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
    return out


def _decided(group: np.ndarray, ctx: list[bytes], dhi: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For contents, sorted by the group of their anchor string: (end of each content's windows, whether each window
    repeats in its group). A content holds the windows dhi, dhi - 1, ... bytes before its anchor, in this order."""
    sizes = np.fromiter(map(len, ctx), np.int64, len(ctx))
    windows, begins = sizes - window + 1, np.concatenate(([0], np.cumsum(sizes)[:-1]))
    ends = np.cumsum(windows)
    step = np.arange(ends[-1]) - np.repeat(ends - windows, windows)
    value = string_hashes(np.frombuffer(b"".join(ctx), np.uint8), window)[np.repeat(begins, windows) + step]
    # Equal windows of a group are equally far from the anchor: both go into the key with the window's hash.
    place = (np.repeat(group.astype(np.uint64) << np.uint64(32), windows)) + (np.repeat(dhi.astype(np.int64), windows) - step).astype(np.uint64)
    found, index = np.unique(_join(_mix(place), value), return_inverse=True)
    return ends, np.bincount(index, np.repeat(n, windows), len(found))[index] >= 2


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


def repeated_spans(docs: DataFrame, window: int = WINDOW, k: int = K, most_in_task: int = 16384) -> DataFrame:
    """(doc_id, h, s, e): byte spans that repeated windows cover. ``docs`` has (doc_id, h, data)."""
    spark = docs.sparkSession
    schema = "km long, dlo int, dhi int, ex long"
    spot = "doc_id long, h long, place long"

    def scan(batch):
        for row, raw in enumerate(batch.column("data")):
            data = raw.as_py() or b""
            for value, first, last, place in pieces(data, window, k):
                yield row, _signed(value), place - last, place - first, _signed(xxhash.xxh3_64_intdigest(data[first : last + window])), place, data, first, last

    def count(batches):
        tally: dict[tuple, int] = {}
        for batch in batches:
            for _, km, lo, hi, ex, *_ in scan(batch):
                tally[km, lo, hi, ex] = tally.get((km, lo, hi, ex), 0) + 1
                if len(tally) >= 1 << 17:
                    yield counted(tally)
                    tally = {}
        if tally:
            yield counted(tally)

    def counted(tally):
        cols = [pa.array(c, t) for c, t in zip(zip(*tally), (pa.int64(), pa.int32(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*cols, pa.array(list(tally.values()), pa.int64())], [*_KEY, "n"])

    contents = docs.select("data").mapInArrow(count, f"{schema}, n long").groupBy(*_KEY).agg(F.sum("n").alias("n"))
    contents = materialize(contents, "pieces")
    shared = contents.groupBy("km").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("total"), F.max(F.col("n") == 1).alias("open"))
    shared = materialize(shared.where("total > 1").select("km", "contents", (F.col("open") & (F.col("contents") > 1)).alias("open")), "anchors")
    filters = spark.sparkContext.broadcast((_bloom(shared), _bloom(shared.where("open"))))

    def pick(batches):
        every, opened = filters.value
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("h").to_pylist()
            rows: list = []

            def flush():
                km = np.array([r[1] for r in rows], np.int64)
                good, more = _inside(every, km), _inside(opened, km)
                out = [(r[1], r[2], r[3], r[4], ids[r[0]], hashes[r[0]], r[5], r[6][r[7] : r[8] + window] if m else None) for r, g, m in zip(rows, good.tolist(), more.tolist()) if g]
                rows.clear()
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                cols = list(zip(*out)) or [[]] * 8
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [*_KEY, "doc_id", "h", "place", "ctx"])

            for row in scan(batch):
                rows.append(row)
                if len(rows) >= 1 << 14:
                    yield flush()
            if rows:
                yield flush()

    states = contents.join(shared, "km").select(*_KEY, "n", "contents", "open")
    states = materialize(states, "states")
    picked = docs.select("doc_id", "h", "data").mapInArrow(pick, f"{schema}, {spot}, ctx binary")
    picked = materialize(picked.join(states, _KEY).withColumn("ctx", F.when(F.col("open"), F.col("ctx"))), "picked")
    settled = picked.where("n > 1").select("doc_id", "h", (F.col("place") - F.col("dhi")).alias("s"), (F.col("place") - F.col("dlo") + window).alias("e"))

    # One row for each content of an open anchor string; equal contents have equal bytes.
    one = picked.where("open").groupBy(*_KEY).agg(F.min(F.struct("doc_id", "h", "place", "ctx", "contents", "n")).alias("r")).select(*_KEY[:3], "r.*")

    def compare(batches):
        kept = None
        for batch in batches:
            kept = batch if kept is None else pa.concat_batches([kept, batch])
            km = kept.column("km").to_numpy()
            last = int(np.searchsorted(km, km[-1]))
            if last:
                yield from compared(kept.slice(0, last))
                kept = kept.slice(last)
        if kept is not None and len(kept):
            yield from compared(kept)

    def compared(batch):
        km = batch.column("km").to_numpy()
        group = np.cumsum(np.concatenate(([0], km[1:] != km[:-1])))
        cols = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("dhi", "n", "doc_id", "h", "place")}
        sizes = pc.binary_length(batch.column("ctx")).to_numpy(zero_copy_only=False)
        # Whole groups at a time, as many as fit: a group has at most most_in_task contents.
        starts, room = np.concatenate(([0], np.flatnonzero(km[1:] != km[:-1]) + 1, [len(km)])), np.concatenate(([0], np.cumsum(sizes)))
        i = 0
        while i < len(starts) - 1:
            j = max(i + 1, int(np.searchsorted(room[starts], room[starts[i]] + _COMPARED, "right")) - 1)
            a, b, out = int(starts[i]), int(starts[j]), []
            i = j
            ends, again = _decided(group[a:b] - group[a], batch.column("ctx").slice(a, b - a).to_pylist(), cols["dhi"][a:b], cols["n"][a:b], window)
            for k in np.flatnonzero((cols["n"][a:b] == 1) & (np.add.reduceat(again, np.concatenate(([0], ends[:-1]))) > 0)).tolist():
                first = int(cols["place"][a + k] - cols["dhi"][a + k])
                for x, y in _runs(again[ends[k - 1] if k else 0 : ends[k]]):
                    out.append((int(cols["doc_id"][a + k]), int(cols["h"][a + k]), first + x, first + y + window))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [[]] * 4)], ["doc_id", "h", "s", "e"])

    def spread(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h = string_hashes(np.frombuffer(row["ctx"], np.uint8), window)
                m = len(h)
                first = row["place"] - row["dhi"]
                cols = [np.full(m, row["km"]), row["dhi"] - np.arange(m), h.view(np.int64), np.full(m, row["n"]), np.full(m, row["doc_id"]), np.full(m, row["h"]), first + np.arange(m)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["km", "d", "v", "n", "doc_id", "h", "s"])

    small = one.where(F.col("contents") <= most_in_task).repartition("km").sortWithinPartitions("km").mapInArrow(compare, "doc_id long, h long, s long, e long")
    loose = one.where(F.col("contents") > most_in_task).mapInArrow(spread, "km long, d long, v long, n long, doc_id long, h long, s long")
    many = loose.groupBy("km", "d", "v").agg(F.sum("n").alias("total")).where("total > 1").select("km", "d", "v")
    large = loose.where("n = 1").join(many, ["km", "d", "v"], "left_semi").select("doc_id", "h", "s", (F.col("s") + window).alias("e"))
    return settled.unionByName(small).unionByName(large)


def _cut(data: bytes, spans) -> tuple[int, int, bytes]:
    """(bytes removed, maximal runs removed, what is left)."""
    runs: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    cuts = [0, *(x for r in runs for x in r), len(data)]
    return sum(e - s for s, e in runs), len(runs), b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def prepared(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    data = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(ident).cast("long").alias("real_id"), F.coalesce(F.col(ident).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.xxhash64(data).alias("h"), data.cast("binary").alias("data"))


def removed(docs: DataFrame, ident: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K, most_in_task: int = 16384, keep_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the bytes left, of every row."""
    rows = prepared(docs, ident, text)
    spans = repeated_spans(rows.drop("real_id"), window, k, most_in_task).groupBy("doc_id", "h").agg(F.collect_list(F.struct("s", "e")).alias("spans"))

    def run(batches):
        for batch in batches:
            out = []
            for ident, raw, spans in zip(batch.column("real_id").to_pylist(), batch.column("data"), batch.column("spans").to_pylist()):
                data = raw.as_py()
                gone, n, left = _cut(data, spans)
                out.append((ident, len(data), gone, n, hashlib.sha256(left).hexdigest(), left if keep_bytes else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 6, types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = rows.join(spans, ["doc_id", "h"], "left").select("real_id", "data", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_bytes else out.drop("kept")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"), keep_bytes=False)


QUERIES = {"op7_repeats": op7_repeats}
ORACLES: dict[str, str] = {}
