"""A distributed difference-cover suffix array, and the repeats that adjacent suffixes show.

Positions 1 and 2 mod 3 are the sample: their triples are sorted and named, and while names repeat the string of names
is ranked by the same steps (2/3 of the length). The other positions are ranked by their character and the rank of the
suffix after it. Two sorts, one with each half of the sample, count how many suffixes of the other class come before
each suffix; those counts add up to the merged rank, so no comparator of its own is needed. Sorting keys are unique
(they end in a rank), so ranges are even whatever the text holds. Every sort is a range partition; only the size of each
range is summed up in one place. Each level is written to the shared folder.

Texts are UTF-8 bytes (null: empty), joined with an end mark after each. Empty tables give no rows.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Positions in a block within which neighbours are found; ranges of a sort.
BLOCK, RANGES = 1 << 14, 64


def after(seq: DataFrame, columns: list[str], reach: int, at: str = "pos") -> DataFrame:
    """``seq`` with c1 .. c<reach> for each column c: its values at the next positions, 0 past the end. ``at`` is dense."""
    block = F.floor(F.col(at) / BLOCK)
    own = seq.withColumn("__b", block).withColumn("__own", F.lit(True))
    edge = seq.where((F.col(at) % BLOCK < reach) & (F.col(at) >= BLOCK)).withColumn("__b", block - 1).withColumn("__own", F.lit(False))
    w = Window.partitionBy("__b").orderBy(at)
    ahead = {f"{c}{i}": F.lead(c, i, 0).over(w) for c in columns for i in range(1, reach + 1)}
    return own.unionByName(edge).withColumns(ahead).where("__own").drop("__b", "__own")


def placed(df: DataFrame, keys: list[str], ones: Column, name: str) -> DataFrame:
    """``df`` with n, its place from 1 in the order of ``keys``, and z, how many rows with ``ones`` come up to it."""
    ranged = materialize(df.withColumn("__one", ones.cast("long")).repartitionByRange(RANGES, *keys).withColumn("__p", F.spark_partition_id()), name)
    sizes = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"), F.sum("__one").alias("__z"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__bn"), F.coalesce(F.sum("__z").over(before), F.lit(0)).alias("__bz"))
    w = Window.partitionBy("__p").orderBy(*keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({"n": F.row_number().over(w), "z": F.sum("__one").over(upto)})
    joined = own.join(F.broadcast(base), "__p")  # at most RANGES rows
    return joined.withColumns({"n": F.col("n") + F.col("__bn"), "z": F.col("z") + F.col("__bz")}).drop("__p", "__one", "__bn", "__bz")


def ranks(seq: DataFrame, n: int, level: int = 0) -> DataFrame:
    """(pos, rank): the place from 1 of each suffix of seq (pos dense from 0, v of at least 1), of length n."""
    mark = n % 3 == 1  # the last triple of the first half must end in a mark
    if mark:
        seq, n = seq.unionByName(seq.sparkSession.range(1).select(F.lit(n).cast("long").alias("pos"), F.lit(0).cast("long").alias("v"))), n + 1
    triples = materialize(after(seq, ["v"], 2), f"sa-triples-{level}")
    sample = triples.where("pos % 3 <> 0")
    names = placed(sample.select("v", "v1", "v2").distinct(), ["v", "v1", "v2"], F.lit(0), f"sa-names-{level}")
    named = materialize(sample.join(names.select("v", "v1", "v2", F.col("n").alias("name")), ["v", "v1", "v2"]).select("pos", "name"), f"sa-named-{level}")
    count, kinds = named.agg(F.count(F.lit(1)), F.coalesce(F.max("name"), F.lit(0))).first()
    if kinds < count:
        half = (n + 1) // 3  # positions that are 1 mod 3
        at = F.when(F.col("pos") % 3 == 1, F.floor(F.col("pos") / 3)).otherwise(half + F.floor(F.col("pos") / 3))
        inner = ranks(named.select(at.cast("long").alias("pos"), F.col("name").alias("v")), count, level + 1)
        back = F.when(F.col("pos") < half, F.col("pos") * 3 + 1).otherwise((F.col("pos") - half) * 3 + 2)
        known = inner.select(back.alias("pos"), F.col("rank").alias("r"))
    else:
        known = named.select("pos", F.col("name").alias("r"))
    full = triples.select("pos", "v", "v1").join(known, "pos", "left").fillna(0, ["r"])
    full = materialize(after(full, ["r"], 2), f"sa-full-{level}")
    zero = F.col("pos") % 3 == 0
    a = placed(full.where("pos % 3 <> 2").select("pos", "v", "r1", "r"), ["v", "r1"], zero, f"sa-a-{level}")
    b = placed(full.where("pos % 3 <> 1").select("pos", "v", "v1", "r2", "r"), ["v", "v1", "r2"], zero, f"sa-b-{level}")
    parts = a.select("pos", F.when(zero, F.col("n") - F.col("z")).otherwise(F.col("r") + F.col("z")).alias("rank"))
    parts = parts.unionByName(b.select("pos", F.when(zero, F.col("n")).otherwise(F.col("r") + F.col("z")).alias("rank")))
    out = parts.groupBy("pos").agg(F.sum("rank").alias("rank"))
    if mark:
        out = out.where(F.col("pos") < n - 1).select("pos", F.col("rank") - 1)
    return materialize(out.toDF("pos", "rank"), f"sa-ranks-{level}")


def joined(docs: DataFrame, width: int, text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(rows, bytes, length). rows: row, base, size and the columns of docs. bytes: pos, v and the digest of the ``width``
    bytes from there, null where the text ends before."""
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "sa-rows")
    size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)) + 1
    sizes = rows.select("__row", size.cast("long").alias("__size"), F.shiftright("__row", 33).alias("__p"))
    whole = sizes.groupBy("__p").agg(F.sum("__size").alias("__s"))
    base = whole.select("__p", (F.sum("__s").over(Window.orderBy("__p")) - F.col("__s")).alias("__b"))  # one row for each file
    upto = Window.partitionBy("__p").orderBy("__row")
    at = sizes.join(base, "__p").select("__row", "__size", (F.col("__b") + F.sum("__size").over(upto) - F.col("__size")).alias("__base"))
    rows = rows.join(at, "__row")

    def run(batches):
        for batch in batches:
            for begin, t in zip(batch["__base"], batch["t"]):
                data = (t or "").encode("utf-8", "surrogatepass")
                for i in range(0, len(data) + 1, 1 << 16):
                    stop = min(i + (1 << 16), len(data) + 1)
                    digests = [xxhash.xxh3_128_digest(data[k : k + width]) if k + width <= len(data) else None for k in range(i, stop)]
                    values = [x + 2 for x in data[i:stop]] + [1] * (stop > len(data))
                    yield pd.DataFrame({"pos": range(begin + i, begin + stop), "v": values, "digest": digests})

    marks = rows.select("__base", F.col(text).cast("string").alias("t")).mapInPandas(run, "pos long, v long, digest binary")
    return rows, materialize(marks, "sa-bytes"), int(whole.agg(F.coalesce(F.sum("__s"), F.lit(0))).first()[0])


def repeated(docs: DataFrame, width: int = 400, text: str = "text") -> DataFrame:
    """(pos, base): the starts of ``width`` bytes that also start elsewhere, and where the text begins in the whole."""
    rows, marks, length = joined(docs, width, text)
    ranked = ranks(marks.select("pos", "v"), length)
    seq = ranked.join(marks.select("pos", "digest"), "pos").select((F.col("rank") - 1).alias("at"), "pos", F.coalesce("digest", F.lit(b"")).alias("d"))
    # Equal prefixes are neighbours in the order of suffixes, so a look at the next one suffices, both ways.
    w = Window.partitionBy(F.floor(F.col("at") / BLOCK)).orderBy("at")
    edge = seq.where(F.col("at") % BLOCK == 0).select((F.col("at") - 1).alias("at"), F.col("d").alias("next"))
    first = seq.where(F.col("at") % BLOCK == BLOCK - 1).select((F.col("at") + 1).alias("at"), F.col("d").alias("last"))
    near = seq.withColumns({"n": F.lead("d").over(w), "l": F.lag("d").over(w)}).join(edge, "at", "left").join(first, "at", "left")
    same = (F.col("d") == F.coalesce("n", "next")) | (F.col("d") == F.coalesce("l", "last"))
    return near.where((F.octet_length("d") > 0) & same).select("pos")
