"""Key-value and graph look-ups by a list of keys, and the work that is left after a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def asked(spark: SparkSession, keys: list, name: str = "key") -> DataFrame:
    """(pos, key) of a caller's list, in its order and with its repeats."""
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, keys))).alias("pos", name))


def get_many(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row for each asked key, in order of pos; nulls where the store has none."""
    return keys.join(store, key, "left")


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


def is_empty(store: DataFrame) -> DataFrame:
    """One row; reads no more than the first row of the store."""
    return store.limit(1).agg((F.count(F.lit(1)) == 0).alias("empty"))


def pair(a: str = "src", b: str = "dst"):
    """The undirected key of an edge."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def edges_of(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (pos, src, dst) with whether the undirected edge is there and its greatest weight."""
    known = edges.groupBy(pair().alias("__pair")).agg(F.max("w").alias("w"))
    return wanted.withColumn("__pair", pair()).join(known, "__pair", "left").select("pos", "src", "dst", F.col("w").isNotNull().alias("there"), "w")


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Undirected edges (src, dst, w): those of ``new`` replace edges between the same nodes."""
    kept = edges.withColumn("__pair", pair()).join(new.select(pair().alias("__pair")).distinct(), "__pair", "left_anti").drop("__pair")
    return kept.select("src", "dst", "w").unionByName(new.select("src", "dst", "w"))


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.withColumn("__pair", pair()).join(gone.select(pair().alias("__pair")).distinct(), "__pair", "left_anti").drop("__pair")


def remaining(work: DataFrame, done: DataFrame, key: str, failed: str = "failed") -> DataFrame:
    """What a resumed run has to do: what is not done, and once more what failed (attempt 2)."""
    first = work.join(done.select(key).distinct(), key, "left_anti").withColumn("attempt", F.lit(1))
    again = work.join(done.where(F.col(failed)).select(key).distinct(), key, "left_semi").withColumn("attempt", F.lit(2))
    return first.unionByName(again)
