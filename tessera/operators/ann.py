"""Approximate nearest vectors by an inverted-file index that is kept as tables.

Centroids are fitted on a bounded sample, every row is put into the list of its nearest centroid, and a query reads the
lists of its ``probes`` nearest centroids only. With as many probes as lists the answer is the exact one.

    folder/centroids   list, v                 one row a list
    folder/postings    list=.../ item, v       every row; a folder a list, so that lists nobody asks for aren't read
    folder/lists       list, n                 how many rows a list has
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import nearest as N
from tessera.operators import rank as R


@dataclass
class Index:
    centroids: np.ndarray  # lists x dimensions, of length one
    postings: DataFrame
    lists: DataFrame

    def rows_read(self, queries: DataFrame, probes: int) -> int:
        """How many of the indexed rows a search reads: those of the lists that any of the queries probes."""
        wanted = probed(self, queries, probes).select("list").distinct()
        return self.lists.join(wanted, "list", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def sampled(rows: DataFrame, sample: int) -> np.ndarray:
    """Some ``sample`` vectors, twice as many at most, chosen by the hash of their rows: the same ones in every run."""
    n = rows.count()
    share = min(1.0, sample / max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64("item", "v"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    found = chosen.select("v").limit(2 * sample).collect()
    return N.matrix(r["v"] for r in found) if found else np.empty((0, 0))  # of no dimension


def fit(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Centroids of length one by rounds of assignment and averaging; lists that run empty start again at the vectors
    that are farthest from their centroid."""
    x, some = N._unit(x)
    if not some.any():
        return np.zeros((1, x.shape[1]))
    x = x[some]
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = x @ c.T
        at = near.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        count = np.bincount(at, minlength=len(c))
        empty = np.flatnonzero(count == 0)
        if len(empty):
            total[empty] = x[np.argsort(near.max(axis=1), kind="stable")[: len(empty)]]
        c = N._unit(total)[0]
    return c


def build(rows: DataFrame, folder: str, lists: int, sample: int = 16_384, rounds: int = 10) -> Index:
    """Indexes all rows (item, v) in ``folder``. The driver holds up to 2 * ``sample`` vectors while it fits, and each
    task the ``lists`` centroids. A vector of length 0 goes to the first list; null vectors are left out."""
    rows = rows.where("item is not null and v is not null").select("item", F.col("v").cast("array<double>").alias("v"))
    spark = rows.sparkSession
    x = sampled(rows, sample)
    c = fit(x, lists, rounds)

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                at = (N.matrix(batch.column("v").to_pylist()) @ c.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("item"), batch.column("v")], ["list", "item", "v"])

    put = rows.select("item", "v").mapInArrow(assign, "list int, item long, v array<double>")
    # a list that is large is written by several tasks
    put.hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{folder}/postings")
    of = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "list int, v array<double>")
    of.coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    stored = _postings(spark, folder)
    stored.groupBy("list").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{folder}/lists")
    return load(spark, folder)


def _postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("item long, v array<double>, list int").parquet(f"{folder}/postings")


def load(spark: SparkSession, folder: str) -> Index:
    found = spark.read.parquet(f"{folder}/centroids").orderBy("list").collect()  # one row a list
    return Index(N.matrix(r["v"] for r in found), _postings(spark, folder), spark.read.schema("list int, n long").parquet(f"{folder}/lists"))


def probed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """qid, q, list, pos: the ``probes`` lists whose centroids are nearest to each query, from pos 0 on; of equally near ones
    the first."""
    c = index.centroids
    probes = min(probes, len(c))

    def pick(batches):
        for batch in batches:
            if batch.num_rows:
                q = N.matrix(batch.column("q").to_pylist())
                near = q @ c.T if c.size else np.zeros((len(q), len(c)))  # an empty index has a list without dimensions
                at = np.argsort(-near, axis=1, kind="stable")[:, :probes].astype(np.int32)
                row = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                pos = pa.array(np.tile(np.arange(probes, dtype=np.int32), batch.num_rows))
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(row), batch.column("q").take(row), pa.array(at.ravel()), pos], ["qid", "q", "list", "pos"])

    asked = queries.where("qid is not null and q is not null").select("qid", F.col("q").cast("array<double>").alias("q"))
    return asked.mapInArrow(pick, "qid long, q array<double>, list int, pos int")


def search(index: Index, queries: DataFrame, k: int, probes: int, least: float = -math.inf, block: int = 4096, measure: str = "cosine") -> DataFrame:
    """qid, item, score as nearest.top_k, of the rows in the lists that each query (qid, q) probes.

    A list and its queries meet in blocks: a list of many rows, or one that many queries probe, is split over tasks. The
    tables that are sent to all tasks have a row for each list.
    """
    asks = probed(index, queries, probes)
    sizes = asks.groupBy("list").agg(F.count(F.lit(1)).alias("asked")).join(index.lists, "list")
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    sizes = F.broadcast(sizes.select("list", parts("asked").alias("as"), parts("n").alias("bs")))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(sizes, "list").select("list", own("qid", "as").alias("a"), every("bs").alias("b"), "qid", "q")
    right = index.postings.join(sizes, "list").select("list", every("as").alias("a"), own("item", "bs").alias("b"), "item", "v")
    by = ("list", "a", "b")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(N.best_of(k, least, measure), N.scores_schema(asks, index.postings))
    return R.rank(found).where(F.col("rank") <= k).drop("rank")


def probes_for(index: Index, queries: DataFrame, rows: DataFrame, k: int, target: float, sample: int = 64) -> tuple[int, float]:
    """(probes, recall): the fewest probes by which the exact ``k`` neighbours of some ``sample`` queries, chosen by their hash, are
    found at ``target`` or more, and what they find. One exact search of the sample gives the recall for every number."""
    some = queries.orderBy(F.xxhash64("qid"), "qid").limit(sample)
    near = N.top_k(some, rows, k).join(index.postings.select("item", "list"), "item")
    at = near.join(probed(index, some, len(index.centroids)).select("qid", "list", "pos"), ["qid", "list"])
    counts = dict(at.groupBy("pos").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a list at most
    total, found = sum(counts.values()), 0
    for pos in range(len(index.centroids)):
        found += counts.get(pos, 0)
        if total and found >= target * total:
            return pos + 1, found / total
    return len(index.centroids), 1.0


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: queries, and the mean share of a query's exact neighbours (qid, item) that were found."""
    hits = exact.select("qid", "item").join(found.select("qid", "item", F.lit(1).alias("hit")), ["qid", "item"], "left")
    each = hits.groupBy("qid").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
    return each.agg(F.count(F.lit(1)).alias("queries"), F.avg("share").alias("recall"))
