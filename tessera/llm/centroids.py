"""Clustering of integer vectors around centroids (Lloyd's rounds), exact at every magnitude.

Each component x becomes the integer floor(scale * x). A task takes the vectors of an Arrow batch as one float64
matrix X and gets all squared distances to the centroids C from |x|^2 - 2 x.c + |c|^2 with one matrix product. That is
exact while every partial sum is an integer below 2^53, whatever the order in which BLAS adds: with components below
``bound(dim)`` on both sides, dim * (|x| + |c|)^2 stays below it. Rows and centroids beyond that bound are compared with
integers instead: 64-bit ones while they can't overflow, Python's beyond. Sums of a cluster are exact integers too; a
task adds up its batches, and RDD.treeAggregate combines the sums of tasks (k x (dim + 1) numbers) in a tree, so the
driver gets a few of them however many tasks there are. Centroids are sent to tasks in their closure: k x dim integers.

Kept are vectors with exactly ``dim`` components, none null, NaN or infinite; a null vector is left out. A null id takes
part but starts no centroid; if no vector can start one, there are no rows. Rows that repeat an id are vectors of their own; those of equal hash start centroids in the
order of their components. With fewer vectors than ``k`` there are as many centroids as vectors. Distances or sums
beyond a long are null. An empty table gives no rows. Ids are cast to long.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Rows of a matrix product: this bounds a task's memory, never what it covers.
_AT_ONCE = 1 << 13
_LONG = 1 << 63


def bound(dim: int, bits: int = 53) -> int:
    """The largest power of two B with dim * (B + B)^2 <= 2^(bits - 1)."""
    return 1 << max(0, (bits - 1 - math.ceil(math.log2(max(dim, 1)))) // 2 - 1)


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as float64 where that is exact, else as Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(scale))
    if not y.size or np.abs(y).max() < 1 << 53:
        return y
    out = np.empty(x.shape, object)
    for at, v in np.ndenumerate(x):
        top, bottom = float(v).as_integer_ratio()
        out[at] = top * scale // bottom
    return out


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances by whole numbers: 64-bit ones if all fit, else Python's."""
    most = max(int(np.abs(x).max()), int(np.abs(c).max()))
    kind = np.int64 if most < bound(x.shape[1], 63) else object
    x, c = _whole(x, kind), _whole(c, kind)
    out = np.zeros((len(x), len(c)), kind)
    for k in range(len(c)):
        out[:, k] = ((x - c[k]) ** 2).sum(axis=1)
    return out


def _whole(x: np.ndarray, kind) -> np.ndarray:
    if kind is object and x.dtype != object:
        return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return x.astype(kind)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``x`` to each row of ``c``: float64 if all come from the product, else objects."""
    least = bound(x.shape[1])
    low_x, low_c = (np.abs(x) < least).all(axis=1), (np.abs(c) < least).all(axis=1)
    xs, cs = x[low_x].astype(np.float64), c[low_c].astype(np.float64)
    near = (xs * xs).sum(axis=1)[:, None] - 2.0 * (xs @ cs.T) + (cs * cs).sum(axis=1)[None, :]
    if low_x.all() and low_c.all():
        return near
    out = np.empty((len(x), len(c)), object)
    out[np.ix_(low_x, low_c)] = near.astype(np.int64)
    for rows, columns in ((low_x, ~low_c), (~low_x, np.ones(len(c), bool))):
        if rows.any() and columns.any():
            out[np.ix_(rows, columns)] = _apart(x[rows], c[columns]).astype(object)
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance); the smaller number of equally near ones."""
    far = distances(x, c)
    at = far.argmin(axis=1)
    return at, far[np.arange(len(x)), at]


def sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """k x (dim + 1) Python integers: the componentwise sums and the number of the rows of each cluster."""
    out = np.zeros((k, x.shape[1] + 1), object)
    # 2^13 rows below 2^53 each overflow no long only below 2^50; larger ones are objects or take the slow sum
    x = x if x.dtype == object else x.astype(np.int64) if not x.size or np.abs(x).max() < 1 << 49 else _whole(x, object)
    for j in np.unique(at):
        mine = x[at == j]
        out[j, :-1] = [int(v) for v in mine.sum(axis=0)]
        out[j, -1] = len(mine)
    return out


def kept(vectors: DataFrame, ident: str, vector: str, dim: int) -> DataFrame:
    """(vec_id, x) of the vectors that take part."""
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return rows.where((F.size("x") == dim) & ~odd)


def _blocks(batches, dim: int, scale: int):
    for batch in batches:
        for low in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(low, _AT_ONCE)
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield part.column("vec_id"), quantised(x, scale)


def _first(rows: DataFrame, k: int, seed: int, scale: int) -> np.ndarray | None:
    """The vectors with the k smallest hashes of ``<seed>:<vec_id>``, in their order; k rows come to the driver."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    found = rows.where("vec_id is not null").select(mark.alias("mark"), "x").orderBy("mark", "x").limit(k).collect()
    return quantised(np.array([r["x"] for r in found], np.float64), scale) if found else None


def _round(rows: DataFrame, c: np.ndarray, dim: int, scale: int) -> np.ndarray:
    """The next centroids."""

    def added(batches):
        total = np.zeros((len(c), dim + 1), object)
        for _, x in _blocks(batches, dim, scale):
            total = total + sums(x, nearest(x, c)[0], len(c))
        yield pa.RecordBatch.from_arrays([pa.array([[str(v) for v in total.ravel()]])], ["total"])

    def plus(a, b):
        return [x + y for x, y in zip(a, b)]

    parts = rows.mapInArrow(added, "total array<string>").rdd
    total = parts.treeAggregate([0] * (len(c) * (dim + 1)), lambda a, row: plus(a, map(int, row["total"])), plus, 2)
    total = np.array(total, object).reshape(len(c), dim + 1)
    new = _whole(c, object)
    for j in np.flatnonzero(total[:, -1] > 0):
        new[j] = total[j, :-1] // total[j, -1]
    return new


def _narrow(c: np.ndarray) -> np.ndarray:
    return c.astype(np.float64) if int(np.abs(c).max()) < 1 << 53 else c


def cluster(
    vectors: DataFrame, k: int = 16, rounds: int = 3, ident: str = "vec_id", vector: str = "embedding", dim: int = 64, scale: int = 64, seed: int = 1
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector."""
    rows = kept(vectors, ident, vector, dim)
    c = _first(rows, k, seed, scale)
    spark = rows.sparkSession
    if c is None:  # nothing can start a centroid
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        c = _narrow(_round(rows, c, dim, scale))
    last = c

    def assign(batches):
        for ids, x in _blocks(batches, dim, scale):
            at, far = nearest(x, last)
            far = [int(v) if v < _LONG else None for v in far.tolist()]
            yield pa.RecordBatch.from_arrays([pc.cast(ids, pa.int64()), pa.array(at, pa.int32()), pa.array(far, pa.int64())], ["vec_id", "cluster", "distance"])

    # 20 bytes a vector are written, so that sums need no other pass over the vectors
    found = materialize(rows.mapInArrow(assign, "vec_id long, cluster int, distance long"), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    each = found.groupBy("cluster").agg(exact.alias("total"), F.count(F.lit(1)).alias("n"), F.count("distance").alias("known")).collect()
    known = {r["cluster"]: int(r["total"]) for r in each if r["n"] == r["known"]}
    fits = lambda v: v if v is not None and v < _LONG else None
    whole = fits(sum(known.values())) if len(known) == len(each) else None
    digest = lambda row: hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest()
    named = [(j, fits(known.get(j)), whole, digest(row)) for j, row in enumerate(_whole(last, object))]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    far = "list_sum(list_transform(range(1, {d}), lambda j: (v.x[j] - c.x[j]) * (v.x[j] - c.x[j])))".format(d=dim + 1)
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x
        FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, x
        FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT r, vec_id, x, arg_min(k, (d, k)) AS k, min(d)::BIGINT AS d
        FROM (SELECT v.r, v.vec_id, v.x, c.k, {far} AS d FROM v, c{i} c) GROUP BY r, vec_id, x)"""
        )
        if i < rounds:
            steps.append(
                f"""s{i} AS (SELECT k, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, {dim + 1}) t(j) GROUP BY k, j)"""
            )
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN
        (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM s{i} GROUP BY k) m USING (k))"""
            )
    return "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
       (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (k)"""


QUERIES = {"op11_centroids": op11_centroids}
ORACLES = {"op11_centroids": _sql()}
