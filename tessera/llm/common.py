"""What the text operators share: shared-folder tables, joins that hold against hot keys, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words here.
SPACES = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master that names none (tests) gets one of its own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def give_back() -> None:
    """Returns freed memory to the system, at the end of a task in a Python worker. Workers live on between stages, and the C
    library would keep what they have freed beside the heap that the next stage needs."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


_WRITTEN: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as a table in the shared folder and reads it back. Lost executors cost nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes what materialize() wrote in this process. Results that still read those tables must be stored first."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], least: int = 500, most: int = 10_000) -> DataFrame:
    """``rows`` left joined with ``counted``, a table with one row for each value of ``keys`` and their number n in rows.

    Keys that at least ``least`` rows have, the ``most`` most frequent of them at most, are sent to the rows; those rows
    are then dealt out by their content, not by the key. So no task of the join gets more rows of one key than the
    cut, which is ``least`` or, where more keys are that frequent, the ``most``-th largest number at most. Keys must
    not be null.
    """
    level = (F.log2(F.col("n").cast("double")) * 16).cast("int")
    sizes = counted.where(F.col("n") >= least).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("keys"), F.min("n").alias("n")).collect()
    total, cut = 0, 1 << 62
    for row in sorted(sizes, key=lambda r: -r["level"]):  # at most some thousand levels
        total += row["keys"]
        if total > most:
            break
        cut = row["n"]
    values = F.struct(*[c for c in counted.columns if c not in (*keys, "n")])
    dealt = F.pmod(F.xxhash64(*rows.columns, F.spark_partition_id()), F.lit((1 << 31) - 1)) + 1
    marked = rows.join(F.broadcast(counted.where(F.col("n") >= cut).select(*keys, values.alias("__hot"))), keys, "left")
    marked = marked.withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(0).cast("long")).otherwise(dealt))
    rest = counted.where(F.col("n") < cut).select(*keys, F.lit(0).cast("long").alias("__salt"), values.alias("__rest"))
    joined = marked.join(rest, [*keys, "__salt"], "left").withColumn("__rest", F.coalesce("__hot", "__rest"))
    return joined.select(*rows.columns, "__rest.*")


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """Connected components of the links (a, b), as (node, root); root is the least node that can be reached.

    Alternates large-star and small-star steps: each moves links nearer to the least node, and the number of
    steps grows with the logarithm of the longest path. Minima are combined before the shuffle. Where they are joined
    back, the links of a node with many of them come to one partition of the shuffle, which adaptive execution reads in
    several tasks (its skew join; the side of the minima has one row a node). Self links and nulls are ignored; nodes
    without a link are absent.
    """
    state = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = state(links)
    for _ in range(most):
        if not seen["n"]:
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = materialize(small.where("u <> v").distinct(), name)
        now = state(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    return links.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
