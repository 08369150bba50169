
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Which policies have targets; two in five.
_TARGETED = "l_partkey % 5 < 2"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """policy, level (1-3), year, brand, ptype: the parts that were ever shipped."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.year(F.min("l_shipdate")).alias("year"))
    return table(spark, sf_dir, "part").join(first, F.col("p_partkey") == F.col("l_partkey")).select(
        F.col("p_partkey").alias("policy"), (1 + F.col("p_size") % 3).alias("level"), "year", F.col("p_brand").alias("brand"), F.col("p_type").alias("ptype")
    )


def enterprises(spark: SparkSession, sf_dir: str) -> DataFrame:
    """enterprise, si (sub-industry), mi (major industry), capital."""
    nations = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("enterprise"), F.col("c_nationkey").alias("si"), F.col("n_regionkey").alias("mi"), F.col("c_acctbal").alias("capital"))


def targets(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """policy, si, conf: a policy's share of quantity by supplier nation, the largest ``most``."""
    lines = table(spark, sf_dir, "lineitem").where(_TARGETED).select("l_partkey", "l_suppkey", "l_quantity")
    by = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("l_partkey").alias("policy"), F.col("s_nationkey").alias("si")).agg(F.sum("l_quantity").alias("q"))
    whole = Window.partitionBy("policy")
    ranked = by.withColumn("conf", F.col("q") / F.sum("q").over(whole)).withColumn("k", F.row_number().over(whole.orderBy(F.desc("q"), "si")))
    return ranked.where(F.col("k") <= most).select("policy", "si", "conf")


def transmits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parent, child: the nearest earlier policy of the same brand and type one level up."""
    p = policies(spark, sf_dir).where("brand is not null and ptype is not null")
    earlier = Window.partitionBy("brand", "ptype").orderBy("policy").rangeBetween(Window.unboundedPreceding, -1)  # no pairs are made
    last = lambda level: F.when(F.col("level") == level + 1, F.max(F.when(F.col("level") == level, F.col("policy"))).over(earlier))
    links = p.select(F.col("policy").alias("child"), F.coalesce(*[last(level) for level in range(-1, 3)]).alias("parent"))  # 1 + size % 3, of any sign
    return links.where("parent is not null").groupBy("child").agg(F.max("parent").alias("parent")).select("parent", "child")


def supports(spark: SparkSession, sf_dir: str, targeted: bool = False) -> DataFrame:
    """policy, enterprise: who ordered it, ``targeted`` only of the policies that can have targets. Labels only, never edges of the graph."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").where(_TARGETED if targeted else F.lit(True))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("policy"), F.col("o_custkey").alias("enterprise")).distinct()


def message_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, w over typed keys (P, S, M, E and the id): the graph that scores travel on."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    e = enterprises(spark, sf_dir)
    one = F.lit(1.0).alias("w")
    out = transmits(spark, sf_dir).select(key("P", "parent").alias("src"), key("P", "child").alias("dst"), one)
    out = out.unionByName(targets(spark, sf_dir).select(key("P", "policy").alias("src"), key("S", "si").alias("dst"), F.col("conf").alias("w")))
    out = out.unionByName(e.select(key("E", "enterprise").alias("src"), key("S", "si").alias("dst"), one))
    return out.unionByName(e.select(key("S", "si").alias("src"), key("M", "mi").alias("dst"), one).distinct())


#: The same rules for DuckDB.
SQL = """
policies AS (SELECT p_partkey AS policy, 1 + p_size % 3 AS level, cast(year(min(l_shipdate)) AS INT) AS year, p_brand AS brand, p_type AS ptype FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey, p_size, p_brand, p_type),
enterprises AS (SELECT c_custkey AS enterprise, c_nationkey AS si, n_regionkey AS mi, c_acctbal AS capital FROM customer JOIN nation ON c_nationkey = n_nationkey),
tq AS (SELECT l_partkey AS policy, s_nationkey AS si, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey % 5 < 2 GROUP BY 1, 2),
targets AS (SELECT policy, si, conf FROM (SELECT *, q / sum(q) OVER (PARTITION BY policy) AS conf, row_number() OVER (PARTITION BY policy ORDER BY q DESC, si) AS k FROM tq) WHERE k <= 3),
transmits AS (SELECT max(u.policy) AS parent, p.policy AS child FROM policies p JOIN policies u ON p.brand = u.brand AND p.ptype = u.ptype AND u.policy < p.policy AND u.level = p.level - 1 GROUP BY p.policy),
supports AS (SELECT DISTINCT l_partkey AS policy, o_custkey AS enterprise FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT 'P' || parent AS src, 'P' || child AS dst, 1.0::DOUBLE AS w FROM transmits UNION ALL SELECT 'P' || policy, 'S' || si, conf FROM targets
          UNION ALL SELECT 'E' || enterprise, 'S' || si, 1.0 FROM enterprises UNION ALL SELECT * FROM (SELECT DISTINCT 'S' || si, 'M' || mi, 1.0 FROM enterprises))
"""
