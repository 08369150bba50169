"""Normalising, decaying, fusing and cutting scores. Every ranking breaks ties by the item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .select import beside, exact_quantile


def minmax(df: DataFrame, col: str, out: str, by: tuple[str, ...] = (), constant: float = 0.0) -> DataFrame:
    """(x - min) / (max - min); one combined aggregate is joined back, so no group is gathered in one task."""
    stats = df.groupBy(*by).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    wide = df.join(stats, list(by)) if by else df.crossJoin(F.broadcast(stats))  # without keys stats is one row
    scaled = (F.col(col) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    return wide.withColumn(out, F.when(F.col("__hi") > F.col("__lo"), scaled).otherwise(F.lit(constant))).drop("__lo", "__hi")


def log_z_sigmoid(df: DataFrame, col: str, out: str, eps: float = 1e-10) -> DataFrame:
    logged = df.withColumn("__l", F.ln(F.greatest(F.col(col), F.lit(eps))))
    stats = logged.agg(F.avg("__l").alias("__m"), F.stddev_pop("__l").alias("__s"), F.max(col).alias("__x"))
    z = F.when(F.col("__s") < 1e-14, 0.0).otherwise((F.col("__l") - F.col("__m")) / F.col("__s"))
    return logged.crossJoin(F.broadcast(stats)).withColumn(out, F.when(F.col("__x") < eps, 0.5).otherwise(1 / (1 + F.exp(-z)))).drop("__l", "__m", "__s", "__x")


def level_decay(level: Column, gamma: float = 0.8, ref: int = 1) -> Column:
    return F.pow(F.lit(gamma), F.abs(level - ref))


def level_decay_exp(level: Column, beta: float = 0.2, target: int = 2) -> Column:
    return F.exp(-beta * F.abs(level - target))


def time_decay(year: Column, now: int, rate: float = 0.15) -> Column:
    return F.exp(-rate * F.abs(F.lit(now) - year))


def linear_decay(years: Column, levels: Column, rate: float, beta: float) -> Column:
    return F.greatest(F.lit(0.0), 1 - rate * years) * F.greatest(F.lit(0.0), 1 - beta * levels)


def rank(df: DataFrame, by: str = "qid", item: str = "item", score: str = "score") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), item)))


def rank_cut(
    df: DataFrame, quantile: float | None = 0.75, drop: float | None = 0.15, top_k: int | None = None, cap: int | None = 100,
    by: str = "qid", item: str = "item", score: str = "score",
) -> DataFrame:
    """Keeps scores at or over the quantile, up to the first relative drop over ``drop``, then the first top_k and cap.

    The quantile is found by exact_quantile, without gathering a query's list. A drop after the last rank that is kept
    changes nothing, so each task keeps that many rows of a query at most before they meet.
    """
    out = df
    if quantile is not None:
        out = cut(df)  # read once for the quantile and once for the cut
        at = exact_quantile(out, [by], score, quantile, out="__q")
        out = beside(out, at, [by]).where(F.col(score) >= F.col("__q")).drop("__q")
    out = rank(out, by, item, score)
    most = [k for k in (top_k, cap) if k and k > 0]
    if most:
        out = out.where(F.col("rank") <= min(most))
    if drop is not None:
        order = Window.partitionBy(by).orderBy("rank")
        before = F.lag(score).over(order)
        out = out.withColumn("__b", F.when((before > 0) & ((before - F.col(score)) / before > drop), 1).otherwise(0))
        out = out.withColumn("__s", F.sum("__b").over(order)).where("__s = 0").drop("__b", "__s")
    return out


def round_robin(lists: list[DataFrame], by: str = "qid", item: str = "item", pos: str = "pos") -> DataFrame:
    """Interleaves ranked lists, keeps the first occurrence of an item, and ranks again."""
    merged = None
    for k, df in enumerate(lists):
        part = df.select(by, item, (F.col(pos) * len(lists) + k).alias("__at"))
        merged = part if merged is None else merged.unionByName(part)
    first = merged.groupBy(by, item).agg(F.min("__at").alias("__at"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy("__at"))).drop("__at")


def token_budget(df: DataFrame, budget: int, tokens: str = "tokens", by: str = "qid", pos: str = "pos") -> DataFrame:
    upto = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(tokens).over(upto)).where(F.col("used") <= budget)


def metrics(run: DataFrame, qrels: DataFrame, queries: DataFrame, by: str = "qid", item: str = "item") -> DataFrame:
    """precision, recall, f1, ap and ndcg of each query. run: qid, item, rank; qrels: qid, item; both distinct."""
    w = Window.partitionBy(by).orderBy("rank")
    hits = run.join(qrels.withColumn("__g", F.lit(1)), [by, item], "left").withColumn("hit", F.coalesce("__g", F.lit(0)))
    hits = hits.withColumn("cum", F.sum("hit").over(w))
    got = hits.groupBy(by).agg(F.count(F.lit(1)).alias("pred"), F.sum("hit").alias("tp"), F.sum(F.col("hit") * F.col("cum") / F.col("rank")).alias("aps"), F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    true = qrels.groupBy(by).agg(F.count(F.lit(1)).alias("gt"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_ = queries.select(by).join(got, by, "left").join(true, by, "left").select(by, zero("pred").alias("pred"), zero("tp").alias("tp"), zero("gt").alias("gt"), zero("aps").alias("aps"), zero("dcg").alias("dcg"))
    n = F.least("gt", "pred")
    ideal = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))).otherwise(0.0)
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = all_.withColumn("precision", part(F.col("tp"), F.col("pred"))).withColumn("recall", part(F.col("tp"), F.col("gt")))
    out = out.withColumn("f1", part(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("ap", F.col("aps") / F.greatest("gt", F.lit(1))).withColumn("ndcg", part(F.col("dcg"), ideal)).drop("aps", "dcg")
