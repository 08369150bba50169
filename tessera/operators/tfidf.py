"""Search by tf-idf cosines: the exact k best without joining the lists of common terms.

A text's score is the sum over shared terms of two weights, so a term adds at most the query's weight times the greatest
weight that any text gives it. Rare terms are joined first; the k-th best of what they find is a score to beat. The
commonest terms whose bounds together stay below it can't make a text win alone: texts need one of the other terms to be
looked at, and those found are then scored on all terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .rank import rank


def weights(texts: DataFrame, item: str = "item", text: str = "text", pattern: str = "[^a-z0-9]+") -> DataFrame:
    """item, term, w: tf * (ln((1 + n) / (1 + df)) + 1) of lower-case terms, each text's of length one."""
    terms = texts.select(F.col(item).alias("item"), F.explode(F.split(F.lower(F.col(text)), pattern)).alias("term")).where("term <> '' and item is not null")
    tf = cut(terms.groupBy("item", "term").agg(F.count(F.lit(1)).alias("tf")))
    n = tf.agg(F.count_distinct("item").alias("n"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(df, "term").crossJoin(F.broadcast(n)).select("item", "term", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    size = raw.groupBy("item").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    return raw.join(size, "item").select("item", "term", (F.col("w") / F.col("size")).alias("w"))


def _meet(asked: DataFrame, lists: DataFrame, block: int) -> DataFrame:
    """qid, item: texts that have one of the terms asked for. A term's list is dealt out in parts of some ``block`` texts, to
    each of which the queries of the term go."""
    parts = F.ceil(F.col("df") / block).cast("int")
    left = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = lists.withColumn("part", F.pmod(F.xxhash64("item"), parts).cast("int"))
    return left.select("qid", "term", "part").join(right.select("item", "term", "part"), ["term", "part"]).where("qid <> item").select("qid", "item").distinct()


def _scored(pairs: DataFrame, asked: DataFrame, lists: DataFrame) -> DataFrame:
    """qid, item, score of the pairs, over all terms."""
    wide = pairs.join(asked.select("qid", "term", "v"), "qid").join(lists.select("item", "term", "w"), ["item", "term"])
    return wide.groupBy("qid", "item").agg(F.round(F.sum(F.col("v") * F.col("w")), 9).alias("score"))


def search(queries: DataFrame, texts: DataFrame, k: int, first: int = 1000, block: int = 10_000) -> DataFrame:
    """qid, item, score: for each query the ``k`` texts of greatest cosine over 0, itself left out; of equal ones the
    lesser item. queries: (qid, term, v), texts: (item, term, w), as ``weights`` gives them.

    ``first``: how many texts the rarest terms of a query are to list before the score to beat is taken; it changes the work,
    never the result. Scores are rounded to nine digits.
    """
    about = texts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("most"))
    lists = cut(texts.join(about, "term"))
    asked = cut(queries.join(about, "term").withColumn("bound", F.col("v") * F.col("most")))
    rarest = Window.partitionBy("qid").orderBy("df", "term")
    before = F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, 0)) - F.col("df")
    begin = asked.withColumn("before", before).where(F.col("before") < first)
    some = _scored(cut(_meet(begin, lists, block)), asked, lists)
    beat = rank(some).where(F.col("rank") == k).select("qid", F.col("score").alias("beat"))
    # from the commonest term on: the bounds of a term and of all commoner ones
    commonest = Window.partitionBy("qid").orderBy(F.desc("df"), F.desc("term"))
    reach = asked.withColumn("reach", F.sum("bound").over(commonest.rowsBetween(Window.unboundedPreceding, 0))).join(beat, "qid", "left")
    need = reach.where(F.col("beat").isNull() | (F.col("reach") >= F.col("beat") - 1e-8))  # sums are rounded
    found = _scored(cut(_meet(need, lists, block)), asked, lists).where("score > 0")
    return rank(found).where(F.col("rank") <= k).drop("rank")
