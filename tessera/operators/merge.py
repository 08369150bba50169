"""Merging, upserting and deleting nodes and edges of a document graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(value: str, *by: str) -> Column:
    """The distinct values of a group in the order of ``by``; each keeps its first place."""
    keyed = F.struct(*[F.col(b).alias(f"o{i}") for i, b in enumerate(by)], F.col(value).alias("v"))
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(keyed)), lambda s: s["v"]))


def source_cap(ids: Column, most: int, keep: str = "fifo") -> Column:
    """``fifo`` keeps the newest ``most`` ids, ``keep`` the oldest."""
    if most <= 0:
        return F.slice(ids, 1, 0)
    tail = F.when(F.size(ids) > most, F.slice(ids, -most, most)).otherwise(ids)
    return tail if keep == "fifo" else F.slice(ids, 1, most)


def delta_ids(existing: Column, old: Column, new: Column) -> Column:
    """What is left of ``existing`` without the ids that went from old to new, then the ids that came."""
    gone, came = F.array_except(old, new), F.array_except(new, old)
    return F.array_distinct(F.concat(F.filter(existing, lambda x: ~F.array_contains(gone, x)), came))


def vote(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """key, value: the most frequent value; of equal ones the one seen first."""
    by = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__at"))
    best = F.struct(F.col("__n"), (-F.col("__at")).alias("__f"))
    return by.groupBy(key).agg(F.max_by(value, best).alias(value))


def merge_nodes(rows: DataFrame, most: int = 300, keep: str = "fifo", sep: str = "<SEP>") -> DataFrame:
    """entity, entity_type, description, source_ids from rows (entity, entity_type, description, source_id, ts, pos)."""
    first = rows.groupBy("entity", "description").agg(F.min(F.struct("ts", (-F.char_length("description")).alias("l"), "pos")).alias("o"))
    texts = first.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "description"))), lambda s: s["description"]), sep).alias("description"))
    ids = rows.groupBy("entity").agg(ordered("source_id", "pos").alias("s")).select("entity", source_cap(F.col("s"), most, keep).alias("source_ids"))
    return vote(rows, "entity", "entity_type", "pos").join(texts, "entity").join(ids, "entity")


def sorted_pair(df: DataFrame) -> DataFrame:
    """Edges with src <= dst; those from a node to itself go."""
    return df.where("src <> dst").withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def merge_edges(rows: DataFrame) -> DataFrame:
    """src, dst, weight, keywords: undirected edges; weights add up, keywords are the sorted distinct comma tokens."""
    pairs = sorted_pair(rows)
    words = F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.col("keywords"), ","), lambda x: F.trim(x)), lambda x: x != "")))
    tokens = pairs.select("src", "dst", F.explode(words).alias("k")).distinct().groupBy("src", "dst").agg(F.array_join(F.array_sort(F.collect_list("k")), ",").alias("keywords"))
    return pairs.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).join(tokens, ["src", "dst"], "left").fillna("", ["keywords"])


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, entity_type of the endpoints that no node has: they become UNKNOWN ones."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    return ends.join(nodes.select("node"), "node", "left_anti").withColumn("entity_type", F.lit("UNKNOWN"))


def upsert(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key; rows of ``new`` win over those of ``old`` at the same time."""
    both = old.withColumn("__r", F.lit(0)).unionByName(new.withColumn("__r", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("__r"))
    return both.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "__r")


def delete_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that touch a node of ``gone`` (node)."""
    return edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")


def merge_entities(edges: DataFrame, alias: DataFrame) -> DataFrame:
    """Edges (src, dst, weight) with every node of alias (node, target) replaced; parallel edges add up."""
    for end in ("src", "dst"):
        edges = edges.join(alias.select(F.col("node").alias(end), F.col("target").alias("__t")), end, "left").withColumn(end, F.coalesce("__t", end)).drop("__t")
    return sorted_pair(edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def delete_document(items: DataFrame, gone: DataFrame) -> DataFrame:
    """key, left, action of items (key, source): ``delete`` without sources left, ``rebuild`` if some went, else ``keep``."""
    marked = items.select("key", "source").distinct().join(gone.select("source").distinct().withColumn("__g", F.lit(1)), "source", "left")
    n = marked.groupBy("key").agg(F.count(F.when(F.col("__g").isNull(), 1)).alias("left"), F.count("__g").alias("went"))
    return n.select("key", "left", F.when(F.col("left") == 0, "delete").when(F.col("went") > 0, "rebuild").otherwise("keep").alias("action"))


def linear_quota(items: DataFrame, most: int, least: int, by: str = "qid", pos: str = "pos", has: str = "has") -> DataFrame:
    """Items with ``took``: a quota that falls in a straight line from ``most`` to ``least`` along ``pos`` (0, 1, ...), at
    most what an item ``has``; what is left over is dealt again from the front."""
    w = Window.partitionBy(by)
    n = F.count(F.lit(1)).over(w)
    want = F.when(n == 1, F.lit(most)).otherwise(F.bround(F.lit(float(most)) - F.col(pos) * float(most - least) / (n - 1)))
    first = items.withColumn("__w", want.cast("long")).withColumn("__t", F.least("__w", has))
    spare = first.withColumn("__s", F.sum(F.col("__w") - F.col("__t")).over(w)).withColumn("__c", F.col(has) - F.col("__t"))
    before = F.sum("__c").over(w.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")
    return spare.withColumn("took", F.col("__t") + F.greatest(F.lit(0), F.least("__c", F.col("__s") - before))).drop("__w", "__t", "__s", "__c")


def relation_category(triples: DataFrame, cut: float = 1.5) -> DataFrame:
    """r, tph, hpt, category: 1-1, 1-n, n-1 or n-n by tails a head and heads a tail."""
    s = triples.groupBy("r").agg((F.count(F.lit(1)) / F.countDistinct("h")).alias("tph"), (F.count(F.lit(1)) / F.countDistinct("t")).alias("hpt"))
    many = lambda c: F.when(F.col(c) < cut, "1").otherwise("n")
    return s.withColumn("category", F.concat(many("hpt"), F.lit("-"), many("tph")))
