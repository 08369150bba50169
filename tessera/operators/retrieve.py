"""Retrieval over entity, relation and chunk hits: one plan for each mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import degrees
from .rank import round_robin

MODES = ("local", "global", "hybrid", "naive", "mix", "bypass")


def _ranked(df: DataFrame, item, *order) -> DataFrame:
    return df.select("qid", item.alias("item"), F.row_number().over(Window.partitionBy("qid").orderBy(*order)).alias("pos"))


def edge_key(a: str = "src", b: str = "dst"):
    return F.concat_ws("|", a, b)


def incident(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, item, pos: the edges at the hit nodes, by the sum of degrees and then the weight, both falling."""
    g = degrees(edges)
    at = lambda end: g.select(F.col("node").alias(end), F.col("degree").alias(f"g_{end}"))
    hit = lambda end: edges.join(nodes.select("qid", F.col("item").alias(end)), end).select("qid", "src", "dst", "w")
    near = hit("src").unionByName(hit("dst")).groupBy("qid", "src", "dst").agg(F.max("w").alias("w"))
    wide = near.join(at("src"), "src").join(at("dst"), "dst").withColumn("g", F.col("g_src") + F.col("g_dst"))
    return _ranked(wide, edge_key(), F.desc("g"), F.desc("w"), "src", "dst")


def endpoints(relations: DataFrame) -> DataFrame:
    """qid, item, pos: the ends of the hit relations (qid, src, dst, pos) in the order in which they are first seen."""
    ends = relations.select("qid", "pos", F.posexplode(F.array("src", "dst")).alias("end", "item"))
    first = ends.groupBy("qid", "item").agg(F.min(F.struct("pos", "end")).alias("o"))
    return _ranked(first, F.col("item"), "o")


def source_chunks(hits: DataFrame, held: DataFrame) -> DataFrame:
    """qid, item, pos: the chunks that hold the hits (qid, item, pos), by the number held and then the best hit."""
    n = hits.join(held, "item").groupBy("qid", "chunk").agg(F.countDistinct("item").alias("n"), F.min("pos").alias("p"))
    return _ranked(n, F.col("chunk"), F.desc("n"), "p", "chunk")


def search(
    mode: str, nodes: DataFrame | None, relations: DataFrame | None, chunks: DataFrame | None, edges: DataFrame | None, held: DataFrame | None, most: int = 40
) -> DataFrame:
    """qid, kind (entity, relation, chunk), item, pos of one of the ``MODES``.

    nodes (qid, item, pos), relations (qid, src, dst, pos) and chunks (qid, item, pos) are the hits of the vector
    searches; edges (src, dst, w) the graph; held (item, chunk) the chunks of an entity or of a relation ``src|dst``.
    local starts at the nodes, global at the relations, hybrid interleaves both, mix adds the chunk hits, naive gives
    only these, bypass nothing. What a mode doesn't use may be None.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    hit_edges = None if relations is None else relations.select("qid", edge_key().alias("item"), "pos")
    parts: dict[str, list[DataFrame]] = {"entity": [], "relation": [], "chunk": []}
    if mode in ("local", "hybrid", "mix"):
        parts["entity"].append(nodes)
        parts["relation"].append(incident(nodes, edges))
        parts["chunk"].append(source_chunks(nodes, held))
    if mode in ("global", "hybrid", "mix"):
        parts["entity"].append(endpoints(relations))
        parts["relation"].append(hit_edges)
        parts["chunk"].append(source_chunks(hit_edges, held))
    if mode in ("naive", "mix"):
        parts["chunk"].append(chunks)
    some = next(x for x in (nodes, hit_edges, chunks) if x is not None)
    out = some.where(F.lit(False)).select("qid", F.lit("entity").alias("kind"), F.col("item").cast("string").alias("item"), F.col("pos").cast("int").alias("pos"))
    for kind, lists in parts.items():
        if lists:
            merged = round_robin(lists).where(F.col("pos") <= most)
            out = out.unionByName(merged.select("qid", F.lit(kind).alias("kind"), F.col("item").cast("string").alias("item"), F.col("pos").cast("int").alias("pos")))
    return out
