"""Graph operators as joins and aggregates; loops checkpoint their state at every step."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master that names none gets one of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        known = spark.conf.get("spark.checkpoint.dir", None)
        if not known and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(known or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Paths of the tables that ``passing`` deletes; None outside of it.
_PASSING: list[str] | None = None


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage with a table in the shared folder. Its rows are made once, where a checkpoint's are made twice."""
    path = f"{shared_folder(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    if _PASSING is not None:
        _PASSING.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession, kept: list[str]):
    """Tables that ``stored`` writes within are deleted at the end, but for what is in ``kept`` by then."""
    global _PASSING
    _PASSING = made = []
    try:
        yield made
    finally:
        _PASSING = None
        for path in (p for p in made if p not in kept):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def transition(edges: DataFrame, reverse: float = 0.3) -> DataFrame:
    """src, dst, w: forward and reverse edges, parallel ones summed, each source's weights summing to one."""
    both = edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") * reverse).alias("w")))
    merged = both.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    out = merged.groupBy("src").agg(F.sum("w").alias("out"))
    return merged.join(out, "src").where("out >= 1e-12").select("src", "dst", (F.col("w") / F.col("out")).alias("w"))


def pagerank(nodes: DataFrame, matrix: DataFrame, damping: float = 0.85, steps: int = 500, tol: float = 1e-6, teleport: DataFrame | None = None) -> DataFrame:
    """node, p. Dangling mass goes to the teleport vector (node, v), uniform if none is given or if it is all zero."""
    n = nodes.count()
    matrix = cut(matrix)
    base = nodes.select("node").join(matrix.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(1)), "node", "left")
    whole = teleport.agg(F.sum("v")).first()[0] if teleport is not None else 0
    if whole:
        base = base.join(teleport.select("node", (F.col("v") / whole).alias("v")), "node", "left").fillna(0.0, ["v"])
    else:
        base = base.withColumn("v", F.lit(1.0 / max(n, 1)))
    state = cut(base.select("node", F.col("v").alias("p"), "v", "out"))
    loose = lambda c: F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col(c))), F.lit(0.0))
    leak = state.agg(loose("p")).first()[0]
    for _ in range(steps):
        flow = matrix.join(state.select(F.col("node").alias("src"), "p"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("w") * F.col("p")).alias("f"))
        q = damping * (F.coalesce("f", F.lit(0.0)) + F.lit(leak) * F.col("v")) + (1 - damping) * F.col("v")
        new = cut(state.join(flow, "node", "left").select("node", q.alias("q"), "p", "v", "out"))
        moved, leak = new.agg(F.max(F.abs(F.col("q") - F.col("p"))), loose("q")).first()  # of what is written, in one pass
        state = new.select("node", F.col("q").alias("p"), "v", "out")
        if not moved or moved < tol:
            break
    else:
        if tol:
            warnings.warn(f"pagerank: not settled after {steps} steps, last change {moved}", RuntimeWarning, stacklevel=2)
    return state.select("node", "p")


def inherit(policies: DataFrame, parents: DataFrame, targets: DataFrame, decay: float = 0.8, depth: int = 5) -> DataFrame:
    """policy, si, conf, hops: policies that are reached but have no targets take those of the nearest targeted
    ancestors. A path ends at the first targeted ancestor; cycles end at ``depth``."""
    targeted = targets.select(F.col("policy").alias("parent")).distinct().withColumn("hit", F.lit(True))
    dead = parents.select(F.col("child").alias("policy")).distinct().join(targets.select("policy").distinct(), "policy", "left_anti")
    frontier = dead.select("policy", F.col("policy").alias("at"))
    found = None
    for hop in range(1, depth + 1):
        step = frontier.join(parents.select(F.col("child").alias("at"), "parent"), "at").join(targeted, "parent", "left").where("parent <> policy").select("policy", F.col("parent").alias("at"), "hit").distinct()
        step = cut(step)  # else each hop would run all hops before it again
        hits = step.where("hit").select("policy", F.col("at").alias("ancestor"), F.lit(hop).alias("hops"))
        found = hits if found is None else found.unionByName(hits)
        frontier = step.where("hit is null").select("policy", "at")
        if frontier.isEmpty():
            break
    near = found.groupBy("policy", "ancestor").agg(F.min("hops").alias("hops"))
    given = near.join(targets.withColumnRenamed("policy", "ancestor"), "ancestor").withColumn("c", F.col("conf") * F.pow(F.lit(decay), F.col("hops")))
    best = Window.partitionBy("policy", "si").orderBy(F.desc("c"), "hops", "ancestor")
    return given.withColumn("k", F.row_number().over(best)).where("k = 1").select("policy", "si", F.round("c", 6).alias("conf"), "hops")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def bfs(edges: DataFrame, sources: DataFrame, depth: int) -> DataFrame:
    """source, node, dist: the shortest unweighted distances along the edges, up to ``depth``."""
    seen = frontier = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("dist"))
    for d in range(1, depth + 1):
        reached = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select("source", F.col("dst").alias("node")).distinct()
        frontier = cut(reached.join(seen, ["source", "node"], "left_anti").withColumn("dist", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def largest_component(edges: DataFrame, most: int = 200) -> DataFrame:
    """node: the largest component taking edges both ways; of equally large ones that with the least node."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(most):
        near = both.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("l"))
        new = label.join(near, "node").select("node", F.least("label", "l").alias("label"), F.col("label").alias("was"))
        jump = new.select(F.col("node").alias("label"), F.col("label").alias("further"))  # the label's own label
        new = cut(new.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), "was"))
        changed = new.where("label <> was").limit(1).count()
        label = new.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} steps")
    best = label.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(1)
    return label.join(F.broadcast(best.select("label")), "label", "left_semi").select("node")


def seeded_pagerank(edges: DataFrame, seeds: DataFrame, restart: float = 0.15, steps: int = 40, tol: float = 1e-8) -> DataFrame:
    """seed, node, p for every seed (node) at once. A source's mass is shared over its edges, parallel ones counted; a
    node without edges keeps its own. Nodes that a seed hasn't reached have no row."""
    shares = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    out = shares.groupBy("src").agg(F.sum("m").alias("out"))
    matrix = cut(shares.join(out, "src").select("src", "dst", (F.col("m") / F.col("out")).alias("w")))
    start = cut(seeds.select(F.col("node").alias("seed"), "node").distinct())
    state = start.withColumn("p", F.lit(1.0))
    for _ in range(steps):
        sent = state.withColumnRenamed("node", "src").join(matrix, "src", "left")
        flow = sent.select("seed", F.coalesce("dst", "src").alias("node"), (F.col("p") * F.coalesce("w", F.lit(1.0)) * (1 - restart)).alias("p"))
        new = flow.unionByName(start.withColumn("p", F.lit(restart))).groupBy("seed", "node").agg(F.sum("p").alias("p"))
        before = state.select("seed", "node", F.col("p").alias("q"))
        both = cut(new.join(before, ["seed", "node"], "full").fillna(0.0, ["p", "q"]))
        state = both.select("seed", "node", "p")
        change = both.groupBy("seed").agg(F.sum(F.abs(F.col("p") - F.col("q"))).alias("d")).agg(F.max("d")).first()[0] or 0.0 if tol else 0.0
        if tol and change < tol:
            break
    else:
        if tol:
            warnings.warn(f"seeded_pagerank: not settled after {steps} steps, last change {change}", RuntimeWarning, stacklevel=2)
    return state


def push_pagerank(edges: DataFrame, seeds: DataFrame, restart: float = 0.15, least: float = 1e-4, steps: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(seed, node, p) and (seed, left): seeded_pagerank by forward push, for many seeds at once.

    Each seed starts with a residual of 1. A step takes the nodes whose residual is ``least`` or more for each of their
    edges: ``restart`` of it becomes theirs, the rest goes on along the edges; a node without edges keeps all. What is less
    stays where it is and makes no rows, so a seed's rows grow with 1 / (restart * least), whatever the size of the graph,
    where the power iteration has a row for each node that can be reached. ``left`` is the residual in the end: p differs from
    the exact vector by just as much in all, and every p is too small, never too large.
    """
    shares = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    out = cut(shares.groupBy("src").agg(F.sum("m").alias("out"), F.count(F.lit(1)).alias("wide")))
    matrix = cut(shares.join(out, "src").select("src", "dst", (F.col("m") / F.col("out")).alias("w")))
    start = seeds.select(F.col("node").alias("seed"), "node").where("node is not null").distinct()
    sized = lambda df: df.join(out.select(F.col("src").alias("node"), "wide"), "node", "left")
    state = cut(sized(start.withColumns({"p": F.lit(0.0), "r": F.lit(1.0)})).select("seed", "node", "wide", "p", "r"))
    full = (F.col("r") > 0) & (F.col("r") >= least * F.coalesce("wide", F.lit(1)))
    for _ in range(steps):
        pushed = state.where(full)
        if pushed.isEmpty():
            break
        sent = pushed.where("wide is not null").select("seed", F.col("node").alias("src"), (F.col("r") * (1 - restart)).alias("r")).join(matrix, "src")
        sent = sized(sent.groupBy("seed", F.col("dst").alias("node")).agg(F.sum(F.col("r") * F.col("w")).alias("r")))
        own = F.when(full, F.col("r") * F.when(F.col("wide").isNull(), 1.0).otherwise(restart)).otherwise(0.0)
        kept = state.select("seed", "node", "wide", (F.col("p") + own).alias("p"), F.when(full, 0.0).otherwise(F.col("r")).alias("r"))
        both = kept.unionByName(sent.select("seed", "node", "wide", F.lit(0.0).alias("p"), "r"))
        state = cut(both.groupBy("seed", "node").agg(F.max("wide").alias("wide"), F.sum("p").alias("p"), F.sum("r").alias("r")))
    else:
        warnings.warn(f"push_pagerank: not settled after {steps} steps", RuntimeWarning, stacklevel=2)
    return state.where("p > 0").select("seed", "node", "p"), state.groupBy("seed").agg(F.sum("r").alias("left"))


def related_edges(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """src, dst, degree, weight: the undirected edges at a hit node, by the sum of degrees and then the weight."""
    pairs = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col("w")).where("src <> dst").groupBy("src", "dst").agg(F.max("w").alias("weight"))
    g = degrees(pairs)
    at = lambda end: g.select(F.col("node").alias(end), F.col("degree").alias(f"__{end}"))
    near = pairs.join(hits.select(F.col("node").alias("src"), F.lit(1).alias("__s")).distinct(), "src", "left").join(hits.select(F.col("node").alias("dst"), F.lit(1).alias("__d")).distinct(), "dst", "left").where("__s = 1 or __d = 1")
    return near.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", (F.col("__src") + F.col("__dst")).alias("degree"), "weight")
