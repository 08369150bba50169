"""Communities of greatest modularity: nodes move between communities, communities become nodes, and again.

Undirected, weighted. Nodes that hang on one neighbour are with it in every best partition, so they join it first. A round
gives every node the community with the best gain, from one aggregate of the edges; only a part of the nodes that want to
move, chosen by a hash, does so, as two that move at once may undo each other's gain. A round counts if modularity rises, else
it is tried again with half as many nodes. So modularity never falls, and the result is the same in every run. The pass
that finds the next wishes also sums up the modularity, so that a try is one job. When no round helps, each community
becomes one node (its inner weight a loop) and the moves start again on the smaller graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .graph import stored

#: Gains below this are noise of the sums.
_EPS = 1e-12


def weighted(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """a, b, w with a <= b: edges between the same two nodes add up; loops stay."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w")).where("a is not null and b is not null")
    return ends.groupBy("a", "b").agg(F.sum("w").alias("w"))


def _degrees(graph: DataFrame) -> DataFrame:
    """node, k, loop, lone: a loop counts twice; a lone node has no other link."""
    inner = F.col("a") == F.col("b")
    ends = graph.select(F.col("a").alias("node"), "w", inner.alias("inner")).unionByName(graph.select(F.col("b").alias("node"), "w", inner.alias("inner")))
    return ends.groupBy("node").agg(F.sum("w").alias("k"), (F.sum(F.when(F.col("inner"), F.col("w")).otherwise(0.0)) / 2).alias("loop"), F.every("inner").alias("lone"))


def modularity(graph: DataFrame, labels: DataFrame) -> float:
    """Of graph (a, b, w) under labels (node, label): the share of weight within communities less what chance would give."""
    at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    wide = graph.join(at("a"), "a").join(at("b"), "b")
    ends = wide.select(F.explode(F.array(*[F.struct(F.col(f"label_{e}").alias("label"), F.col("w").alias("k")) for e in "ab"])).alias("e"), F.lit(0.0).alias("inner"))
    inner = wide.where("label_a = label_b").select(F.col("label_a").alias("label"), F.lit(0.0).alias("k"), F.col("w").alias("inner"))
    each = ends.select("e.label", "e.k", "inner").unionByName(inner).groupBy("label").agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"))
    row = each.agg(F.sum("k").alias("k2"), F.sum("inner").alias("inner"), F.sum(F.col("k") * F.col("k")).alias("sq")).first()
    return 2 * row.inner / row.k2 - row.sq / row.k2**2 if row.k2 else 0.0


def _looked(both: DataFrame, state: DataFrame, double: float, loops: float, lone: float) -> tuple[DataFrame, float, int]:
    """State (node, label, k) with ``to``, the community with the best gain of each node for which moving gains anything, else
    null; the modularity of the graph; the number of wishes. All in one job. ``lone``: the squares of k of nodes not in the state."""
    near = state.select(F.col("node").alias("dst"), F.col("label").alias("to"))
    own = state.select(F.col("node").alias("src"), F.col("label").alias("to"), F.lit(0.0).alias("w"))  # a choice without links too
    linked = both.join(near, "dst").select("src", "to", "w").unionByName(own).groupBy("src", "to").agg(F.sum("w").alias("w"))
    total = state.groupBy(F.col("label").alias("to")).agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("members"))
    wide = linked.join(total, "to").join(state.select(F.col("node").alias("src"), "label", "k"), "src")
    here = F.col("to") == F.col("label")
    others = F.col("total") - F.when(here, F.col("k")).otherwise(F.lit(0.0))
    scored = wide.withColumn("gain", F.round(F.col("w") - F.col("k") * others / double, 12))
    best = F.max_by(F.struct("to", "members", "total", "gain"), F.struct("gain", here.cast("int"), -F.xxhash64("to")))
    stay = F.max(F.when(here, F.struct("gain", "w", "total", "members")))
    out = scored.groupBy("src").agg(best.alias("best"), stay.alias("stay"), F.max("label").alias("label"), F.max("k").alias("k"))
    # two that are alone would change places: only towards the one of more weight, of equals the lesser name
    weight = F.round(F.col("best.total"), 9) - F.round("k", 9)
    fine = (F.col("best.members") > 1) | (F.col("stay.members") > 1) | (weight > 0) | ((weight == 0) & (F.col("best.to") < F.col("label")))
    to = F.when((F.col("best.gain") > F.col("stay.gain") + _EPS) & fine, F.col("best.to"))
    sums = Observation()  # of what is written, in the same pass
    rows = out.select(F.col("src").alias("node"), "label", "k", to.alias("to"), F.col("stay.w").alias("inner"), (F.col("k") * F.col("stay.total")).alias("sq"))
    rows = stored(rows.observe(sums, F.sum("inner").alias("inner"), F.sum("sq").alias("sq"), F.count("to").alias("wishes")).drop("inner", "sq"))
    found = sums.get
    return rows, ((found["inner"] or 0.0) + 2 * loops) / double - ((found["sq"] or 0.0) + lone) / double**2, found["wishes"]


def local_moves(graph: DataFrame, rounds: int = 8, tries: int = 2, least: float = 1e-2) -> tuple[DataFrame, float]:
    """(node, label) and its modularity after moves between the communities of single nodes; stops at a gain under ``least``."""
    loose = graph.where("a <> b")
    both = loose.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(loose.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    nodes = stored(_degrees(graph))
    lone = F.sum(F.when(F.col("lone"), F.col("k") * F.col("k")).otherwise(0.0))
    double, loops, squares = nodes.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.sum("loop"), lone).first()
    if not double:
        return nodes.select("node", F.col("node").alias("label")), 0.0
    look = lambda state: _looked(both, state, double, loops, squares)
    seen, best, wishes = look(nodes.where("not lone").select("node", F.col("node").alias("label"), "k"))
    for step in range(rounds):
        part, gained = 2 if step % 2 else 1, False  # at first all, then halves; fewer where that doesn't help
        for _ in range(tries if wishes else 0):
            chosen = F.pmod(F.xxhash64("node", F.lit(step)), F.lit(part)) == 0
            moved = seen.select("node", F.when(chosen, F.coalesce("to", "label")).otherwise(F.col("label")).alias("label"), "k")
            after, found, left = look(moved)
            if found > best + _EPS:
                gained = True
                break
            part *= 2
        if not gained:
            break
        seen, wishes, rose, best = after, left, found - best, found
        if rose < least:
            break
    return seen.select("node", "label").unionByName(nodes.where("lone").select("node", F.col("node").alias("label"))), best


def hanging(graph: DataFrame) -> DataFrame:
    """node, label: a node with one neighbour and no loop is with its neighbour, any other with itself. The best partition keeps
    such two together (weights not negative): alone or elsewhere the node adds nothing, with its neighbour it gains."""
    ends = graph.select(F.col("a").alias("node"), F.col("b").alias("near"), "w").unionByName(graph.where("a <> b").select(F.col("b").alias("node"), F.col("a").alias("near"), "w"))
    nodes = ends.groupBy("node").agg((F.count(F.lit(1)) == 1).alias("single"), F.min("near").alias("near"), F.min("w").alias("w"))
    leaf = F.col("single") & (F.col("near") != F.col("node")) & (F.col("w") > 0)
    nodes = stored(nodes.select("node", F.when(leaf, F.col("near")).alias("near")))
    pairs = nodes.where("near < node").select(F.col("near").alias("node"), F.col("node").alias("near"), F.lit(True).alias("mutual"))  # of two that hang on each other the lesser stays
    return nodes.join(pairs, ["node", "near"], "left").select("node", F.when(F.col("mutual").isNull(), F.coalesce("near", "node")).otherwise(F.col("node")).alias("label"))


def contract(graph: DataFrame, labels: DataFrame) -> DataFrame:
    """The graph of the communities: weights between them add up, those within become a loop."""
    at = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    wide = graph.join(at("a"), "a").join(at("b"), "b")
    return weighted(wide.select(F.col("label_a").alias("src"), F.col("label_b").alias("dst"), "w"), "w")


def communities(edges: DataFrame, weight: str | None = None, levels: int = 10, rounds: int = 8) -> DataFrame:
    """node, community: the community's name is that of one of its nodes. Edges (src, dst); nodes only with loops are alone."""
    graph = stored(weighted(edges, weight))
    labels = stored(hanging(graph))
    names, best = labels.withColumnRenamed("label", "community"), None
    graph = stored(contract(graph, labels))
    for _ in range(levels):
        labels, found = local_moves(graph, rounds)
        if best is not None and found <= best + _EPS:
            break
        best = found
        up = labels.withColumnsRenamed({"node": "community", "label": "__up"})
        names = stored(names.join(up, "community").select("node", F.col("__up").alias("community")))
        if labels.where("node <> label").isEmpty():
            break
        graph = stored(contract(graph, labels))
    least = names.groupBy("community").agg(F.min("node").alias("least"))
    return names.join(least, "community").select("node", F.col("least").alias("community"))
