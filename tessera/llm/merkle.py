"""Merkle manifest of a table of documents: leaves, subroots by source, one root, and the proof of every leaf.

Built level by level with DataFrame operations. Leaves are numbered within their source by ``row_number``; the source of
a third of all rows is numbered in ranges of the whole order, whose counts are added up. The floor of index / fanout
names the parent, a grouped and sorted array holds its children (``fanout`` at most), and its hash is the parent. A
source is done when one node is left; its subroot is a leaf of the tree over sources, which is built alike.

On the way down each level is joined once with the level above: a run of siblings takes over its parent's path and
appends its own siblings. Runs carry paths, leaves don't: a path is stored once for ``fanout`` leaves, and the rows of a
leaf (proof, tampered fold) are made where its run is.

Nulls: a null field is hashed as ``-``; a null source is a source of its own, before all others; null ids come first and
are never tampered with. Rows that repeat an id are leaves of their own, ordered by their leaf. An empty text is hashed as ``0:``.
An empty table gives no rows. Other columns are ignored, so their names can't clash. Ids are cast to long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16


def _hash(x):
    return F.sha2(x.cast("binary"), 256)


def _field(x):
    x = x.cast("string")
    return F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, ident: str = "doc_id", source: str = "source", text: str = "text", every: int = 5) -> DataFrame:
    """(tree, doc_id, leaf, changed): the tampered leaf, or null where nothing is tampered with."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    of = lambda c: F.col(c).cast("string") if c == source else F.col(c)
    plain = _hash(F.concat(*[_field(of(c)) for c in fields]))
    other = _hash(F.concat(*[_field(F.translate(F.col(text).cast("string"), upper, lower) if c == text else of(c)) for c in fields]))
    chosen = F.crc32(F.col(ident).cast("long").cast("string").cast("binary")) % every == 0
    # the name of a tree is never null and sorts as its source does, null first
    tree = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col(ident).cast("long").alias("doc_id"), plain.alias("leaf"), F.when(chosen, other).alias("changed"))


def indexed(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``at``, the index of each row within its tree, and ``n``, the number of rows of that tree.

    The rows are cut into ranges of (tree, order), written once; row_number counts within a range, and the rows of the
    tree in the ranges before it are added. So a large tree is numbered by many tasks.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    cut = materialize(tied.repartitionByRange(tree, *order, "__tie").withColumn("__range", F.spark_partition_id()), name)
    counts = cut.groupBy(tree, "__range").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy(tree).orderBy("__range")
    starts = counts.select(tree, "__range", (F.sum("rows").over(before) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy(tree)).alias("n"))
    within = F.row_number().over(Window.partitionBy(tree, "__range").orderBy(*order, "__tie"))
    numbered = cut.withColumn("__number", within).join(starts, [tree, "__range"])
    return numbered.withColumn("at", F.col("before") + F.col("__number") - 1).drop("__tie", "__range", "__number", "before")


def _runs(nodes: DataFrame, fanout: int, extra: list[str], name: str) -> DataFrame:
    """One row for each run of siblings: tree, at (of the parent), n (nodes of the parents' level), kids in order, hash."""
    up = nodes.where("n > 1").withColumn("up", F.floor(F.col("at") / fanout).cast("long"))
    kids = F.sort_array(F.collect_list(F.struct("at", "hash", *extra)))
    runs = up.groupBy("tree", "up").agg(kids.alias("kids"), F.first("n").alias("n"))
    above = F.floor((F.col("n") + fanout - 1) / fanout).cast("long")
    return materialize(runs.select("tree", F.col("up").alias("at"), above.alias("n"), "kids", _hash(F.array_join("kids.hash", "")).alias("hash")), name)


def _beside(kids, kid):
    """(left, right): the digests of the siblings before and after ``kid`` in its run."""
    side = lambda test: F.array_join(F.transform(F.filter(kids, test), lambda k: k["hash"]), "")
    return F.struct(side(lambda k: k["at"] < kid["at"]).alias("left"), side(lambda k: k["at"] > kid["at"]).alias("right"))


class Tree:
    """The levels of one tree for each value of ``tree``; nodes: tree, at, n, hash and the columns ``extra``."""

    def __init__(self, nodes: DataFrame, fanout: int = FANOUT, extra: tuple[str, ...] = (), name: str = "tree"):
        self.fanout, self.extra, self.nodes = fanout, list(extra), nodes
        most = nodes.agg(F.max("n")).first()[0] or 0  # how many levels, no more
        self.levels: list[DataFrame] = []
        self.tops = [nodes.where("n = 1").select("tree", "hash")]
        level, left = nodes, self.extra
        while most > 1:
            level = _runs(level, fanout, left, f"{name}-{len(self.levels)}")
            self.levels.append(level)
            self.tops.append(level.where("n = 1").select("tree", "hash"))
            most, left = -(-most // fanout), []

    def roots(self) -> DataFrame:
        """(tree, hash)"""
        out = self.tops[0]
        for top in self.tops[1:]:
            out = out.unionByName(top)
        return out

    def paths(self, given: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
        """(tree, hash, *extra, path, *carry) of every node; ``given``: (tree, path, *carry) of the roots.

        A path is an array of (left, right), the digests beside a node and beside those above it, up to the root.
        """
        shared = ["path", *carry]
        above = None
        lone = self.nodes.where("n = 1").join(given, "tree").select("tree", "hash", *self.extra, *shared)
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth].select("tree", "at", "n", "kids")
            mine = level.where("n = 1").join(given, "tree").select("tree", "at", "kids", *shared)
            if above is not None:
                mine = mine.unionByName(level.where("n > 1").join(above, ["tree", "at"]).select("tree", "at", "kids", *shared))
            each = mine.select("tree", "kids", *shared, F.explode("kids").alias("kid"))
            kid = F.col("kid")
            own = [kid[c].alias(c) for c in ("at", "hash", *(self.extra if depth == 0 else []))]
            path = F.concat(F.array(_beside(F.col("kids"), kid)), F.col("path"))
            above = each.select("tree", *own, path.alias("path"), *carry)
        return lone if above is None else lone.unionByName(above.drop("at"))


def manifest(docs: DataFrame, fanout: int = FANOUT, every: int = 5, **names) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row."""
    found = materialize(leaves(docs, every=every, **names), "leaves")  # texts are read once; ranges are drawn from their leaves
    rows = indexed(found, "tree", ["doc_id", "leaf"], "ranges")
    nodes = materialize(rows.select("tree", "at", "n", F.col("leaf").alias("hash"), "doc_id", "changed"), "numbered")
    trees = Tree(nodes, fanout, ("doc_id", "changed"), "runs")
    tops = materialize(trees.roots(), "subroots")
    sources = indexed(tops.select(F.lit("all").alias("tree"), F.col("tree").alias("of"), "hash"), "tree", ["of"], "sources")
    whole = Tree(materialize(sources, "numbered-sources"), fanout, ("of",), "source-runs")
    root = whole.roots().first()
    root = root["hash"] if root else ""
    none = F.array().cast("array<struct<left:string,right:string>>")
    given = whole.paths(whole.roots().select("tree", none.alias("path")))
    given = materialize(given.select(F.col("of").alias("tree"), "path", F.col("hash").alias("subroot")), "source-paths")
    found = trees.paths(given, ("subroot",))
    proof = _hash(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""))
    fold = F.aggregate("path", F.coalesce("changed", "hash"), lambda h, p: _hash(F.concat(p["left"], h, p["right"])))
    out = found.select("doc_id", F.col("hash").alias("leaf"), "subroot", F.lit(root).alias("root"), proof.alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _levels(first: str, prefix: str, depth: int, fanout: int) -> list[str]:
    """CTEs of ``depth`` levels above the nodes ``first`` (tree, i, n, h); a tree with one node stays as it is."""
    out, below = [], first
    for level in range(1, depth + 1):
        out.append(
            f"""{prefix}{level} AS MATERIALIZED (SELECT tree, i // {fanout} AS i, (n + {fanout - 1}) // {fanout} AS n,
  sha256(string_agg(h, '' ORDER BY i)) AS h, list(h ORDER BY i) AS kids FROM {below} WHERE n > 1 GROUP BY tree, i // {fanout}, n
  UNION ALL SELECT tree, i, n, h, NULL FROM {below} WHERE n = 1)"""
        )
        below = f"{prefix}{level}"
    return out


def _climb(start: str, prefix: str, depth: int, fanout: int) -> list[str]:
    """CTEs that append siblings to ``proof`` and fold ``f`` of the rows ``start`` (tree, i, proof, f, ...)."""
    out, below = [], start
    for level in range(1, depth + 1):
        at = f"(b.i // {fanout ** (level - 1)}) % {fanout}"
        out.append(
            f"""{start}_{level} AS (SELECT b.* REPLACE (
  CASE WHEN p.kids IS NULL THEN b.proof ELSE b.proof || array_to_string(p.kids[1:{at}], '') || array_to_string(p.kids[{at} + 2:], '') END AS proof,
  CASE WHEN p.kids IS NULL THEN b.f
       ELSE sha256(array_to_string(p.kids[1:{at}], '') || b.f || array_to_string(p.kids[{at} + 2:], '')) END AS f)
  FROM {below} b JOIN {prefix}{level} p ON p.tree = b.tree AND p.i = b.i // {fanout ** level})"""
        )
        below = f"{start}_{level}"
    return out


def _sql(fanout: int = FANOUT, every: int = 5, depth: int = 5) -> str:
    """Trees of up to fanout ** depth leaves."""
    field = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    plain = " || ".join(field(c) for c in FIELDS)
    other = " || ".join(field(low if c == "text" else c) for c in FIELDS)
    shift = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), "
    crc += "lambda c, b: xor(c >> 8, crc_table.l[(xor(c, b) & 255) + 1])), 4294967295)"
    parts = [
        f"crc_table AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {shift})) AS l)",
        f"""hashed AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256({plain}) AS h,
  CASE WHEN {crc} % {every} = 0 THEN sha256({other}) END AS changed FROM documents, crc_table)""",
        """l0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
  count(*) OVER (PARTITION BY tree) AS n FROM hashed)""",
        *_levels("l0", "l", depth, fanout),
        f"""t0 AS MATERIALIZED (SELECT 'all' AS tree, tree AS of, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h
  FROM l{depth})""",
        *_levels("t0", "t", depth, fanout),
        "own AS (SELECT *, '' AS proof, coalesce(changed, h) AS f FROM l0)",
        *_climb("own", "l", depth, fanout),
        f"""up AS (SELECT t.tree, t.i, t.h AS subroot, o.doc_id, o.h AS leaf, o.proof, o.f FROM own_{depth} o JOIN t0 t ON t.of = o.tree)""",
        *_climb("up", "t", depth, fanout),
    ]
    return "WITH " + ",\n".join(parts) + f"""
SELECT u.doc_id, u.leaf, u.subroot, r.h AS root, sha256(u.proof) AS proof_sha256, u.f AS folded_root, u.f = r.h AS verified
FROM up_{depth} u, t{depth} r"""


QUERIES = {"op12_merkle": op12_merkle}
ORACLES = {"op12_merkle": _sql()}
