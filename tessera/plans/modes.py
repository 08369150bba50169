"""Retrieval modes, combined importance, reach by industry and evaluations over parameter tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import graph as G
from tessera.operators import nearest as N
from tessera.operators import rank as R
from tessera.operators import retrieve as T
from tessera.plans.registry import registry
from tessera.sources import surrogate as S
from tessera.sources.surrogate import SQL, table

QUERIES, ORACLES, query = registry()
W = f"WITH {SQL}"

# retrieval modes ------------------------------------------------------------------------------------------------

#: Hits by vectors: those of the table, dealt out in turn, stand for policies, relations and chunks.
HITS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), z AS (SELECT count(*) AS z FROM e), sim AS (SELECT a.vec_id AS qid, b.vec_id AS vec, round(list_dot_product(a.v, b.v), 6) AS s FROM e a JOIN e b ON a.vec_id % 20 = 0),
t AS (SELECT 'P' || policy AS src, 'S' || si AS dst, conf AS w, policy, si FROM targets),
hn AS (SELECT * FROM (SELECT qid, 'P' || policy AS item, row_number() OVER (PARTITION BY qid ORDER BY s DESC, policy) AS pos FROM sim JOIN (SELECT DISTINCT policy FROM t) ON vec = policy % (FROM z)) WHERE pos <= 5),
he AS (SELECT * FROM (SELECT qid, src, dst, row_number() OVER (PARTITION BY qid ORDER BY s DESC, src, dst) AS pos FROM sim JOIN t ON vec = (policy * 3 + si) % (FROM z)) WHERE pos <= 5),
hc AS (SELECT qid, 'c' || vec AS item, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vec) AS pos FROM sim),
held AS (SELECT DISTINCT src AS item, 'c' || policy % (FROM z) AS chunk FROM t UNION SELECT src || '|' || dst, 'c' || (policy + si) % (FROM z) FROM t),
g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM t UNION ALL SELECT dst FROM t) GROUP BY 1),
lr AS (SELECT qid, src || '|' || dst AS item, row_number() OVER (PARTITION BY qid ORDER BY a.n + b.n DESC, w DESC, src, dst) AS pos FROM t JOIN hn ON item = src JOIN g a ON a.node = src JOIN g b ON b.node = dst),
ge AS (SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY min(o)) AS pos FROM (SELECT qid, src AS item, pos * 2 AS o FROM he UNION ALL SELECT qid, dst, pos * 2 + 1 FROM he) GROUP BY 1, 2),
gr AS (SELECT qid, src || '|' || dst AS item, pos FROM he),
lc AS (SELECT qid, chunk AS item, row_number() OVER (PARTITION BY qid ORDER BY count(DISTINCT item) DESC, min(pos), chunk) AS pos FROM hn JOIN held USING (item) GROUP BY 1, 2),
gc AS (SELECT qid, chunk AS item, row_number() OVER (PARTITION BY qid ORDER BY count(DISTINCT item) DESC, min(pos), chunk) AS pos FROM gr JOIN held USING (item) GROUP BY 1, 2)"""
PARTS = {"local": {"entity": ["hn"], "relation": ["lr"], "chunk": ["lc"]}, "global": {"entity": ["ge"], "relation": ["gr"], "chunk": ["gc"]}, "naive": {"chunk": ["hc"]}}
PARTS["hybrid"] = {k: PARTS["local"][k] + PARTS["global"][k] for k in PARTS["local"]}
PARTS["mix"] = PARTS["hybrid"] | {"chunk": ["lc", "gc", "hc"]}


def _merged(kind, lists):
    rows = " UNION ALL ".join(f"SELECT qid, item, pos * {len(lists)} + {k} AS o FROM {name}" for k, name in enumerate(lists))
    return f"SELECT qid, '{kind}' AS kind, item, row_number() OVER (PARTITION BY qid ORDER BY min(o))::INT AS pos FROM ({rows}) GROUP BY qid, item"


def _search(spark, d, mode):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding").alias("v"))
    asked = e.where("vec % 20 = 0").select(F.col("vec").alias("qid"), F.col("v").alias("q"))  # the stated queries
    z = e.count()
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))

    def hits(rows, k):
        """qid, item, pos of the k nearest of the rows (item, vec). Rows of one vector have one score, so only the k least
        items of each can be among the k nearest."""
        first = rows.withColumn("k", F.row_number().over(Window.partitionBy("vec").orderBy("item"))).where(F.col("k") <= k)
        near = N.top_k(asked, first.join(e, "vec").select("item", "v"), k, measure="dot", own=True, digits=6)
        return R.rank(near).select("qid", "item", F.col("rank").alias("pos"))

    chunks = nodes = relations = edges = held = None
    if mode in ("naive", "mix"):
        chunks = hits(e.select(F.col("vec").alias("item"), "vec"), 40).select("qid", key("c", "item").alias("item"), "pos")
    if mode != "naive":
        t = G.cut(S.targets(spark, d)).select(key("P", "policy").alias("src"), key("S", "si").alias("dst"), F.col("conf").alias("w"), "policy", "si")  # read several times
        nodes = hits(t.select(F.col("policy").alias("item"), (F.col("policy") % z).alias("vec")).distinct(), 5)
        nodes = G.cut(nodes.select("qid", key("P", "item").alias("item"), "pos"))
        pairs = t.select(F.concat_ws("\x01", "src", "dst").alias("item"), ((F.col("policy") * 3 + F.col("si")) % z).alias("vec"))
        ends = F.split("item", "\x01")
        relations = G.cut(hits(pairs, 5).select("qid", ends[0].alias("src"), ends[1].alias("dst"), "pos"))
        chunk = lambda c: F.concat(F.lit("c"), (c % z).cast("string")).alias("chunk")
        held = t.select(F.col("src").alias("item"), chunk(F.col("policy"))).unionByName(t.select(T.edge_key().alias("item"), chunk(F.col("policy") + F.col("si"))))
        edges = t.select("src", "dst", "w")
    return T.search(mode, nodes, relations, chunks, edges, held)


for _mode, _kinds in PARTS.items():
    _sql = f"{W}, {HITS} SELECT * FROM (" + " UNION ALL ".join(_merged(k, v) for k, v in _kinds.items()) + ") WHERE pos <= 40"
    query(f"retrieve_kg_{_mode}", _sql)(lambda spark, d, mode=_mode: _search(spark, d, mode))


_WALKS = 24  # at a damping of a half, what is left after these is under 1e-7
_GRAPH_PPR = """WITH every AS (SELECT event_type AS subject, 'e' || event_id % 40 AS object, 'c' || event_id % 50 AS chunk FROM events),
held AS (SELECT DISTINCT node, chunk FROM (SELECT subject AS node, chunk FROM every UNION ALL SELECT object, chunk FROM every)), n AS (SELECT node, count(*) AS n FROM held GROUP BY 1),
top AS (SELECT * FROM events WHERE value IS NOT NULL AND user_id = 7 ORDER BY value DESC, event_id LIMIT 5),
tp AS (SELECT value, unnest([event_type, 'e' || event_id % 40]) AS node FROM top), phrases AS (SELECT node, sum(value / n) / count(*) AS v FROM tp JOIN n USING (node) GROUP BY 1),
tele AS (SELECT node, sum(v) AS v FROM (SELECT * FROM phrases UNION ALL SELECT chunk, 0.05 / count(*) FROM held GROUP BY 1) GROUP BY 1),
e AS (SELECT chunk AS src, node AS dst, 1.0::DOUBLE AS w FROM held UNION ALL SELECT subject, object, count(*)::DOUBLE FROM every GROUP BY 1, 2),
m AS MATERIALIZED (SELECT src, dst, sum(w) / sum(sum(w)) OVER (PARTITION BY src) AS w FROM (SELECT * FROM e UNION ALL SELECT dst, src, w FROM e) GROUP BY 1, 2),
v AS MATERIALIZED (SELECT node, coalesce(v, 0) / (SELECT sum(v) FROM tele) AS v FROM (SELECT DISTINCT src AS node FROM m) LEFT JOIN tele USING (node)), p0 AS (SELECT node, v AS p FROM v)""" + "".join(f""",
p{k + 1} AS MATERIALIZED (SELECT node, 0.5 * coalesce(f, 0) + 0.5 * v AS p FROM v LEFT JOIN (SELECT dst AS node, sum(w * p) AS f FROM m JOIN p{k} ON src = node GROUP BY 1) USING (node))""" for k in range(_WALKS))


@query("retrieve_graph_ppr", _GRAPH_PPR + f" SELECT node AS chunk, round(p * 1000, 4) AS score FROM p{_WALKS} WHERE regexp_matches(node, '^c[0-9]+$')")
def _(spark, d):
    """The facts of a query give phrase weights, passages a small prior; a PageRank from both ranks the passages."""
    f = table(spark, d, "events").where("value is not null and user_id = 7").select(F.col("event_type").alias("subject"), F.concat(F.lit("e"), F.col("event_id") % 40).alias("object"), "value", "event_id", F.concat(F.lit("c"), F.col("event_id") % 50).alias("chunk"))
    every = table(spark, d, "events").select(F.col("event_type").alias("subject"), F.concat(F.lit("e"), F.col("event_id") % 40).alias("object"), F.concat(F.lit("c"), F.col("event_id") % 50).alias("chunk"))
    held = every.select(F.explode(F.array("subject", "object")).alias("node"), "chunk").distinct()
    n = held.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    top = f.orderBy(F.desc("value"), "event_id").limit(5).select("value", F.explode(F.array("subject", "object")).alias("node"))
    phrases = top.join(n, "node").groupBy("node").agg((F.sum(F.col("value") / F.col("n")) / F.count(F.lit(1))).alias("v"))
    prior = held.groupBy(F.col("chunk").alias("node")).agg((0.05 / F.count(F.lit(1))).alias("v"))
    edges = held.select(F.col("chunk").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w")).unionByName(every.select(F.col("subject").alias("src"), F.col("object").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    p = G.pagerank(nodes, G.transition(edges, reverse=1.0), damping=0.5, steps=_WALKS, tol=0.0, teleport=phrases.unionByName(prior))
    return p.where(F.col("node").startswith("c") & F.col("node").rlike("^c[0-9]+$")).select(F.col("node").alias("chunk"), F.round(F.col("p") * 1000, 4).alias("score"))


# scores ---------------------------------------------------------------------------------------------------------


@query("score_combined", W + ", c AS (SELECT policy, 100.0 / (policy + 1) * pow(0.8, abs(level - 1)) * exp(-0.15 * abs(2001 - year)) AS chain, (policy % 97)::DOUBLE AS ppr FROM policies), m AS (SELECT min(chain) AS a, max(chain) AS b, min(ppr) AS p, max(ppr) AS q FROM c) SELECT policy, round(0.4 * (ppr - p) / (q - p) + 0.6 * (chain - a) / (b - a), 6) AS score FROM c, m")
def _(spark, d):
    chain = 100.0 / (F.col("policy") + 1) * R.level_decay(F.col("level")) * R.time_decay(F.col("year"), 2001)
    c = S.policies(spark, d).select("policy", chain.alias("chain"), (F.col("policy") % 97).cast("double").alias("ppr"))
    both = R.minmax(R.minmax(c, "chain", "nc"), "ppr", "np")
    return both.select("policy", F.round(0.4 * F.col("np") + 0.6 * F.col("nc"), 6).alias("score"))


NORMS = "n AS (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), m AS (SELECT min(n) AS a, max(n) AS b FROM n)"


@query("score_struct_norm", f"WITH {NORMS}, s AS (SELECT vec_id, round(n, 6) AS n FROM n), k AS (SELECT min(n) AS a, max(n) AS b FROM s) SELECT vec_id, round(CASE WHEN b > a THEN (n - a) / (b - a) ELSE 0 END, 4) AS score FROM s, k")
def _(spark, d):
    n = table(spark, d, "embeddings").select("vec_id", F.round(V.norm("embedding"), 6).alias("n"))
    return R.minmax(n, "n", "score").select("vec_id", F.round("score", 4).alias("score"))


@query("score_gat_mix", "WITH s AS (SELECT vec_id, round(list_sum(list_transform(embedding[1:8]::DOUBLE[], lambda x: x * x)), 6) AS n FROM embeddings), k AS (SELECT min(n) AS a, max(n) AS b FROM s) SELECT vec_id, round(0.7 * (vec_id % 10) / 10 + 0.3 * (n - a) / (b - a + 1e-8), 4) AS score FROM s, k")
def _(spark, d):
    head = F.slice("embedding", 1, 8)
    n = table(spark, d, "embeddings").select("vec_id", F.round(V.dot(head, head), 6).alias("n"))
    k = n.agg(F.min("n").alias("a"), F.max("n").alias("b"))
    mixed = 0.7 * (F.col("vec_id") % 10) / 10 + 0.3 * (F.col("n") - F.col("a")) / (F.col("b") - F.col("a") + 1e-8)
    return n.crossJoin(F.broadcast(k)).select("vec_id", F.round(mixed, 4).alias("score"))  # k is one row


# reach and evaluation -------------------------------------------------------------------------------------------

REACH = "reach AS (SELECT t.policy, count(DISTINCT e.enterprise) AS covered FROM targets t JOIN enterprises e USING (si) GROUP BY 1), majors AS (SELECT DISTINCT t.policy, mi FROM targets t JOIN (SELECT DISTINCT si, mi FROM enterprises) USING (si)), size AS (SELECT mi, count(*) AS n FROM enterprises GROUP BY 1), base AS (SELECT policy, sum(n)::BIGINT AS base FROM majors JOIN size USING (mi) GROUP BY 1)"


def _reach(spark, d):
    """policy, covered (enterprises of its sub-industries), base (those of their majors); sizes are added up, no pairs."""
    e, t = S.enterprises(spark, d), S.targets(spark, d)
    own = t.join(F.broadcast(e.groupBy("si").agg(F.count(F.lit(1)).alias("n"))), "si").groupBy("policy").agg(F.sum("n").alias("covered"))
    majors = t.join(F.broadcast(e.select("si", "mi").distinct()), "si").select("policy", "mi").distinct()
    base = majors.join(F.broadcast(e.groupBy("mi").agg(F.count(F.lit(1)).alias("m"))), "mi").groupBy("policy").agg(F.sum("m").alias("base"))
    return own.join(base, "policy")


@query("tei_industry", W + f", {REACH} SELECT policy, covered, base, round(covered / base, 6) AS coverage FROM reach JOIN base USING (policy)")
def _(spark, d):
    return _reach(spark, d).withColumn("coverage", F.round(F.col("covered") / F.col("base"), 6))


@query("tei_summary", W + f", {REACH} SELECT round(avg(covered / base), 6) AS mean, round(quantile_cont(covered / base, 0.5), 6) AS median, count(*) AS n FROM reach JOIN base USING (policy)")
def _(spark, d):
    c = F.col("covered") / F.col("base")
    return _reach(spark, d).agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.percentile(c, F.lit(0.5)), 6).alias("median"), F.count(F.lit(1)).alias("n"))


@query("tei_hops", W + ", b AS (SELECT DISTINCT 'P' || policy AS seed, 'S' || si AS node FROM targets), m AS (SELECT DISTINCT seed, 'M' || mi AS node FROM b JOIN enterprises ON node = 'S' || si) SELECT hops, count(*) AS n FROM (SELECT seed, node, 1 AS hops FROM b UNION ALL SELECT seed, node, 2 FROM m) GROUP BY 1")
def _(spark, d):
    e = S.message_edges(spark, d).where("not (src like 'P%' and dst like 'P%')")
    seeds = e.where("src like 'P%'").select(F.col("src").alias("node")).distinct()
    return G.bfs(e, seeds, 2).where("dist > 0").groupBy(F.col("dist").alias("hops")).agg(F.count(F.lit(1)).alias("n"))


@query("eval_masked_gt", W + ", k AS (SELECT policy, enterprise, enterprise % 4 = 0 AS valid FROM supports) SELECT count(*) FILTER (WHERE n = 0) AS emptied, sum(n)::BIGINT AS kept FROM (SELECT policy, count(*) FILTER (WHERE valid) AS n FROM k GROUP BY 1)")
def _(spark, d):
    n = S.supports(spark, d).groupBy("policy").agg(F.count_if(F.col("enterprise") % 4 == 0).alias("n"))
    return n.agg(F.count_if(F.col("n") == 0).alias("emptied"), F.sum("n").alias("kept"))


@query("eval_ablation", "WITH g AS (SELECT * FROM (VALUES ('base', 0.15, 0.2), ('no_time', 0.0, 0.2), ('no_level', 0.15, 0.0)) v(name, rate, beta)), s AS (SELECT name, avg(greatest(0, 1 - rate::DOUBLE * (l_linenumber - 1)) * greatest(0, 1 - beta::DOUBLE * (l_suppkey % 3))) AS s FROM lineitem CROSS JOIN g GROUP BY 1) SELECT name, round(s, 6) AS score, round(s - (SELECT s FROM s WHERE name = 'base'), 6) + 0.0 AS delta FROM s")
def _(spark, d):
    settings = (("base", 0.15, 0.2), ("no_time", 0.0, 0.2), ("no_level", 0.15, 0.0))
    years, levels = F.col("l_linenumber") - 1, F.col("l_suppkey") % 3
    one = table(spark, d, "lineitem").agg(*[F.avg(R.linear_decay(years, levels, r, b)).alias(n) for n, r, b in settings])  # all settings in one pass
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.round(n, 6).alias("score"), (F.round(F.col(n) - F.col("base"), 6) + 0.0).alias("delta")) for n, *_ in settings])
    return one.select(F.inline(rows))


@query("lp_rank_temporal", "WITH s AS (SELECT user_id AS h, event_type AS r, date_trunc('day', ts)::DATE AS day, event_id AS t, value AS score FROM events), q AS (SELECT h, r, day, min(t) AS t FROM s GROUP BY 1, 2, 3) SELECT q.h, q.r, q.day, 1 + count(c.t) FILTER (WHERE c.score > x.score AND c.t % 5 > 0) AS rank FROM q JOIN s x ON x.t = q.t JOIN s c ON c.h = q.h AND c.r = q.r AND c.day = q.day GROUP BY 1, 2, 3")
def _(spark, d):
    s = table(spark, d, "events").select(F.col("user_id").alias("h"), F.col("event_type").alias("r"), F.to_date("ts").alias("day"), F.col("event_id").alias("t"), F.col("value").alias("score"))
    q = s.groupBy("h", "r", "day").agg(F.min_by("score", "t").alias("own"))
    known = s.where("t % 5 > 0").select("h", "r", "day", "score")  # known quads of the same date are left out
    return q.join(known, ["h", "r", "day"], "left").groupBy("h", "r", "day").agg((1 + F.count_if(F.col("score") > F.col("own"))).alias("rank"))


_MATRIX = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT a.vec_id, a.v AS h, b.v AS r, c.v AS t FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2),
p AS (SELECT *, list_transform(range(1, 9), lambda j: list_sum(list_transform(range(1, 9), lambda i: h[i] * r[(i - 1) * 8 + j]))) AS hm, list_transform(range(1, 9), lambda j: list_sum(list_transform(range(1, 9), lambda i: t[i] * r[(i - 1) * 8 + j]))) AS tm, list_dot_product(h, r) AS a, list_dot_product(t, h) AS b FROM x),
d AS (SELECT *, list_transform(range(1, 65), lambda i: h[i] + a * r[i]) AS hd, list_transform(range(1, 65), lambda i: t[i] + b * r[i]) AS td FROM p), u AS (SELECT *, sqrt(list_dot_product(hd, hd)) AS hs, sqrt(list_dot_product(td, td)) AS ts FROM d)
SELECT vec_id, round(list_sum(list_transform(range(1, 9), lambda i: abs(hm[i] + r[i] - tm[i]))), 4) AS transr, round(-list_sum(list_transform(range(1, 9), lambda i: hm[i] * t[i])), 4) + 0.0 AS rescal,
round(list_sum(list_transform(range(1, 65), lambda i: h[i] * r[i] * t[i] + h[i] * h[i] * t[i])) / 2, 4) + 0.0 AS simple, round(list_sum(list_transform(range(1, 65), lambda i: abs(hd[i] / hs + r[i] - td[i] / ts))), 4) AS transd FROM u"""


@query("kge_matrix", _MATRIX)
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    at = lambda k, name: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(name))
    x = at(0, "h").join(at(1, "r"), "vec_id").join(at(2, "t"), "vec_id")  # the relation's vector is its 8 x 8 matrix, too
    scores = {"transr": V.transr("h", "r", "t", "r", 8), "rescal": V.rescal("h", "r", "t", 8), "simple": V.simple("h", "r", "h", "t"), "transd": V.transd("h", "r", "t", "r", "r", "h")}
    return x.select("vec_id", *[(F.round(s, 4) + 0.0).alias(k) for k, s in scores.items()])
