"""Graph, retrieval, vector and evaluation queries."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import ann as A
from tessera.operators import graph as G
from tessera.operators import nearest as N
from tessera.operators import rank as R
from tessera.operators import tfidf as I
from tessera.plans.registry import registry
from tessera.sources import files
from tessera.sources import surrogate as S
from tessera.sources.surrogate import SQL, table

QUERIES, ORACLES, query = registry()
W, WR = f"WITH {SQL}", f"WITH RECURSIVE {SQL}"
NOW = 2001

_RANKED = """, s AS (SELECT si AS qid, policy AS item, round(0.7 * conf + 0.2 * power(0.8, abs(level - 1)) + 0.1 * exp(-0.15 * abs(2001 - year)), 9) AS score FROM targets JOIN policies USING (policy)),
q AS (SELECT qid, quantile_cont(score, 0.75) AS t FROM s GROUP BY qid), r AS (SELECT s.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM s JOIN q USING (qid) WHERE score >= t),
b AS (SELECT *, CASE WHEN lag(score) OVER w > 0 AND (lag(score) OVER w - score) / lag(score) OVER w > 0.15 THEN 1 ELSE 0 END AS br FROM r WINDOW w AS (PARTITION BY qid ORDER BY rank)),
c AS (SELECT qid, item, score, rank FROM (SELECT *, sum(br) OVER (PARTITION BY qid ORDER BY rank) AS cut FROM b) WHERE cut = 0 AND rank <= 100)"""


def _ranked(spark, d):
    s = S.targets(spark, d).join(S.policies(spark, d), "policy")
    score = 0.7 * F.col("conf") + 0.2 * R.level_decay(F.col("level")) + 0.1 * R.time_decay(F.col("year"), NOW)
    return R.rank_cut(s.select(F.col("si").alias("qid"), F.col("policy").alias("item"), F.round(score, 9).alias("score")))


@query("retrieve_e2p", W + _RANKED + "SELECT qid, item, round(score, 6) AS score, rank FROM c")
def _(spark, d):
    return _ranked(spark, d).select("qid", "item", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_EVAL = """, g AS (SELECT DISTINCT si AS qid, policy AS item FROM supports JOIN enterprises USING (enterprise)), qs AS (SELECT n_nationkey AS qid FROM nation),
h AS (SELECT c.*, (g.item IS NOT NULL)::INT AS hit FROM c LEFT JOIN g USING (qid, item)), h2 AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS cum FROM h),
a AS (SELECT qid, count(*) AS pred, sum(hit) AS tp, sum(hit * cum / rank) AS aps, sum(hit / log2(rank + 1)) AS dcg FROM h2 GROUP BY qid), gt AS (SELECT qid, count(*) AS gt FROM g GROUP BY qid),
m AS (SELECT qs.qid, coalesce(pred, 0) AS pred, coalesce(tp, 0) AS tp, coalesce(gt, 0) AS gt, coalesce(aps, 0) AS aps, coalesce(dcg, 0) AS dcg FROM qs LEFT JOIN a USING (qid) LEFT JOIN gt USING (qid)),
n AS (SELECT *, CASE WHEN pred > 0 THEN tp / pred ELSE 0 END AS p, CASE WHEN gt > 0 THEN tp / gt ELSE 0 END AS rc, list_sum(list_transform(range(1, least(gt, pred) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM m)
SELECT qid, pred, tp::BIGINT AS tp, gt, round(p, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END, 6) AS f1, round(aps / greatest(gt, 1), 6) AS ap, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM n"""


@query("retrieve_e2p_eval", W + _RANKED + _EVAL)
def _(spark, d):
    """Policies ranked for every industry, cut, and evaluated against who is supported."""
    truth = S.supports(spark, d).join(S.enterprises(spark, d), "enterprise").select(F.col("si").alias("qid"), F.col("policy").alias("item")).distinct()
    got = R.metrics(_ranked(spark, d), truth, table(spark, d, "nation").select(F.col("n_nationkey").alias("qid")))
    return got.select("qid", "pred", "tp", "gt", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "ap", "ndcg")])


@query("graph_transition", W + """, bi AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, 0.3 * w FROM edges), m AS (SELECT src, dst, sum(w) AS w FROM bi GROUP BY 1, 2) SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM m""")
def _(spark, d):
    return G.transition(S.message_edges(spark, d)).withColumn("w", F.round("w", 6))


_STEPS = 5
_PPR = W + """, nodes AS (SELECT DISTINCT unnest([src, dst]) AS node FROM edges), bi AS (SELECT src, dst, w FROM edges UNION ALL SELECT dst, src, 0.3 * w FROM edges), m0 AS (SELECT src, dst, sum(w) AS w FROM bi GROUP BY 1, 2), m AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM m0), n AS (SELECT count(*) AS n FROM nodes),
p0 AS (SELECT node, 1.0 / n AS p FROM nodes, n)""" + "".join(f""", p{k + 1} AS (SELECT node, 0.85 * coalesce(f, 0) + 0.15 / n AS p FROM nodes CROSS JOIN n LEFT JOIN (SELECT dst AS node, sum(w * p) AS f FROM m JOIN p{k} ON src = node GROUP BY dst) USING (node))""" for k in range(_STEPS)) + f"SELECT node, round(p * n, 5) AS p FROM p{_STEPS}, n"


@query("ppr_htpr", _PPR)
def _(spark, d):
    edges = G.cut(S.message_edges(spark, d))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    p = G.pagerank(nodes, G.transition(edges), steps=_STEPS, tol=0.0)
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return p.crossJoin(F.broadcast(n)).select("node", F.round(F.col("p") * F.col("n"), 5).alias("p"))


@query("graph_inherit", WR + """, dead AS (SELECT child AS policy FROM transmits EXCEPT SELECT policy FROM targets), tg AS (SELECT DISTINCT policy FROM targets),
up(policy, anc, hops, hit) AS (SELECT d.policy, parent, 1, parent IN (SELECT policy FROM tg) FROM dead d JOIN transmits ON child = d.policy UNION ALL SELECT u.policy, parent, hops + 1, parent IN (SELECT policy FROM tg) FROM up u JOIN transmits ON child = u.anc WHERE NOT hit AND hops < 5),
near AS (SELECT policy, anc AS ancestor, min(hops) AS hops FROM up WHERE hit GROUP BY 1, 2), c AS (SELECT n.policy, si, conf * power(0.8, hops) AS c, hops, ancestor FROM near n JOIN targets t ON t.policy = n.ancestor)
SELECT policy, si, round(c, 6) AS conf, hops FROM (SELECT *, row_number() OVER (PARTITION BY policy, si ORDER BY c DESC, hops, ancestor) AS k FROM c) WHERE k = 1""")
def _(spark, d):
    return G.inherit(S.policies(spark, d), S.transmits(spark, d), S.targets(spark, d))


@query("agg_degree", W + "SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1")
def _(spark, d):
    return G.degrees(S.message_edges(spark, d))


@query("graph_bfs", WR + """, src AS (SELECT 'P' || min(parent) AS node FROM transmits), b(node, dist) AS (SELECT node, 0 FROM src UNION ALL SELECT e.dst, dist + 1 FROM b JOIN edges e ON e.src = b.node WHERE dist < 4) SELECT (SELECT node FROM src) AS source, node, min(dist) AS dist FROM b GROUP BY node""")
def _(spark, d):
    first = S.transmits(spark, d).agg(F.concat(F.lit("P"), F.min("parent").cast("string")).alias("node"))
    return G.bfs(S.message_edges(spark, d), first, 4)


@query("graph_lcc", WR + """, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), lcc(node) AS (SELECT node FROM (SELECT src AS node, count(*) AS n FROM both_ways GROUP BY 1 ORDER BY n DESC, node LIMIT 1) UNION SELECT e.dst FROM lcc JOIN both_ways e ON e.src = lcc.node) SELECT node FROM lcc""")
def _(spark, d):
    return G.largest_component(S.message_edges(spark, d))


@query("graph_induced", W + ", keep AS (SELECT policy FROM policies WHERE level = 1 OR level = 2), ids AS (SELECT policy, row_number() OVER (ORDER BY policy) - 1 AS id FROM keep) SELECT a.id AS src, b.id AS dst FROM transmits JOIN ids a ON a.policy = parent JOIN ids b ON b.policy = child")
def _(spark, d):
    ids = files.dense_ids(S.policies(spark, d).where("level in (1, 2)"), "policy")
    end = lambda name, to: ids.select(F.col("name").alias(name), F.col("id").cast("long").alias(to))
    return S.transmits(spark, d).join(end("parent", "src"), "parent").join(end("child", "dst"), "child").select("src", "dst")


@query("score_decay", W + "SELECT policy, round(power(0.8, abs(level - 1)) * exp(-0.15 * abs(2001 - year)), 6) AS a, round(exp(-0.2 * abs(level - 1 - 2)) * exp(-0.05 * abs(2001 - year)), 6) AS b, round(greatest(0, 1 - 0.1 * (2001 - year)) * greatest(0, 1 - 0.2 * (level - 1)), 6) AS lin FROM policies")
def _(spark, d):
    level, year = F.col("level"), F.col("year")
    return S.policies(spark, d).select("policy", F.round(R.level_decay(level) * R.time_decay(year, NOW), 6).alias("a"), F.round(R.level_decay_exp(level - 1) * R.time_decay(year, NOW, 0.05), 6).alias("b"), F.round(R.linear_decay(NOW - year, level - 1, 0.1, 0.2), 6).alias("lin"))


@query("score_log_z_sigmoid", "SELECT o_orderkey, round(1 / (1 + exp(-(ln(greatest(o_totalprice, 1e-10)) - avg(ln(greatest(o_totalprice, 1e-10))) OVER ()) / stddev_pop(ln(greatest(o_totalprice, 1e-10))) OVER ())), 5) AS s FROM orders")
def _(spark, d):
    return R.log_z_sigmoid(table(spark, d, "orders"), "o_totalprice", "s").select("o_orderkey", F.round("s", 5).alias("s"))


@query("vec_topk", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, e.vec_id AS item, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) AS s FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT qid, item, round(s, 4) AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, item) AS k FROM s WHERE s > 0.2) WHERE k <= 10""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    s = N.top_k(asked, e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v")), 10, 0.2)
    return R.rank(s).select("qid", "item", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


def _index(spark, d):
    """The index of all vectors, the queries (the ids divisible by 20), and how many lists there are: about sqrt(n)."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    lists = min(4096, max(1, math.isqrt(e.count())))
    index = A.build(e, f"{G.shared_folder(spark)}/vec-ann-{uuid.uuid4().hex}", lists)
    return index, e.where("item % 20 = 0").select(F.col("item").alias("qid"), F.col("v").alias("q")), lists


@query("vec_ann")
def _(spark, d):
    """The ten nearest of the lists that a query probes, as many as 64 of the queries need for a recall of 0.95."""
    index, asked, _ = _index(spark, d)
    probes, _ = A.probes_for(index, asked, index.postings, 10, 0.95)
    return R.rank(A.search(index, asked, 10, probes)).select("qid", "item", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("vec_ann_all_lists", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, e.vec_id AS item,
list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) AS s FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT qid, item, round(s, 4) AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, item) AS k FROM s) WHERE k <= 10""")
def _(spark, d):
    """With all lists probed nothing is missed: every row is in the index once."""
    index, asked, lists = _index(spark, d)
    return R.rank(A.search(index, asked, 10, lists)).select("qid", "item", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("score_struct_context", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS qid, e.vec_id AS item, e.v, list_dot_product(q.v, e.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(e.v, e.v)) AS s FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, item) AS k FROM s) WHERE k <= 10), o AS (SELECT a.qid, a.item, a.v, b.v AS u, row_number() OVER (PARTITION BY a.qid, a.item ORDER BY b.k) AS m FROM h a JOIN h b ON a.qid = b.qid AND a.item <> b.item),
x AS (SELECT qid, item, any_value(v) AS v, list(u) AS us FROM o WHERE m <= 5 GROUP BY 1, 2), y AS (SELECT qid, item, v, list_transform(range(1, len(v) + 1), lambda i: list_avg(list_transform(us, lambda u: u[i]))) AS c FROM x)
SELECT qid, item, round((list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)) + 1) / 2, 5) AS context FROM y""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    v = e.select(F.col("vec_id").alias("item"), F.col("embedding").alias("v"))
    return N.struct_context(R.rank(N.top_k(asked, v, 10)), v).select("qid", "item", F.round("context", 5).alias("context"))


_E3 = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), t AS (SELECT a.vec_id, a.v AS h, b.v AS r, c.v AS t FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2) "


@query("kge_scores", _E3 + """SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(h[i] + r[i] - t[i]))), 4) AS transe, round(list_sum(list_transform(range(1, 65), lambda i: h[i] * r[i] * t[i])), 4) AS distmult,
round(list_sum(list_transform(range(1, 33), lambda i: h[i] * r[i] * t[i] + h[i + 32] * r[i] * t[i + 32] + h[i] * r[i + 32] * t[i + 32] - h[i + 32] * r[i + 32] * t[i])), 4) AS complex FROM t""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    t = e.withColumnRenamed("embedding", "h").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("r")), "vec_id").join(e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("t")), "vec_id")
    return t.select("vec_id", F.round(V.transe("h", "r", "t"), 4).alias("transe"), F.round(V.distmult("h", "r", "t"), 4).alias("distmult"), F.round(V.complex_score("h", "r", "t", 64), 4).alias("complex"))


@query("vec_tfidf", r"""WITH d AS (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS t FROM benchmark), tf AS (SELECT item_id, t, count(*) AS tf FROM d WHERE t <> '' GROUP BY 1, 2), n AS (SELECT count(DISTINCT item_id) AS n FROM tf), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT item_id, t, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (t), n), u AS (SELECT item_id, t, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM w)
SELECT a.item_id AS qid, b.item_id AS item, round(sum(a.w * b.w), 5) AS score FROM u a JOIN u b ON a.t = b.t AND a.item_id <> b.item_id WHERE a.item_id % 20 = 0 GROUP BY 1, 2""")
def _(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("t")).where("t <> ''").groupBy("item_id", "t").agg(F.count(F.lit(1)).alias("tf"))
    n = t.agg(F.countDistinct("item_id").alias("n"))
    df = t.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    w = t.join(df, "t").crossJoin(F.broadcast(n)).select("item_id", "t", (F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    size = w.groupBy("item_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("s"))
    u = w.join(size, "item_id").select("item_id", "t", (F.col("w") / F.col("s")).alias("w"))
    a = u.where("item_id % 20 = 0").select(F.col("item_id").alias("qid"), "t", F.col("w").alias("v"))
    return a.join(u, "t").where("qid <> item_id").groupBy("qid", F.col("item_id").alias("item")).agg(F.round(F.sum(F.col("w") * F.col("v")), 5).alias("score"))


@query("vec_tfidf_topk", r"""WITH d AS (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS t FROM benchmark), tf AS (SELECT item_id, t, count(*) AS tf FROM d WHERE t <> '' GROUP BY 1, 2),
n AS (SELECT count(DISTINCT item_id) AS n FROM tf), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT item_id, t, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (t), n), u AS (SELECT item_id, t, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM w),
s AS (SELECT a.item_id AS qid, b.item_id AS item, round(sum(a.w * b.w), 9) AS score FROM u a JOIN u b ON a.t = b.t AND a.item_id <> b.item_id WHERE a.item_id % 20 = 0 GROUP BY 1, 2)
SELECT qid, item, round(score, 5) AS score, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS k FROM s WHERE score > 0) WHERE k <= 10""")
def _(spark, d):
    w = G.cut(I.weights(table(spark, d, "benchmark"), "item_id"))
    found = I.search(w.where("item % 20 = 0").select(F.col("item").alias("qid"), "term", F.col("w").alias("v")), w, 10)
    return R.rank(found).select("qid", "item", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("ppr_push")
def _(spark, d):
    """The PageRank of the policies whose number 20 divides by forward push: rows grow with 1 / least, not with the nodes."""
    seeds = S.targets(spark, d).select("policy").distinct().where("policy % 20 = 0").select(F.concat(F.lit("P"), "policy").alias("node"))
    p, _left = G.push_pagerank(S.message_edges(spark, d), seeds, least=1e-3)
    return p.select("seed", "node", F.round("p", 6).alias("p"))


@query("lp_rank", "WITH s AS (SELECT l_returnflag AS r, l_partkey AS t, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY 1, 2) SELECT r, t, rank() OVER (PARTITION BY r ORDER BY s DESC) AS rank FROM s")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("r"), F.col("l_partkey").alias("t")).agg(F.round(F.sum("l_quantity"), 2).alias("s"))
    return s.select("r", "t", F.rank().over(Window.partitionBy("r").orderBy(F.desc("s"))).cast("long").alias("rank"))  # ties do not worsen a rank


@query("kge_more", _E3 + """, u AS (SELECT *, list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS w FROM t), p AS (SELECT *, list_dot_product(h, w) AS a, list_dot_product(t, w) AS b FROM u)
SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(h[i] - a * w[i] + r[i] - t[i] + b * w[i]))), 4) AS transh,
round(list_sum(list_transform(range(1, 33), lambda i: sqrt(power(h[i] * cos(r[i]) - h[i + 32] * sin(r[i]) - t[i], 2) + power(h[i + 32] * cos(r[i]) + h[i] * sin(r[i]) - t[i + 32], 2)))), 4) AS rotate,
round(list_sum(list_transform(range(0, 64), lambda k: r[k + 1] * list_sum(list_transform(range(0, 64), lambda i: h[i + 1] * t[(i + k) % 64 + 1])))), 4) AS hole,
round(list_sum(list_transform(range(1, 33), lambda i: h[i] * r[i] * t[i])) + list_sum(list_transform(range(33, 49), lambda i: h[i] * r[i] * t[i] + h[i + 16] * r[i] * t[i + 16] + h[i] * r[i + 16] * t[i + 16] - h[i + 16] * r[i + 16] * t[i])), 4) AS analogy FROM p""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    t = e.withColumnRenamed("embedding", "h").join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("r")), "vec_id").join(e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("t")), "vec_id")
    return t.select("vec_id", F.round(V.transh("h", "r", "t", "r"), 4).alias("transh"), F.round(V.rotate("h", "r", "t", 64), 4).alias("rotate"), F.round(V.hole("h", "r", "t", 64), 4).alias("hole"), F.round(V.analogy("h", "r", "t", 64), 4).alias("analogy"))


_SEED = W + """, c AS (SELECT src, dst, count(*) AS m FROM edges GROUP BY 1, 2), m AS (SELECT src, dst, m / sum(m) OVER (PARTITION BY src) AS w FROM c), s AS (SELECT 'E' || c_custkey AS seed FROM customer WHERE c_custkey % 20 = 0), p0 AS (SELECT seed, seed AS node, 1.0::DOUBLE AS p FROM s)""" + "".join(f""",
p{k + 1} AS (SELECT seed, node, sum(p) AS p FROM (SELECT seed, coalesce(dst, node) AS node, 0.85 * p * coalesce(w, 1) AS p FROM p{k} LEFT JOIN m ON src = node UNION ALL SELECT seed, seed, 0.15 FROM s) GROUP BY 1, 2)""" for k in range(3)) + " SELECT seed, node, round(p, 6) AS p FROM p3"


@query("ppr_seed", _SEED)
def _(spark, d):
    seeds = table(spark, d, "customer").where("c_custkey % 20 = 0").select(F.concat(F.lit("E"), "c_custkey").alias("node"))
    return G.seeded_pagerank(S.message_edges(spark, d), seeds, steps=3, tol=0.0).select("seed", "node", F.round("p", 6).alias("p"))


@query("related_edges", W + """, p AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(w) AS weight FROM edges WHERE src <> dst GROUP BY 1, 2), g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM p UNION ALL SELECT dst FROM p) GROUP BY 1)
SELECT src, dst, a.n + b.n AS degree, round(weight, 6) AS weight FROM p JOIN g a ON a.node = src JOIN g b ON b.node = dst WHERE src IN ('S1', 'S2', 'E5') OR dst IN ('S1', 'S2', 'E5')""")
def _(spark, d):
    hits = spark.createDataFrame([("S1",), ("S2",), ("E5",)], "node string")
    return G.related_edges(S.message_edges(spark, d), F.broadcast(hits)).withColumn("weight", F.round("weight", 6))
