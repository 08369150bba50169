"""Merging, upserting, ordering, evaluation and maintenance queries of the document graph and its policies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.operators import graph as G
from tessera.operators import merge as M
from tessera.operators import rank as R
from tessera.operators import reach as P
from tessera.plans.registry import registry
from tessera.sources import files
from tessera.sources import surrogate as S
from tessera.sources.surrogate import SQL, table

QUERIES, ORACLES, query = registry()
W = f"WITH {SQL}"
ONE = "*"

#: Extraction rows: users as entities, parts and suppliers as related ones.
ROWS = "rows AS (SELECT 'U' || user_id AS entity, event_type AS entity_type, props AS description, 'c' || event_id % 50 AS source_id, ts, event_id AS pos FROM events)"
LINKS = "links AS (SELECT 'N' || l_partkey % 97 AS src, 'N' || l_suppkey % 97 AS dst, l_quantity AS weight, l_returnflag || ', ' || l_linestatus AS keywords FROM lineitem)"
PAIRS = LINKS + ", pairs AS (SELECT least(src, dst) AS src, greatest(src, dst) AS dst, weight, keywords FROM links WHERE src <> dst)"


def _rows(spark, d):
    return table(spark, d, "events").select(F.concat(F.lit("U"), "user_id").alias("entity"), F.col("event_type").alias("entity_type"), F.col("props").alias("description"), F.concat(F.lit("c"), F.col("event_id") % 50).alias("source_id"), "ts", F.col("event_id").alias("pos"))


def _links(spark, d):
    key = lambda c: F.concat(F.lit("N"), F.col(c) % 97)
    return table(spark, d, "lineitem").select(key("l_partkey").alias("src"), key("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight"), F.concat_ws(", ", "l_returnflag", "l_linestatus").alias("keywords"))


# merging --------------------------------------------------------------------------------------------------------


@query("agg_merge_nodes", "WITH " + ROWS + """, v AS (SELECT entity, entity_type FROM (SELECT entity, entity_type, row_number() OVER (PARTITION BY entity ORDER BY count(*) DESC, min(pos)) AS k FROM rows GROUP BY 1, 2) WHERE k = 1),
t AS (SELECT entity, string_agg(description, '<SEP>' ORDER BY ts, -length(description), pos) AS description FROM (SELECT *, row_number() OVER (PARTITION BY entity, description ORDER BY ts, -length(description), pos) AS k FROM rows) WHERE k = 1 GROUP BY 1),
i AS (SELECT entity, string_agg(source_id, ',' ORDER BY p) AS source_ids FROM (SELECT entity, source_id, min(pos) AS p, row_number() OVER (PARTITION BY entity ORDER BY min(pos) DESC) AS k FROM rows GROUP BY 1, 2) WHERE k <= 20 GROUP BY 1)
SELECT * FROM v JOIN t USING (entity) JOIN i USING (entity)""")
def _(spark, d):
    return M.merge_nodes(_rows(spark, d), 20).withColumn("source_ids", F.array_join("source_ids", ","))


@query("agg_merge_edges", "WITH " + PAIRS + ", k AS (SELECT src, dst, string_agg(t, ',' ORDER BY t) AS keywords FROM (SELECT DISTINCT src, dst, trim(unnest(string_split(keywords, ','))) AS t FROM pairs) GROUP BY 1, 2) SELECT src, dst, sum(weight) AS weight, any_value(k.keywords) AS keywords FROM pairs JOIN k USING (src, dst) GROUP BY 1, 2")
def _(spark, d):
    return M.merge_edges(_links(spark, d))


@query("agg_missing_endpoints", "WITH " + LINKS + " SELECT DISTINCT node, 'UNKNOWN' AS entity_type FROM (SELECT src AS node FROM links UNION ALL SELECT dst FROM links) WHERE node NOT IN (SELECT 'N' || p_partkey FROM part WHERE p_partkey < 50)")
def _(spark, d):
    nodes = table(spark, d, "part").where("p_partkey < 50").select(F.concat(F.lit("N"), "p_partkey").alias("node"))
    return M.missing_endpoints(_links(spark, d), nodes)


@query("agg_source_cap", "WITH a AS (SELECT user_id, list(event_id ORDER BY event_id) AS s FROM events GROUP BY 1) SELECT user_id, array_to_string(s[-3:], ',') AS fifo, array_to_string(s[1:3], ',') AS keep FROM a")
def _(spark, d):
    a = table(spark, d, "events").groupBy("user_id").agg(M.ordered("event_id", "event_id").alias("s"))
    return a.select("user_id", *[F.array_join(M.source_cap(F.col("s"), 3, k).cast("array<string>"), ",").alias(k) for k in ("fifo", "keep")])


@query("agg_delta_ids", "SELECT p_partkey, array_to_string(list_concat(list_filter([p_size, p_size + 1, p_size + 2], lambda x: x <> p_size + 1), [p_size + 9]), ',') AS ids FROM part")
def _(spark, d):
    n = F.col("p_size")
    ids = M.delta_ids(F.array(n, n + 1, n + 2), F.array(n + 1, n + 2), F.array(n + 2, n + 9))
    return table(spark, d, "part").select("p_partkey", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("agg_chunk_occurrence", "SELECT l_partkey AS chunk, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS first FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("chunk")).agg(F.countDistinct("l_orderkey").alias("n"), F.min("l_orderkey").alias("first"))


@query("agg_rerank_scores", "SELECT l_orderkey AS doc, max(l_discount) AS hi, round(avg(l_discount), 6) AS mean, arg_min(l_discount, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + round(l_discount * 100)) AS head FROM lineitem GROUP BY 1")
def _(spark, d):
    x = "l_discount"
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.max(x).alias("hi"), F.round(F.avg(x), 6).alias("mean"), F.min_by(x, F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 1000 + F.round(F.col(x) * 100)).alias("head"))


@query("agg_cooccurrence", "WITH " + LINKS + " SELECT a, b, count(*) AS w FROM (SELECT src AS a, dst AS b FROM links UNION ALL SELECT dst, src FROM links) WHERE a <> b GROUP BY 1, 2")
def _(spark, d):
    e = _links(spark, d).where("src <> dst").groupBy("src", "dst").agg(F.count(ONE).alias("w"))  # combined before both ways
    both = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionByName(e.select(F.col("dst").alias("a"), F.col("src").alias("b"), "w"))
    return both.groupBy("a", "b").agg(F.sum("w").alias("w"))


@query("agg_relation_category", "SELECT *, CASE WHEN hpt < 1.5 THEN '1' ELSE 'n' END || '-' || CASE WHEN tph < 1.5 THEN '1' ELSE 'n' END AS category FROM (SELECT l_returnflag || l_linestatus AS r, round(count(*) / count(DISTINCT l_partkey), 6) AS tph, round(count(*) / count(DISTINCT l_orderkey), 6) AS hpt FROM lineitem GROUP BY 1)")
def _(spark, d):
    t = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("r"), F.col("l_partkey").alias("h"), F.col("l_orderkey").alias("t"))
    return M.relation_category(t).withColumns({c: F.round(c, 6) for c in ("tph", "hpt")})


@query("agg_fill_median", "WITH m AS (SELECT c_nationkey, list_sort(list(c_acctbal))[count(*) // 2 + 1] AS m FROM customer WHERE c_acctbal > 0 GROUP BY 1) SELECT c_custkey, round(ln(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE coalesce(m, 0) END + 1), 6) AS x FROM customer LEFT JOIN m USING (c_nationkey)")
def _(spark, d):
    c = table(spark, d, "customer")
    w = Window.partitionBy("c_nationkey")
    r = c.where("c_acctbal > 0").select("c_nationkey", "c_acctbal", F.row_number().over(w.orderBy("c_acctbal", "c_custkey")).alias("r"), F.count(ONE).over(w).alias("n"))
    m = r.where("r = floor(n / 2) + 1").select("c_nationkey", F.col("c_acctbal").alias("m"))
    x = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(F.coalesce("m", F.lit(0.0)))
    return c.join(F.broadcast(m), "c_nationkey", "left").select("c_custkey", F.round(F.ln(x + 1), 6).alias("x"))  # one row a nation


@query("agg_edge_degree", W + ", g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT DISTINCT src, dst, a.n + b.n AS degree FROM edges JOIN g a ON a.node = src JOIN g b ON b.node = dst")
def _(spark, d):
    e = S.message_edges(spark, d)
    g = G.degrees(e)
    at = lambda end: g.select(F.col("node").alias(end), F.col("degree").alias(f"n_{end}"))
    return e.select("src", "dst").distinct().join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", (F.col("n_src") + F.col("n_dst")).alias("degree"))


@query("agg_out_degree", W + " SELECT src, dst, round(w / sum(w) OVER (PARTITION BY src), 6) AS w FROM edges")
def _(spark, d):
    e = S.message_edges(spark, d)
    return e.join(e.groupBy("src").agg(F.sum("w").alias("s")), "src").select("src", "dst", F.round(F.col("w") / F.col("s"), 6).alias("w"))


@query("agg_industry_max", "SELECT c_nationkey AS qid, c_mktsegment AS item, max(c_acctbal) AS score FROM customer GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("qid"), F.col("c_mktsegment").alias("item")).agg(F.max("c_acctbal").alias("score"))


@query("agg_mean_cap", "SELECT greatest(1, least(50, ceil(avg(n) * 1.5)))::BIGINT AS cap FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def _(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(ONE).alias("n"))
    return n.agg(F.greatest(F.lit(1), F.least(F.lit(50), F.ceil(F.avg("n") * 1.5))).cast("long").alias("cap"))


# windows, order -------------------------------------------------------------------------------------------------


@query("win_linear_quota", "WITH a AS (SELECT o_custkey AS qid, o_orderkey AS item, row_number() OVER w - 1 AS pos, 1 + o_orderkey % 4 AS has, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), b AS (SELECT *, (CASE WHEN n = 1 THEN 5 ELSE round_even(5 - pos * 4.0::DOUBLE / (n - 1), 0) END)::BIGINT AS want FROM a), c AS (SELECT *, least(want, has) AS t FROM b), e AS (SELECT *, sum(want - t) OVER (PARTITION BY qid) AS s, has - t AS room, sum(has - t) OVER (PARTITION BY qid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM c) SELECT qid, item, (t + greatest(0, least(room, s - (upto - room))))::BIGINT AS took FROM e")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("item"), (1 + F.col("o_orderkey") % 4).alias("has"))
    a = o.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy("item")) - 1)
    return M.linear_quota(a, 5, 1).select("qid", "item", F.col("took").cast("long").alias("took"))


@query("win_latest_positive", "SELECT user_id, arg_max(value, event_id) AS v FROM events WHERE value > 0 GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").where("value > 0").groupBy("user_id").agg(F.max_by("value", "event_id").alias("v"))


@query("win_dedup_order", "SELECT l_partkey AS item, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))


@query("win_dense_id", "SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS id FROM (SELECT DISTINCT p_name FROM part)")
def _(spark, d):
    return files.dense_ids(table(spark, d, "part"), "p_name").select("name", F.col("id").cast("long").alias("id"))


@query("win_gid_offset", "SELECT kind, n, (sum(n) OVER (ORDER BY kind) - n)::BIGINT AS base FROM (SELECT 'a_part' AS kind, count(*) AS n FROM part UNION ALL SELECT 'b_nation', count(*) FROM nation UNION ALL SELECT 'c_customer', count(*) FROM customer)")
def _(spark, d):
    n = None
    for kind, name in (("a_part", "part"), ("b_nation", "nation"), ("c_customer", "customer")):
        one = table(spark, d, name).agg(F.count(ONE).alias("n")).select(F.lit(kind).alias("kind"), "n")
        n = one if n is None else n.unionByName(one)
    return n.withColumn("base", F.sum("n").over(Window.orderBy("kind")) - F.col("n"))  # three rows


@query("page_docs", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(20)


@query("top_queries", W + " SELECT policy, count(*) AS n FROM supports GROUP BY 1 ORDER BY n DESC, policy LIMIT 25")
def _(spark, d):
    return S.supports(spark, d).groupBy("policy").agg(F.count(ONE).alias("n")).orderBy(F.desc("n"), "policy").limit(25)


# sets -----------------------------------------------------------------------------------------------------------


@query("set_union_edges", W + " SELECT DISTINCT src, dst FROM (SELECT policy AS src, si AS dst FROM targets UNION ALL SELECT child, t.si FROM transmits JOIN targets t ON t.policy = parent)")
def _(spark, d):
    t = S.targets(spark, d).select(F.col("policy").alias("src"), F.col("si").alias("dst"))
    return t.unionByName(S.transmits(spark, d).join(t.withColumnRenamed("src", "parent"), "parent").select(F.col("child").alias("src"), "dst")).distinct()


@query("set_intersect", W + " SELECT policy, count(*) AS tp FROM (SELECT policy, si FROM targets INTERSECT SELECT policy, si FROM supports JOIN enterprises USING (enterprise)) GROUP BY 1")
def _(spark, d):
    gt = S.supports(spark, d).join(S.enterprises(spark, d), "enterprise").select("policy", "si").distinct()
    return S.targets(spark, d).select("policy", "si").join(gt, ["policy", "si"], "left_semi").groupBy("policy").agg(F.count(ONE).alias("tp"))


# joins ----------------------------------------------------------------------------------------------------------


@query("join_title_exact_norm", r"SELECT a.o_orderkey, coalesce(x.p_partkey, y.p_partkey) AS hit FROM (SELECT o_orderkey, 'Part ' || o_orderkey % 300 AS t FROM orders) a LEFT JOIN (SELECT p_name, max(p_partkey) AS p_partkey FROM part GROUP BY 1) x ON x.p_name = a.t LEFT JOIN (SELECT regexp_replace(lower(p_name), '\s+', '', 'g') AS k, max(p_partkey) AS p_partkey FROM part GROUP BY 1) y ON y.k = regexp_replace(lower(a.t), '\s+', '', 'g')")
def _(spark, d):
    bare = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    a = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Part "), F.col("o_orderkey") % 300).alias("t"))
    p = table(spark, d, "part").select("p_partkey", "p_name")
    x = p.groupBy(F.col("p_name").alias("t")).agg(F.max("p_partkey").alias("x"))  # the last one wins
    y = p.groupBy(bare("p_name").alias("k")).agg(F.max("p_partkey").alias("y"))
    return a.join(x, "t", "left").withColumn("k", bare("t")).join(y, "k", "left").select("o_orderkey", F.coalesce("x", "y").alias("hit"))


@query("join_industry_policies", W + " SELECT DISTINCT si, policy FROM enterprises JOIN supports USING (enterprise)")
def _(spark, d):
    return S.enterprises(spark, d).join(S.supports(spark, d), "enterprise").select("si", "policy").distinct()


@query("join_attr_supplement", "SELECT c_custkey, coalesce(nullif(s_acctbal, 0), c_acctbal, 0) AS v, s_acctbal IS NOT NULL AS given FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def _(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    return table(spark, d, "customer").join(s, "c_custkey", "left").select("c_custkey", F.coalesce(F.nullif("s_acctbal", F.lit(0.0)), "c_acctbal", F.lit(0.0)).alias("v"), F.col("s_acctbal").isNotNull().alias("given"))


@query("join_batch_nodes", "SELECT i AS pos, k AS node, p_brand AS brand FROM (SELECT unnest([5, 3, 999999, 5]) AS k, unnest([0, 1, 2, 3]) AS i) LEFT JOIN part ON p_partkey = k")
def _(spark, d):
    asked = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (5, 3, 999999, 5)))).alias("pos", "node"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("brand"))
    return asked.join(p, "node", "left").select("pos", "node", "brand")


@query("join_filtered_link", W + " SELECT t.policy, e.enterprise FROM targets t JOIN enterprises e USING (si) EXCEPT SELECT policy, enterprise FROM supports")
def _(spark, d):
    aim, member = P.aims(S.targets(spark, d)), P.members(S.enterprises(spark, d))
    known = P.sided(S.supports(spark, d, targeted=True), aim, member).where("si is not null")
    return P.pairs(aim, member, known)


# graph maintenance ----------------------------------------------------------------------------------------------


@query("graph_upsert_node", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type", "value", "event_id")
    return M.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id").drop("event_id")


@query("graph_delete_node", W + " SELECT src, dst FROM edges WHERE src NOT IN (SELECT 'S' || n_nationkey FROM nation WHERE n_regionkey = 0) AND dst NOT IN (SELECT 'S' || n_nationkey FROM nation WHERE n_regionkey = 0)")
def _(spark, d):
    gone = table(spark, d, "nation").where("n_regionkey = 0").select(F.concat(F.lit("S"), "n_nationkey").alias("node"))
    return M.delete_nodes(S.message_edges(spark, d), gone).select("src", "dst")


@query("graph_node_edges", W + " SELECT src, dst FROM edges WHERE src = 'S3' OR dst = 'S3'")
def _(spark, d):
    return S.message_edges(spark, d).where("src = 'S3' or dst = 'S3'").select("src", "dst")


@query("graph_merge_entities", "WITH " + LINKS + ", a AS (SELECT CASE WHEN src IN ('N1', 'N2', 'N3') THEN 'N0' ELSE src END AS s, CASE WHEN dst IN ('N1', 'N2', 'N3') THEN 'N0' ELSE dst END AS t, weight FROM links) SELECT least(s, t) AS src, greatest(s, t) AS dst, sum(weight) AS weight FROM a WHERE s <> t GROUP BY 1, 2")
def _(spark, d):
    alias = spark.createDataFrame([(f"N{k}", "N0") for k in (1, 2, 3)], "node string, target string")
    return M.merge_entities(_links(spark, d), F.broadcast(alias))


@query("graph_delete_doc", "WITH m AS (SELECT DISTINCT l_partkey AS key, l_suppkey AS source FROM lineitem) SELECT key, count(*) FILTER (WHERE source % 3 > 0) AS \"left\", CASE WHEN count(*) FILTER (WHERE source % 3 > 0) = 0 THEN 'delete' WHEN count(*) FILTER (WHERE source % 3 = 0) > 0 THEN 'rebuild' ELSE 'keep' END AS action FROM m GROUP BY 1")
def _(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("source"))
    return M.delete_document(items, table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("source")))


@query("ontology_merge", W + " SELECT policy, CASE WHEN si = 11 THEN 7 ELSE si END AS si, round(max(conf), 6) AS conf FROM targets GROUP BY 1, 2")
def _(spark, d):
    return S.targets(spark, d).groupBy("policy", F.when(F.col("si") == 11, 7).otherwise(F.col("si")).alias("si")).agg(F.round(F.max("conf"), 6).alias("conf"))


@query("ontology_validate", W + " SELECT 'no_parent' AS violation, count(*) AS n FROM targets WHERE si NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'self_loop', count(*) FROM edges WHERE src = dst UNION ALL SELECT 'no_industry', count(*) FROM enterprises WHERE si IS NULL")
def _(spark, d):
    orphan = S.targets(spark, d).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("si")), "si", "left_anti")
    count = lambda name, df: df.agg(F.count(ONE).alias("n")).select(F.lit(name).alias("violation"), "n")
    return count("no_parent", orphan).unionByName(count("self_loop", S.message_edges(spark, d).where("src = dst"))).unionByName(count("no_industry", S.enterprises(spark, d).where("si is null")))


@query("graph_khop", W + ", a AS (SELECT DISTINCT policy, 'S' || si AS node FROM targets), b AS (SELECT DISTINCT policy, dst AS node FROM a JOIN edges ON src = node) SELECT policy, node FROM a UNION SELECT policy, node FROM b")
def _(spark, d):
    a = S.targets(spark, d).select("policy", F.concat(F.lit("S"), "si").alias("node")).distinct()
    e = S.message_edges(spark, d).select(F.col("src").alias("node"), "dst").distinct()
    return a.unionByName(a.join(e, "node").select("policy", F.col("dst").alias("node"))).distinct()


@query("graph_caps", W + ", g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1), top AS (SELECT node FROM g WHERE n >= 2 ORDER BY n DESC, node LIMIT 100) SELECT src, dst FROM edges WHERE src IN (FROM top) AND dst IN (FROM top)")
def _(spark, d):
    e = S.message_edges(spark, d)
    top = F.broadcast(G.degrees(e).where("degree >= 2").orderBy(F.desc("degree"), "node").limit(100).select("node"))  # 100 rows
    return e.join(top.withColumnRenamed("node", "src"), "src", "left_semi").join(top.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


# scores, evaluation ---------------------------------------------------------------------------------------------


@query("vec_l2norm", "SELECT vec_id, round(v[1] / greatest(sqrt(list_dot_product(v, v)), 1e-8), 5) AS a, round(v[64] / greatest(sqrt(list_dot_product(v, v)), 1e-8), 5) AS b FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", V.l2_normalize("embedding").alias("u"))
    return e.select("vec_id", F.round(F.col("u")[0], 5).alias("a"), F.round(F.col("u")[63], 5).alias("b"))


@query("score_degree_comp", W + " SELECT enterprise, round(capital * count(*) OVER (PARTITION BY si), 4) AS s FROM enterprises")
def _(spark, d):
    e = S.enterprises(spark, d)
    return e.join(e.groupBy("si").agg(F.count(ONE).alias("n")), "si").select("enterprise", F.round(F.col("capital") * F.col("n"), 4).alias("s"))


@query("score_delta", W + " SELECT policy, round(abs(level - avg(level) OVER ()), 6) AS delta, round(level * exp(-0.1 * greatest(0, 2001 - year)), 6) AS decayed FROM policies")
def _(spark, d):
    p = S.policies(spark, d)
    mean = F.broadcast(p.agg(F.avg("level").alias("m")))  # one row
    return p.crossJoin(mean).select("policy", F.round(F.abs(F.col("level") - F.col("m")), 6).alias("delta"), F.round(F.col("level") * F.exp(-0.1 * F.greatest(F.lit(0), 2001 - F.col("year"))), 6).alias("decayed"))


@query("references", "SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(ONE).alias("n"), F.min("doc_id").alias("first"))


@query("recall_at_k", "WITH r AS (SELECT o_custkey AS qid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderstatus = 'F' AS hit FROM orders), q AS (SELECT qid, " + ", ".join(f"CASE WHEN count(*) FILTER (WHERE hit) > 0 THEN count(*) FILTER (WHERE hit AND rank <= {k}) / count(*) FILTER (WHERE hit) ELSE 0 END AS r{k}" for k in (1, 5, 10, 20)) + " FROM r GROUP BY 1) SELECT " + ", ".join(f"round(avg(r{k}), 4) AS r{k}" for k in (1, 5, 10, 20)) + " FROM q")
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("hit"))
    all_ = F.count(F.when(F.col("hit"), 1))
    at = lambda k: F.when(all_ > 0, F.count(F.when(F.col("hit") & (F.col("rank") <= k), 1)) / all_).otherwise(0.0).alias(f"r{k}")
    return R.rank(o).groupBy("qid").agg(*map(at, (1, 5, 10, 20))).agg(*[F.round(F.avg(f"r{k}"), 4).alias(f"r{k}") for k in (1, 5, 10, 20)])


@query("lp_metrics", "WITH s AS (SELECT l_returnflag AS r, l_partkey AS t, round(sum(l_quantity), 2) AS s FROM lineitem GROUP BY 1, 2), k AS (SELECT r, rank() OVER (PARTITION BY r ORDER BY s DESC) AS k FROM s) SELECT r, round(avg(1 / k), 6) AS mrr, round(avg(k), 4) AS mr, " + ", ".join(f"round(avg((k <= {n})::INT), 6) AS hits{n}" for n in (1, 3, 10)) + " FROM k GROUP BY 1")
def _(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("r"), F.col("l_partkey").alias("t")).agg(F.round(F.sum("l_quantity"), 2).alias("s"))
    k = s.withColumn("k", F.rank().over(Window.partitionBy("r").orderBy(F.desc("s"))))
    return k.groupBy("r").agg(F.round(F.avg(1 / F.col("k")), 6).alias("mrr"), F.round(F.avg("k"), 4).alias("mr"), *[F.round(F.avg((F.col("k") <= n).cast("int")), 6).alias(f"hits{n}") for n in (1, 3, 10)])


@query("qa_f1", r"WITH a AS (SELECT item_id, t, count(*) AS n FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS t FROM benchmark) WHERE t <> '' GROUP BY 1, 2), z AS (SELECT item_id, sum(n) AS n FROM a GROUP BY 1) SELECT x.item_id, round(2.0 * sum(least(x.n, y.n)) / (any_value(zx.n) + any_value(zy.n)), 6) AS f1 FROM a x JOIN a y ON y.item_id = x.item_id + 1 AND x.t = y.t JOIN z zx ON zx.item_id = x.item_id JOIN z zy ON zy.item_id = x.item_id + 1 GROUP BY 1")
def _(spark, d):
    a = table(spark, d, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("t")).where("t <> ''").groupBy("item_id", "t").agg(F.count(ONE).alias("n"))
    z = a.groupBy("item_id").agg(F.sum("n").alias("z"))
    before = lambda df, *names: df.select((F.col("item_id") - 1).alias("item_id"), *[F.col(c).alias(o) for c, o in names])
    both = a.join(before(a, ("t", "t"), ("n", "m")), ["item_id", "t"]).groupBy("item_id").agg(F.sum(F.least("n", "m")).alias("s"))
    return both.join(z, "item_id").join(before(z, ("z", "y")), "item_id").select("item_id", F.round(2.0 * F.col("s") / (F.col("z") + F.col("y")), 6).alias("f1"))


@query("triple_threshold", "WITH t AS (SELECT value AS s, (event_type = 'click')::INT AS y FROM events), g AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS q FROM t GROUP BY 1), c AS (SELECT s, sum(p) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) + sum(q) OVER () - sum(q) OVER (ORDER BY s ROWS UNBOUNDED PRECEDING) AS ok FROM g) SELECT s AS threshold, ok::BIGINT AS correct FROM c ORDER BY ok DESC, s LIMIT 1")
def _(spark, d):
    """The score up to which rows count as true that makes most labels right. Scores are summed in ranges first."""
    t = table(spark, d, "events").select(F.col("value").alias("s"), (F.col("event_type") == "click").cast("int").alias("y"))
    g = t.groupBy("s").agg(F.sum("y").alias("p"), (F.count(ONE) - F.sum("y")).alias("q")).withColumn("b", F.floor("s"))
    ranges = g.groupBy("b").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.select("b", F.coalesce(F.sum("p").over(upto), F.lit(0)).alias("bp"), F.coalesce(F.sum("q").over(upto), F.lit(0)).alias("bq"))
    total = t.agg((F.count(ONE) - F.sum("y")).alias("all_q"))
    w = Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    ok = F.col("bp") + F.sum("p").over(w) + F.col("all_q") - F.col("bq") - F.sum("q").over(w)
    return g.join(base, "b").crossJoin(F.broadcast(total)).select(F.col("s").alias("threshold"), ok.cast("long").alias("correct")).orderBy(F.desc("correct"), "threshold").limit(1)


@query("inc_enqueue", "SELECT doc_id, 'doc-' || md5(text) AS id, CASE WHEN k = 1 THEN 'PENDING' ELSE 'DUPLICATE' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.md5_id("doc-", F.col("text")).alias("id"))
    first = docs.groupBy("id").agg(F.min("doc_id").alias("first"))  # combined early: a text of many copies is one row
    return docs.join(first, "id").select("doc_id", "id", F.when(F.col("doc_id") == F.col("first"), "PENDING").otherwise("DUPLICATE").alias("status"))


@query("inc_status", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def _(spark, d):
    done = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id").join(done, "doc_id", "left_anti")
