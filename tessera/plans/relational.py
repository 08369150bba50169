"""Sources, cleaning, joins, aggregates, windows, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import rank as R
from tessera.plans.registry import registry
from tessera.sources import surrogate as S
from tessera.sources.surrogate import SQL, table

QUERIES, ORACLES, query = registry()
W = f"WITH {SQL}"


# cleaning -------------------------------------------------------------------------------------------------------


@query("normalize_text", r"SELECT doc_id, regexp_replace(trim(text), '[\s　 ]+', '', 'g') AS norm FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("norm"))


@query("info_chars", r"""SELECT doc_id, length(regexp_replace(regexp_replace(text, '[\s　 ]+', '', 'g'), '[,.;:!?()\[\]"''|/-]', '', 'g')) AS n FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.info_chars(F.col("text")).cast("long").alias("n"))


@query("classify_row", r"""SELECT doc_id, (text ILIKE '%the%' OR text ILIKE '%der%') AS has_keyword, (length(text) < 200 AND regexp_matches(text, '^[A-Z]')) OR length(regexp_replace(text, '\s+', '', 'g')) < 50 AS shell FROM documents""")
def _(spark, d):
    t = F.col("text")
    shell = ((F.char_length(t) < 200) & t.rlike("^[A-Z]")) | (F.char_length(F.regexp_replace(t, r"\s+", "")) < 50)
    return table(spark, d, "documents").select("doc_id", t.rlike("(?i)the|der").alias("has_keyword"), shell.alias("shell"))


@query("text_processing", "SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g')) AS t FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.text_processing(F.col("text")).alias("t"))


BARE = r"""regexp_replace(lower(text), '[!"#$%&''()*+,./:;<=>?@\[\\\]^_`{|}~-]', '', 'g')"""
ARTICLE = r"'(^|[^\p{L}\p{N}_])(a|an|the)([^\p{L}\p{N}_]|$)', '\1 \3', 'g'"


@query("normalize_answer", rf"SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace({BARE}, {ARTICLE}), {ARTICLE}), '\s+', ' ', 'g')) AS t FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.normalize_answer(F.col("text")).alias("t"))


@query("doc_summary", "SELECT doc_id, CASE WHEN length(trim(text)) > 250 THEN substr(trim(text), 1, 250) || '...' ELSE trim(text) END AS summary FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.doc_summary(F.col("text")).alias("summary"))


@query("md5_id", "SELECT doc_id, 'doc-' || md5(text) AS id FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", X.md5_id("doc-", F.col("text")).alias("id"))


@query("relation_key", "SELECT DISTINCT least(c_mktsegment, n_name) || '<SEP>' || greatest(c_mktsegment, n_name) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(X.relation_key(F.col("c_mktsegment"), F.col("n_name")).alias("k")).distinct()


@query("parse_capital", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN floor(abs(c_acctbal)) WHEN floor(abs(c_acctbal)) * 7 > 10000 THEN floor(abs(c_acctbal)) * 7 / 10000 ELSE floor(abs(c_acctbal)) * 7 END AS capital FROM customer")
def _(spark, d):
    n = F.floor(F.abs("c_acctbal"))
    raw = F.when(F.col("c_custkey") % 3 == 0, F.concat(n.cast("string"), F.lit("万(元)"))).otherwise(F.concat((n * 7).cast("string"), F.lit("元")))
    return table(spark, d, "customer").select("c_custkey", X.parse_capital(raw).alias("capital"))


@query("scale_bin", "SELECT c_custkey, CASE WHEN c_acctbal < 5 THEN 0 WHEN c_acctbal < 20 THEN 1 WHEN c_acctbal < 100 THEN 2 ELSE 3 END AS bin FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.scale_bin(F.col("c_acctbal")).alias("bin"))


@query("safe_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '2024-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def _(spark, d):
    raw = F.when(F.col("o_orderkey") % 5 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    return table(spark, d, "orders").select("o_orderkey", X.safe_date(raw).alias("day"))


@query("chunking", "SELECT doc_id, (s // 80)::BIGINT AS chunk_order_index, substr(text, s + 1, 100) AS content, least(100, length(text) - s)::BIGINT AS tokens FROM documents, unnest(range(0, greatest(length(text), 1), 80)) AS u(s)")
def _(spark, d):
    c = table(spark, d, "documents").select("doc_id", F.explode(X.chunks(F.col("text"), 100, 20)).alias("c"))
    return c.select("doc_id", F.col("c.chunk_order_index").cast("long").alias("chunk_order_index"), "c.content", F.col("c.tokens").cast("long").alias("tokens"))


# joins ----------------------------------------------------------------------------------------------------------


@query("join_edge_index", W + "SELECT policy, si, n_regionkey AS mi FROM targets JOIN nation ON si = n_nationkey")
def _(spark, d):
    return S.targets(spark, d).join(table(spark, d, "nation"), F.col("si") == F.col("n_nationkey")).select("policy", "si", F.col("n_regionkey").alias("mi"))


@query("join_metapath", W + "SELECT policy, count(*) AS n FROM (SELECT DISTINCT policy, enterprise FROM targets JOIN enterprises USING (si) EXCEPT SELECT * FROM supports) GROUP BY policy")
def _(spark, d):
    # An enterprise has one sub-industry: a policy reaches the sum of its targets' sizes, less the supported among them.
    t, e = S.targets(spark, d).select("policy", "si").distinct(), S.enterprises(spark, d)
    reach = t.join(e.groupBy("si").agg(F.count(F.lit(1)).alias("size")), "si").groupBy("policy").agg(F.sum("size").alias("size"))
    held = S.supports(spark, d).join(e.select("enterprise", "si"), "enterprise").join(t, ["policy", "si"], "left_semi").groupBy("policy").agg(F.count(F.lit(1)).alias("held"))
    left = F.col("size") - F.coalesce("held", F.lit(0))
    return reach.join(held, "policy", "left").select("policy", left.alias("n")).where("n > 0")


@query("join_unmapped_audit", W + "SELECT p.policy, t.policy IS NULL AS no_target, r.child IS NULL AS no_parent FROM policies p LEFT JOIN (SELECT DISTINCT policy FROM targets) t USING (policy) LEFT JOIN transmits r ON p.policy = r.child")
def _(spark, d):
    t, r = S.targets(spark, d).select("policy", F.lit(True).alias("t")).distinct(), S.transmits(spark, d).select(F.col("child").alias("policy"), F.lit(True).alias("r"))
    return S.policies(spark, d).join(t, "policy", "left").join(r, "policy", "left").select("policy", F.col("t").isNull().alias("no_target"), F.col("r").isNull().alias("no_parent"))


@query("join_semi_valid", W + "SELECT policy, count(*) AS n FROM supports WHERE policy IN (SELECT policy FROM targets) GROUP BY policy")
def _(spark, d):
    return S.supports(spark, d).join(S.targets(spark, d), "policy", "left_semi").groupBy("policy").agg(F.count(F.lit(1)).alias("n"))


@query("join_citation", W + "SELECT p.policy, q.policy AS cited FROM policies p JOIN policies q ON p.brand = q.brand AND p.ptype = q.ptype AND q.year < p.year AND p.policy <> q.policy")
def _(spark, d):
    p = S.policies(spark, d)
    q = p.select(F.col("policy").alias("cited"), F.col("year").alias("cited_year"), "brand", "ptype")
    return p.join(q, ["brand", "ptype"]).where("cited_year < year and policy <> cited").select("policy", "cited")


# aggregates -----------------------------------------------------------------------------------------------------


@query("agg_majority", "SELECT k, v FROM (SELECT c_nationkey AS k, c_mktsegment AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, min(c_custkey)) AS r FROM customer GROUP BY 1, 2) WHERE r = 1")
def _(spark, d):
    by = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))
    return by.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "first"))).where("r = 1").select("k", "v")


@query("agg_upper_median", "SELECT c_nationkey AS si, list_sort(list(c_acctbal))[count(*) // 2 + 1] AS m FROM customer GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "customer")
    # Ranks instead of one array for each group.
    w = Window.partitionBy("c_nationkey")
    r = x.select("c_nationkey", "c_acctbal", F.row_number().over(w.orderBy("c_acctbal", "c_custkey")).alias("r"), F.count(F.lit(1)).over(w).alias("n"))
    return r.where("r = floor(n / 2) + 1").select(F.col("c_nationkey").alias("si"), F.col("c_acctbal").alias("m"))


@query("agg_count_by", "SELECT coalesce(o_orderstatus, 'all') AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus)")
def _(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "n")


@query("agg_best_per_key", W + "SELECT si, policy, round(conf, 6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY si ORDER BY conf DESC, policy) AS k FROM targets) WHERE k = 1")
def _(spark, d):
    w = Window.partitionBy("si").orderBy(F.desc("conf"), "policy")
    return S.targets(spark, d).withColumn("k", F.row_number().over(w)).where("k = 1").select("si", "policy", F.round("conf", 6).alias("conf"))


@query("agg_global_stats", "SELECT round(avg(o_totalprice), 2) AS mean, round(stddev_pop(o_totalprice), 2) AS std, min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, 0.5) AS med FROM orders")
def _(spark, d):
    x = "o_totalprice"
    return table(spark, d, "orders").agg(F.round(F.avg(x), 2).alias("mean"), F.round(F.stddev_pop(x), 2).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.percentile(x, F.lit(0.5)).alias("med"))


@query("agg_minmax", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w), 6) AS x FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
def _(spark, d):
    return R.minmax(table(spark, d, "customer"), "c_acctbal", "x", ("c_nationkey",)).select("c_custkey", F.round("x", 6).alias("x"))


@query("agg_tph_hpt", "SELECT l_returnflag AS r, round(count(*) / count(DISTINCT l_partkey), 6) AS tph, round(count(*) / count(DISTINCT l_suppkey), 6) AS hpt FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("r")).agg(F.round(F.count(F.lit(1)) / F.countDistinct("l_partkey"), 6).alias("tph"), F.round(F.count(F.lit(1)) / F.countDistinct("l_suppkey"), 6).alias("hpt"))


@query("agg_type_constraint", W + "SELECT si, count(DISTINCT policy) AS heads FROM targets GROUP BY si")
def _(spark, d):
    return S.targets(spark, d).groupBy("si").agg(F.countDistinct("policy").alias("heads"))


@query("agg_si_count", W + "SELECT enterprise, count(*) OVER (PARTITION BY si) AS n FROM enterprises")
def _(spark, d):
    e = S.enterprises(spark, d)
    return e.join(F.broadcast(e.groupBy("si").agg(F.count(F.lit(1)).alias("n"))), "si").select("enterprise", "n")  # one row for each nation


@query("agg_pareto", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size >= p.p_size AND q.p_retailprice >= p.p_retailprice AND (q.p_size > p.p_size OR q.p_retailprice > p.p_retailprice))")
def _(spark, d):
    p = table(spark, d, "part")
    tops = p.groupBy("p_size").agg(F.max("p_retailprice").alias("top"))  # few sizes
    over = tops.select("p_size", "top", F.max("top").over(Window.orderBy(F.desc("p_size")).rowsBetween(Window.unboundedPreceding, -1)).alias("above"))
    good = over.where("above is null or top > above").select("p_size", F.col("top").alias("p_retailprice"))
    return p.join(good, ["p_size", "p_retailprice"]).select("p_partkey")


# windows, sorting, sets -----------------------------------------------------------------------------------------


@query("win_series", """WITH y AS (SELECT o_custkey AS c, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2), g AS (SELECT c, yy AS y, n FROM (SELECT DISTINCT c FROM y) CROSS JOIN range(1995, 2002) r(yy) LEFT JOIN y USING (c) WHERE false UNION ALL
SELECT k.c, k.yy, y.n FROM (SELECT c, yy FROM (SELECT DISTINCT c FROM y) CROSS JOIN range(1995, 2002) r(yy)) k LEFT JOIN y ON k.c = y.c AND k.yy = y.y),
f AS (SELECT *, max(n IS NOT NULL) OVER a AS mask, last_value(n IGNORE NULLS) OVER a AS n0, last_value(CASE WHEN n IS NOT NULL THEN y END IGNORE NULLS) OVER a AS y0, first_value(n IGNORE NULLS) OVER b AS n1, first_value(CASE WHEN n IS NOT NULL THEN y END IGNORE NULLS) OVER b AS y1 FROM g
WINDOW a AS (PARTITION BY c ORDER BY y ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY c ORDER BY y ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT c, y::INT AS y, coalesce(mask, false)::INT AS mask, round(CASE WHEN NOT coalesce(mask, false) THEN 0 WHEN n1 IS NULL THEN n0 WHEN y1 = y0 THEN n0 ELSE n0 + (n1 - n0) * (y - y0) / (y1 - y0) END, 6) AS v FROM f""")
def _(spark, d):
    y = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c"), F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    grid = y.select("c").distinct().select("c", F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("y"))
    a = Window.partitionBy("c").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    b = Window.partitionBy("c").orderBy("y").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("n").isNotNull(), F.col("y"))
    f = grid.join(y, ["c", "y"], "left").select("c", "y", F.max(F.col("n").isNotNull()).over(a).alias("mask"), F.last("n", True).over(a).alias("n0"), F.last(at, True).over(a).alias("y0"), F.first("n", True).over(b).alias("n1"), F.first(at, True).over(b).alias("y1"))
    between = F.expr("n0 + (n1 - n0) * (y - y0) / (y1 - y0)")
    v = F.when(~F.col("mask"), 0.0).when(F.col("n1").isNull() | (F.col("y1") == F.col("y0")), F.col("n0")).otherwise(between)
    return f.select("c", "y", F.col("mask").cast("int").alias("mask"), F.round(v.cast("double"), 6).alias("v"))


@query("win_split", W + "SELECT split, count(*) AS n FROM (SELECT CASE WHEN k <= floor(n * 0.7) THEN 'train' WHEN k <= floor(n * 0.7) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM (SELECT row_number() OVER (ORDER BY policy, enterprise) AS k, count(*) OVER () AS n FROM supports)) GROUP BY 1")
def _(spark, d):
    s = S.supports(spark, d)
    # Exact shares without one global window: counts of policies give each its offset.
    per = s.groupBy("policy").agg(F.count(F.lit(1)).alias("m"))
    block = per.withColumn("b", F.floor(F.col("policy") / 1024))
    base = block.groupBy("b").agg(F.sum("m").alias("bm")).withColumn("boff", F.coalesce(F.sum("bm").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offs = block.join(base, "b").withColumn("off", F.col("boff") + F.coalesce(F.sum("m").over(Window.partitionBy("b").orderBy("policy").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("policy", "off")
    k = s.withColumn("r", F.row_number().over(Window.partitionBy("policy").orderBy("enterprise"))).join(offs, "policy").withColumn("k", F.col("off") + F.col("r"))
    n = s.agg(F.count(F.lit(1)).alias("n"))
    split = F.when(F.col("k") <= F.floor(F.col("n") * 0.7), "train").when(F.col("k") <= F.floor(F.col("n") * 0.7) + F.floor(F.col("n") * 0.1), "val").otherwise("test")
    return k.crossJoin(F.broadcast(n)).groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("win_token_budget", "SELECT o_custkey, o_orderkey FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS used FROM orders) WHERE used <= 500000")
def _(spark, d):
    return R.token_budget(table(spark, d, "orders"), 500000, "o_totalprice", "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("win_round_robin", "WITH a AS (SELECT c_nationkey AS q, c_custkey AS item, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS pos FROM customer), b AS (SELECT c_nationkey AS q, c_custkey AS item, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos FROM customer) SELECT q AS qid, item, row_number() OVER (PARTITION BY q ORDER BY min(o)) AS pos FROM (SELECT q, item, 2 * pos AS o FROM a UNION ALL SELECT q, item, 2 * pos + 1 FROM b) GROUP BY q, item")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("qid"), F.col("c_custkey").alias("item"), "c_acctbal")
    at = lambda *o: c.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*o)) - 1)
    return R.round_robin([at(F.desc("c_acctbal"), "item"), at("item")]).select("qid", "item", F.col("pos").cast("long").alias("pos"))


@query("top_popular", W + ", g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) SELECT node, degree FROM g ORDER BY degree DESC, node LIMIT 20")
def _(spark, d):
    from tessera.operators.graph import degrees

    return degrees(S.message_edges(spark, d)).orderBy(F.desc("degree"), "node").limit(20)


@query("top_label_search", "SELECT n_name, CASE WHEN lower(n_name) = 'nation_1' THEN 1000 WHEN starts_with(lower(n_name), 'nation_1') THEN 500 ELSE 100 - length(n_name) + CASE WHEN contains(lower(n_name), ' nation_1') OR contains(lower(n_name), '_nation_1') THEN 50 ELSE 0 END END AS score FROM nation WHERE contains(lower(n_name), 'nation_1')")
def _(spark, d):
    n = F.lower("n_name")
    score = F.when(n == "nation_1", 1000).when(n.startswith("nation_1"), 500).otherwise(100 - F.char_length("n_name") + F.when(n.contains(" nation_1") | n.contains("_nation_1"), 50).otherwise(0))
    return table(spark, d, "nation").where(n.contains("nation_1")).select("n_name", score.cast("long").alias("score"))


@query("page_keyset", "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 50")
def _(spark, d):
    return table(spark, d, "orders").where("o_orderkey > 100").select("o_orderkey").orderBy("o_orderkey").limit(50)


@query("set_except", W + "SELECT child AS policy FROM transmits EXCEPT SELECT policy FROM targets")
def _(spark, d):
    return S.transmits(spark, d).select(F.col("child").alias("policy")).distinct().join(S.targets(spark, d), "policy", "left_anti")


@query("kv_upsert", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("event_type"))


@query("kv_filter_keys", "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").distinct().join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("norm_title", "SELECT p_partkey, replace(p_name, ' ', '') AS t, 'part-' || p_partkey || ':x' AS k FROM part")
def _(spark, d):
    raw = F.concat(F.lit("【已失效】 "), "p_name")
    return table(spark, d, "part").select("p_partkey", X.norm_title(raw).alias("t"), X.cache_key(F.concat(F.lit("part-"), X.strip_bookmarks(F.concat(F.lit("《"), "p_partkey", F.lit("》")))), F.lit("x")).alias("k"))


@query("parse_insurance", "SELECT c_custkey, CASE WHEN c_acctbal > -1 THEN trunc(c_acctbal)::BIGINT END AS n FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.parse_insurance(F.concat(F.format_number("c_acctbal", 2), F.lit("人"))).alias("n"))


@query("parse_relation_record", "SELECT l_orderkey, l_linenumber, 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CASE WHEN l_returnflag = 'N' THEN 1 ELSE l_quantity END AS weight FROM lineitem")
def _(spark, d):
    last = F.when(F.col("l_returnflag") == "N", "high").otherwise(F.col("l_quantity").cast("string"))
    raw = F.concat_ws("<|#|>", F.lit("relationship "), F.concat(F.lit(" p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), F.lit("k"), F.lit("d"), last)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.relation_record(raw).alias("r")).where("r is not null").select("l_orderkey", "l_linenumber", "r.src", "r.dst", "r.weight")


@query("split_markers", "SELECT p_partkey, len(list_filter([p_name, p_brand], lambda x: x <> ''))::INT AS n, p_brand AS last FROM part")
def _(spark, d):
    parts = X.split_markers(F.concat_ws("##", F.lit(" "), "p_name", F.concat(F.lit("||"), "p_brand")), ["##", "||"])
    return table(spark, d, "part").select("p_partkey", F.size(parts).alias("n"), F.element_at(parts, -1).alias("last"))
