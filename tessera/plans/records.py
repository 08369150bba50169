"""Imputed agencies, extraction records, cached extractions and stored embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import agency as A
from tessera.functions import chunking as C
from tessera.functions import text as X
from tessera.plans.registry import registry
from tessera.sources import files
from tessera.sources.surrogate import table

QUERIES, ORACLES, query = registry()

IMPUTED = """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '广东省财政厅 广东省科学技术厅' WHEN 1 THEN '国家能源局' WHEN 2 THEN '财政部 教育部 公安部'
WHEN 3 THEN '全国人民代表大会常务委员会' WHEN 4 THEN '江苏省商务厅' END AS agency FROM customer"""


@query("impute_agency", IMPUTED)
def _(spark, d):
    k = F.col("c_custkey") % 6
    title = F.when(k == 0, F.concat(F.lit("广东省财政厅 广东省科学技术厅关于"), "c_name")).otherwise(F.col("c_name"))
    content = F.when(k == 1, F.concat(F.lit("国家能源局关于印发"), "c_name"))
    content = content.when(k == 2, F.concat("c_name", F.lit(": 财政部, 教育部, 财政部, 公安部, 司法部")))
    content = content.when(k == 3, F.concat("c_name", F.lit(" 人民共和国 第十届全国人民代表大会常务委员会第三次会议通过")))
    interpretation = F.when(k == 4, F.concat("c_name", F.lit(" 根据江苏省商务厅发布的")))
    return table(spark, d, "customer").select("c_custkey", A.impute_agency(title, content, interpretation).alias("agency"))


@query("fix_delimiters", "SELECT p_partkey, p_name || '<|#|>' || p_brand || '<|#|>' || p_partkey AS record FROM part")
def _(spark, d):
    forms = ("<|#|>", "<|##|>", "<|#||#|>", r"<|\#|>", "<|>", "<x|#|y>", "<#>", "<|#>", "<|#x>", "<|#||", "<|#:", "<||#>", "<||", "|#|>", "||#||", "<|#|>|")
    form = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("p_partkey") % len(forms) + 1).cast("int"))
    raw = F.concat("p_name", form, "p_brand", form, F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", X.fix_delimiters(raw).alias("record"))


@query("parse_entity_record", "SELECT p_partkey, p_name AS name, lower(replace(p_brand, ' ', '')) AS kind, 'of ' || p_partkey AS description FROM part WHERE p_partkey % 4 IN (0, 1)")
def _(spark, d):
    k = F.col("p_partkey") % 4
    kind = F.when(k == 1, F.concat(F.lit(" , "), "p_brand", F.lit(",x"))).when(k == 2, F.concat("p_brand", F.lit("/x"))).otherwise(F.col("p_brand"))
    of = F.when(k == 3, " ").otherwise(F.concat(F.lit(" of "), F.col("p_partkey").cast("string")))
    raw = F.concat_ws("<|#|>", F.lit("entity"), "p_name", kind, of)
    rows = table(spark, d, "part").select("p_partkey", X.entity_record(raw).alias("r")).where("r is not null")
    return rows.select("p_partkey", "r.name", "r.kind", "r.description")


@query("openie_pending", "SELECT DISTINCT 'chunk-' || md5(text) AS idx FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def _(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    done = files.pending(docs.where("doc_id % 2 = 0"), docs.select(F.lit("").alias("idx")).limit(0), "text")
    return files.pending(docs, done, "text").select("idx").distinct()


@query("embedding_store", "SELECT DISTINCT 'nation-' || md5(n_name) AS hash_id, n_name AS content, n_nationkey::DOUBLE AS first FROM nation WHERE n_regionkey <> 0")
def _(spark, d):
    rows = table(spark, d, "nation").select("n_regionkey", F.col("n_name").alias("content"), F.array(F.col("n_nationkey").cast("double")).alias("embedding"))
    store = files.new_embeddings(None, rows.where("n_regionkey = 0"), "nation-")
    return files.new_embeddings(store, rows.unionByName(rows), "nation-").select("hash_id", "content", F.col("embedding")[0].alias("first"))


_WINDOWS = """SELECT doc_id, ({first} + i)::INT AS chunk_order_index, least({size}, length(part) - i * {step})::INT AS tokens,
regexp_replace(regexp_replace(substr(part, i * {step} + 1, {size}), '^[\x09-\x0D\x20]+', ''), '[\x09-\x0D\x20]+$', '') AS content"""


@query("chunk_text", _WINDOWS.format(first=0, size=1200, step=1100) + """
FROM (SELECT doc_id, text AS part, unnest(range((length(text) + 1099) // 1100)) AS i FROM documents)""")
def _(spark, d):
    """Windows of 1,200 tokens that overlap by 100; a character is a token here."""
    return C.chunk(table(spark, d, "documents"), "text", "doc_id")


@query("chunk_text_parts", """WITH p AS (SELECT doc_id, unnest(string_split(text, '. ')) AS part, generate_subscripts(string_split(text, '. '), 1) AS k FROM documents WHERE text <> ''),
n AS (SELECT *, CASE WHEN length(part) <= 300 THEN 1 ELSE (length(part) + 249) // 250 END AS n FROM p),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM n) """
+ _WINDOWS.format(first="first", size=300, step=250) + " FROM (SELECT *, unnest(range(n)) AS i FROM w)")
def _(spark, d):
    """Sentences; those of over 300 tokens in windows that overlap by 50."""
    return C.chunk(table(spark, d, "documents"), "text", "doc_id", size=300, overlap=50, separator=". ")
