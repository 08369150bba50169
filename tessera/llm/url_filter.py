"""URL filtering by hashed expressions, in DataFrame operations only.

Each distinct (host, path) is expanded into host-suffix and path-prefix expressions, as Safe-Browsing lists are
looked up: the expression's SHA-256 meets the rules on its first four bytes, then the full digest confirms. Of the
rules that fit, the longest expression wins; of equally long ones that with the longer host; of equal expressions
block wins. A url that no rule fits is allowed.

Only suffixes with as many labels as some rule's host, and prefixes as long as some rule's path, are made: both
sets are read off the rules (their sizes are bounded by the longest rule), so no expression that could match is
left out. Null urls and urls without ``://`` have an empty host and path and fit no rule. Repeated rows each get
their verdict. An empty table, or no rules, gives no rows, or only allowed ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialize, table

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    names = ("verdict", "host", "path")
    if not rules:
        return spark.range(0).select(*[F.lit(None).cast("string").alias(k) for k in names])
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, r)]) for r in rules])))


def parsed(pages: DataFrame, ident: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path): host after the first ``://`` up to / ? # with A-Z lowered, then the path up to ? or #."""
    rows = pages.select(F.col(ident).alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("__u"))
    rest = F.when(F.instr("__u", "://") > 0, F.expr("substring(__u, instr(__u, '://') + 3)")).otherwise(F.lit(""))
    rows = rows.select("page_id", F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1).alias("host"), F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2).alias("path"))
    return rows.withColumn("host", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def _digest(host, path):
    return F.sha2(F.concat(host, path), 256)


def judge(pairs: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of each (host, path) of ``pairs``, which are distinct, that some rule fits."""
    rules = rules.where("host is not null and host <> '' and path is not null")
    # Bounded by the longest rule, whatever the number of rules or pages.
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("labels"), F.collect_set(F.char_length("path")).alias("lengths")).first()
    lengths = F.array(*[F.lit(x) for x in sorted(shape["lengths"])]).cast("array<int>")
    distinct = pairs.select("host", "path").where("host <> ''")
    suffixes = F.expr(f"array_distinct(transform(array({', '.join(map(str, sorted(shape['labels']))) or 'cast(null as int)'}), k -> substring_index(host, '.', -k)))")
    prefixes = F.array_distinct(F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)))
    exprs = distinct.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(prefixes)).withColumn("digest", _digest(F.col("h"), F.col("p")))
    known = rules.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"), F.struct(
            F.char_length(F.concat("host", "path")).alias("n"), F.char_length("host").alias("hn"), (F.col("verdict") == "block").alias("block"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("verdict")
        ).alias("best"),
    ).withColumn("short", F.substring("rule_digest", 1, 8)).distinct()
    hits = exprs.withColumn("short", F.substring("digest", 1, 8)).join(known, "short").where("digest = rule_digest")
    return hits.groupBy("host", "path").agg(F.max("best").alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def url_filter(pages: DataFrame, rules: DataFrame, ident: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``."""
    rows = parsed(pages, ident, url)
    # Frequent urls, the empty one too, get their verdict where they are; only the others meet by (host, path).
    pairs = materialize(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")), "urls")
    judged = materialize(pairs.join(judge(pairs, rules), ["host", "path"], "left"), "judged-urls")
    out = join_counted(rows, judged, ["host", "path"])
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rules_frame(spark))


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {
    "op8_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM u),
r(v, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT s.*, r.*, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC, v DESC) AS k
      FROM s LEFT JOIN r ON (s.host = h OR suffix(s.host, '.' || h)) AND starts_with(s.path, p))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
}
