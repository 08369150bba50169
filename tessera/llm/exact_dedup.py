"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when they are identical after every ASCII white-space character is deleted. Copies are first
combined where they were read, then per (digest, salt), then the salts' winners per digest. The whole normalised
text is part of every grouping key, so content decides at each stage and the digest only places rows. The winners are joined
back to the rows with the largest groups' ones sent to every task, so their rows aren't gathered either. Of equal
texts the row with the most code points stays, then the one with the smallest id.

Null text counts as empty; all empty texts are one group. A null id ranks after every other id. Rows that repeat
an id and its text are one document: all of them are marked alike. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, join_counted, materialize, table

#: Ranks (code points, id) in one number that hash aggregation can keep in place: fewer is better.
_LEN, _ID, _HALF = 2147483648, 36893488147419103232, 9223372036854775808


def _dec(x):
    return x.cast("decimal(38,0)")


def _big(n: int):
    return F.lit(str(n)).cast("decimal(38,0)")


def _rank(length, ident):
    place = F.coalesce(_dec(ident) + _big(_HALF), _big(2 * _HALF))
    return ((_big(_LEN) - _dec(length)).cast("decimal(12,0)") * F.lit(str(_ID)).cast("decimal(22,0)")).cast("decimal(38,0)") + place


def _ident(rank):
    place = (rank % _big(_ID)).cast("decimal(38,0)")
    return F.when(place < _big(2 * _HALF), (place - _big(_HALF)).cast("long"))


def keyed(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, norm, digest, length) of every row; other columns are left out, so their names can't clash."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.regexp_replace(raw, f"{SPACES}+", "").alias("norm"), F.char_length(raw).alias("length"))
    return rows.withColumn("digest", F.unhex(F.sha2("norm", 256)))


def _best(rows: DataFrame, salts: int) -> DataFrame:
    """(digest, best, n, contents): the least rank and the number of rows of each content."""
    best, n = F.min("best").alias("best"), F.sum("n").alias("n")
    # The salt is the place of reading, so a task sends one row for each content however many copies it holds.
    local = rows.select("digest", "norm", (F.spark_partition_id() % salts).alias("salt"), _rank(F.col("length"), F.col("doc_id")).alias("best"), F.lit(1).cast("long").alias("n"))
    salted = local.groupBy("digest", "salt", "norm").agg(best, n)
    whole = salted.groupBy("digest", "norm").agg(best, n)
    return whole.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("contents"))


def _sole(x):
    """Two contents under one digest would be a SHA-256 collision: the job then fails rather than mix them."""
    return F.when(F.col("contents") == 1, x).otherwise(F.raise_error(F.lit("two contents under one digest")))


def winners(rows: DataFrame, salts: int = 16) -> DataFrame:
    """(digest, keep_id, group_size) of each content. ``rows`` as from keyed(), counted where they lie first."""
    return _best(rows, salts).select("digest", _ident(F.col("best")).alias("keep_id"), _sole(F.col("n")).alias("group_size"))


def exact_dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = keyed(docs, ident, text)
    best = materialize(winners(rows, salts).withColumn("n", F.col("group_size")), "winners")
    out = join_counted(rows.select("doc_id", "digest"), best, ["digest"])
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_unique(docs: DataFrame, ident: str = "doc_id", text: str = "text", salts: int = 16) -> DataFrame:
    """One row of ``docs`` for each content, with all its columns: the winner's, also where ids repeat or are null."""
    stay = _best(keyed(docs, ident, text), salts).select(F.col("digest").alias("__digest"), _sole(F.col("best")).alias("__best"))
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.regexp_replace(raw, f"{SPACES}+", ""), 256))
    ranked = docs.withColumns({"__digest": digest, "__best": _rank(F.char_length(raw), F.col(ident).cast("long"))})
    # Copies differ in rank, so a large group of them is spread over tasks; rows alike in both meet in one.
    return ranked.join(stay, ["__digest", "__best"], "left_semi").dropDuplicates(["__digest", "__best"]).drop("__digest", "__best")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(raw) DESC, doc_id ASC)
"""
}
