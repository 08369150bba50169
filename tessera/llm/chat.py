"""Collapse of cumulative conversation snapshots, then chat formatting.

Logged conversations often hold the same dialogue again and again, one turn longer each time. A rolling SHA-256
over (role, text) gives every turn prefix of a conversation its hash. A conversation whose whole hash is the hash of
a proper prefix of another is left out by an anti-join; of identical ones the smallest conv_id stays. What is left
is rendered.

Turns are taken by turn number, then role and text; a null turn comes first, null role and text count as empty but
differ from it in the hash. Turns of a null conv_id are one conversation. An empty table gives no rows. A
conversation is one row of the result, so its turns meet in one task; only hashes of different conversations are
compared, and equal ones are combined before each shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, hashes): the turns in order and the rolling hash after each."""
    rows = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # array_sort puts a null field first within a struct
    part = lambda x: F.coalesce(F.concat(F.char_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    roll = lambda acc, t: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), part(t["role"]), F.lit(" "), part(t["text"])), 256)))
    hashes = F.aggregate("turns", F.array(F.lit("")), roll)
    return whole.select("conv_id", "turns", F.slice(hashes, 2, F.size("turns")).alias("hashes"))


def maximal(convs: DataFrame) -> DataFrame:
    """(conv_id, n_copies) of the conversations that no longer one begins with."""
    whole = convs.groupBy(F.element_at("hashes", -1).alias("h")).agg(F.min(F.col("conv_id")).alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    proper = convs.select(F.explode(F.slice("hashes", F.lit(1), F.size("hashes") - 1)).alias("h")).distinct()
    return whole.join(proper, "h", "left_anti").select("conv_id", "n_copies")


def render(turns):
    """<|im_start|>role, the text and <|im_end|> for each turn."""
    one = lambda t: F.concat(F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>\n"))
    return F.array_join(F.transform(turns, one), "")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of every maximal conversation."""
    convs = materialize(conversations(turns), "conversations")
    kept = maximal(convs.select("conv_id", "hashes")).withColumnRenamed("conv_id", "kept_id")
    out = convs.join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "n_copies", render(F.col("turns")).alias("rendered"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


QUERIES = {"op3_chat": op3_chat}
ORACLES = {
    "op3_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
  coalesce(length(role) || ':' || role, '-') || ' ' || coalesce(length(text) || ':' || text, '-') AS part FROM conversations),
p AS (SELECT *, string_agg(part, chr(30)) OVER w AS prefix, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
whole AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE n = total GROUP BY prefix),
kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE n < total))
SELECT conv_id, max(total) AS n_turns, max(n_copies) AS n_copies, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY n) AS rendered
FROM p JOIN kept USING (conv_id) GROUP BY conv_id
"""
}
