"""Secret scanning with corpus-wide ownership frequency, in DataFrame operations only.

Base spans, leftmost and non-overlapping for each kind: assign (a password-like name, = or :, a value of 6 or more
characters), access (AKIA and 16 or more of A-Z0-9) and hex (24 or more of 0-9a-f). Further candidates are bare
tokens of 20 or more base64-like characters that mix upper case, lower case and digits and touch no base span.

The SHA-256 of every candidate value is counted over the whole corpus by distinct repositories (documents) and
owners (sources). A value that more than ``most_owners`` owners or ``most_repositories`` repositories hold is a widely
copied example; one that few hold and that has no placeholder word is live-looking. Bare tokens are added as spans of kind ``owned`` if they are
live-looking; base spans always stay, and are only counted as live or example.

Null text counts as empty; a null source is an owner of its own. Repeated rows each get their result. Counting goes
from (value, owner, repository) over (value, owner) to (value), combined before each shuffle, so that a value with
a third of all copies is never gathered in one task. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_counted, materialize, table

KINDS = ("assign", "access", "hex", "owned")
#: (?i:) folds ASCII letters only in Java.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are matched whole, so their least length can be part of the pattern.
ACCESS, HEX, BARE = r"AKIA[A-Z0-9]{16,}", r"(?<![0-9a-f])[0-9a-f]{24,}", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
PLACEHOLDER = r"(?i)example|sample|placeholder|changeme|dummy|redacted|your|xxxx|0000000|1234567"
_SPAN = "struct<s:int,k:int,e:int,v:string>"


def _spans(text: Column, pattern: str, kind: int, value, keep=None) -> Column:
    """Spans in code points: the text between the matches gives their places."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def step(acc, x):
        start = acc["at"] + x["g"]
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), (start + F.char_length(x["m"])).alias("e"), value(x["m"]).alias("v")).cast(_SPAN)
        return F.struct((start + F.char_length(x["m"])).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    found = F.when(F.size(matches) > 0, found).otherwise(none)
    return F.filter(found, keep) if keep else found


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def candidates(docs: DataFrame, ident: str = "doc_id", text: str = "text", owner: str = "source") -> DataFrame:
    """(doc_id, owner, base, bare, sig) of every row; sig is equal where all candidate values are."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit("")).alias("owner"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    whole = lambda m: m
    t = F.col("text")
    base = F.concat(
        _spans(t, ASSIGN, 0, lambda m: F.regexp_extract(m, ASSIGN, 2), lambda x: F.char_length(x["v"]) >= 6),
        _spans(t, ACCESS, 1, whole),
        _spans(t, HEX, 2, whole),
    )
    mixed = lambda x: x["v"].rlike("[A-Z]") & x["v"].rlike("[a-z]") & x["v"].rlike("[0-9]") & ~x["v"].rlike(PLACEHOLDER)
    rows = rows.select("doc_id", "owner", base.alias("base"), _spans(t, BARE, 3, whole, mixed).alias("bare"))
    apart = lambda x: ~F.exists("base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"]))
    rows = rows.withColumn("bare", F.filter("bare", apart))
    values = F.array_join(F.transform(F.concat("base", "bare"), lambda x: x["v"]), " ")
    sig = F.sha2(values, 256)
    return rows.select("doc_id", "owner", "base", "bare", sig.alias("sig"))


def ownership(found: DataFrame) -> DataFrame:
    """(value_sha256, owners, repositories) of every candidate value in the corpus."""
    held = found.select("owner", "doc_id", F.explode(F.array_distinct(F.transform(F.concat("base", "bare"), lambda x: F.sha2(x["v"], 256)))).alias("value_sha256"))
    by_owner = held.distinct().groupBy("value_sha256", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("value_sha256").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, ident: str = "doc_id", text: str = "text", owner: str = "source", most_owners: int = 2, most_repositories: int = 10) -> DataFrame:
    """doc_id, the counts by kind, base_sha256, spans, n_live and n_example of every row."""
    found = materialize(candidates(docs, ident, text, owner), "secrets")
    values = F.transform(F.concat("base", "bare"), lambda x: F.sha2(x["v"], 256))
    lists = materialize(found.where("size(base) + size(bare) > 0").select("sig", values.alias("values")).groupBy("sig").agg(F.min("values").alias("values"), F.count(F.lit(1)).alias("n")), "secret-lists")
    few = ownership(found).where((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories))
    live = lists.select("sig", F.explode(F.array_distinct("values")).alias("value_sha256")).join(few, "value_sha256").groupBy("sig").agg(F.collect_set("value_sha256").alias("live"))
    # Only short lists are sent to every task; a long one comes with long rows, of which few are frequent.
    live = lists.select("sig", F.when(F.size("values") <= 256, F.col("n")).otherwise(1).alias("n")).join(live, "sig", "left")
    some = F.size("base") + F.size("bare") > 0
    rows = join_counted(found.where(some), materialize(live, "live-secrets"), ["sig"])
    rows = rows.unionByName(found.where(~some), allowMissingColumns=True)  # without candidates there is nothing to look up
    few = lambda x: F.coalesce(F.array_contains("live", F.sha2(x["v"], 256)), F.lit(False))
    looks_live = lambda x: few(x) & ~x["v"].rlike(PLACEHOLDER)
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long")
    every = F.concat("base", F.filter("bare", looks_live))
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(every).alias("spans"),
        F.size(F.filter(every, looks_live)).cast("long").alias("n_live"), F.size(F.filter("base", lambda x: ~looks_live(x))).cast("long").alias("n_example"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_kind(k: int, pattern: str, value: str = "m", keep: str = "true") -> str:
    pattern = pattern.replace("'", "''")
    return f"""
SELECT * FROM (SELECT rid, doc_id, source, {k} AS k, s, s + length(m) AS e, {value} AS v FROM (
  SELECT rid, doc_id, source, ms[i] AS m, cast(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INT) AS s
  FROM (SELECT rid, doc_id, source, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM d), unnest(range(1, len(ms) + 1)) AS u(i))) WHERE {keep}"""


def _sql_words(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_A = "(" + _sql_words("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
QUERIES = {"op10_secrets": op10_secrets}
ORACLES = {
    "op10_secrets": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS source, coalesce(text, '') AS text FROM documents),
base AS ({_sql_kind(0, _A, "regexp_extract(m, '" + _A.replace("'", "''") + "', 2)", "length(v) >= 6")} UNION ALL {_sql_kind(1, "AKIA[A-Z0-9]{16,}")} UNION ALL {_sql_kind(2, "[0-9a-f]{24,}")}),
token AS ({_sql_kind(3, "[A-Za-z0-9+/_=-]{20,}")}),
bare AS (SELECT * FROM token t WHERE regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '{PLACEHOLDER}')
         AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = t.rid AND b.s < t.e AND t.s < b.e)),
freq AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT (source, doc_id)) AS repositories FROM (SELECT v, source, doc_id FROM base UNION ALL SELECT v, source, doc_id FROM bare) GROUP BY v),
marked AS (SELECT x.*, owners <= 2 AND repositories <= 10 AND NOT regexp_matches(v, '{PLACEHOLDER}') AS live FROM (SELECT * FROM base UNION ALL SELECT * FROM bare) x JOIN freq USING (v)),
agg AS (SELECT rid, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  coalesce(string_agg(concat(['assign', 'access', 'hex'][k + 1], ':', s, ':', e), ',' ORDER BY s, k) FILTER (WHERE k < 3), '') AS bs,
  coalesce(string_agg(concat(['assign', 'access', 'hex', 'owned'][k + 1], ':', s, ':', e), ',' ORDER BY s, k) FILTER (WHERE k < 3 OR live), '') AS spans,
  count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE k < 3 AND NOT live) AS n_example FROM marked GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example FROM d LEFT JOIN agg USING (rid)
"""
}
