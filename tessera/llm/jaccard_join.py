"""Exact join of documents by the Jaccard similarity of their word n-grams, filtered under several token orders.

A pair is a link if 100 * |A & B| >= percent * |A | B|. Linked sets share a token within their first
n - ceil(percent * n / 100) + 1 tokens under ANY total order of all tokens, so a candidate has to share one under each of
``ORDERS`` different orders. Order i starts with the tokens of class i (the hash modulo CLASSES), the rarest first by their
exact document frequency, then come all others by a permuted hash. Frequencies are only counted for tokens of the
class, of documents that the orders before have left: a document whose prefix holds no token of another document can
have no link under that order and is out, which ends most documents at the first one.

Of equal sets one representative is searched. Where links are looked for, the prefix tokens of order 0 are the keys:

- stars: each document is compared with one document of its most frequent key, then, if the key still has documents
  that aren't connected, with another one. A large group of copies costs its size, not its square.
- blocks: all documents that a key still leaves apart are compared. Keys are merged by the key that most of their
  documents have as their most frequent one, so that documents who share many keys are compared once, and each key's
  documents meet in one group. A group is cut into blocks of some ``_BLOCK`` documents or ``_SHINGLES`` tokens. In two
  blocks the pairs that share prefix tokens under the other orders are found as products of matrices; only rows with
  such a pair are verified on their whole sets. Pairs are never rows. A group of documents just below the
  similarity costs its square at this stage, at some 10^-6 CPU seconds a pair.

Both filters and both ways of comparing are exact: nothing is sampled, capped or cut, and components are those of all links.

Words are split at ASCII white space and A-Z is lower-cased; a text of fewer words than ``words`` is one shingle. Null texts
and texts without words have an empty set and no link, not even to each other. A null id takes part: it is nobody's
component_id, and its own is null where it is alone. Rows that repeat an id are documents of their own. Tokens
are 64-bit hashes: two different shingles of a pair are taken for one with a chance of n * n / 2^64. Other columns are
ignored; an empty table gives no rows; ids are cast to long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, join_counted, materialize, table

ORDERS, CLASSES = 3, 5
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: Documents and tokens of a block, and columns of a matrix: these bound a task's memory, never what it compares.
_BLOCK, _SHINGLES, _COLUMNS = 512, 1 << 18, 1 << 12
#: Rows of one middle of a star that go to a task.
_STAR = 256
#: Texts hashed before their sets are handed on.
_AT_ONCE = 256


def shingles(text: str | None, words: int = 4) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of a whole text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    out = np.zeros(len(found) - words + 1, np.uint64)
    for j in range(words):  # the place of a word counts: rotate before the next one is added
        out = ((out << np.uint64(23)) | (out >> np.uint64(41))) * _MIX[0] + each[j : len(found) - words + 1 + j]
    out = (out ^ (out >> np.uint64(32))) * _MIX[1]
    return np.unique(out ^ (out >> np.uint64(29)))


def prefix(n: int, percent: int) -> int:
    """How many tokens of a set of n, under any order, must hold one of each linked set."""
    return n - -(-percent * n // 100) + 1


def ordered(tokens: np.ndarray, order: int, percent: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(room, tokens of the order's class, tokens of the prefix beside them); room: length of the prefix less those of the class."""
    mine = (tokens >> np.uint64(7)) % np.uint64(CLASSES) == order
    chosen, room = tokens[mine], prefix(len(tokens), percent) - int(mine.sum())
    others = np.empty(0, np.uint64)
    if room > 0:
        others = tokens[~mine]
        others = others[np.argsort(others * _MIX[order % len(_MIX)])[:room]]
    return room, chosen.view(np.int64), others.view(np.int64)


def _digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _texts(batches):
    """Slices of a few rows with their texts."""
    for batch in batches:
        for low in range(0, batch.num_rows, _AT_ONCE):
            part = batch.slice(low, _AT_ONCE)
            yield part, part.column("text").to_pylist()


def _marked(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Each row with its number of shingles, the digest of its set and what order 0 needs."""

    def run(batches):
        for part, texts in _texts(batches):
            sets = [shingles(t, words) for t in texts]
            made = [ordered(s, 0, percent) if len(s) else (0, [], []) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"), part.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.list_(pa.int64())),
                ],
                ["doc_id", "mark", "size", "digest", "room", "chosen", "others"],
            )

    return rows.mapInArrow(run, "doc_id long, mark long, size long, digest binary, room long, chosen array<long>, others array<long>")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(node, size, tokens) of the rows (node, digest, text) whose set has that digest."""

    def run(batches):
        for part, texts in _texts(batches):
            sets = [shingles(t, words) for t in texts]
            same = [i for i, d in enumerate(part.column("digest").to_pylist()) if d == _digest(sets[i])]
            node = part.column("node").take(pa.array(same, pa.int64()))
            yield pa.RecordBatch.from_arrays([node, pa.array([len(sets[i]) for i in same], pa.int64()), pa.array([sets[i].tobytes() for i in same], pa.binary())], ["node", "size", "tokens"])

    return rows.mapInArrow(run, "node long, size long, tokens binary")


def _under(sets: DataFrame, order: int, percent: int) -> DataFrame:
    """(node, room, chosen, others) of the sets (node, tokens) under an order."""

    def run(batches):
        for batch in batches:
            made = [ordered(np.frombuffer(t, np.uint64), order, percent) for t in batch.column("tokens").to_pylist()]
            arrays = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *arrays], ["node", "room", "chosen", "others"])

    return sets.select("node", "tokens").mapInArrow(run, "node long, room long, chosen array<long>, others array<long>")


def _prefixes(under: DataFrame, name: str) -> DataFrame:
    """(node, keys): the tokens of each prefix that another document may have too; documents without any are left out."""
    rows = under.select("node", "room", F.explode("chosen").alias("token"))
    often = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = materialize(often.withColumn("often", F.col("n")), f"{name}-often")
    shared = join_counted(rows, often, ["token"]).where("often is not null")
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("found"))
    both = under.select("node", "room", "others").join(lists, "node", "left")
    # of the class, tokens of one document only come first: they fill what the shared ones leave of the prefix
    found = F.coalesce(F.col("found.token"), F.array().cast("array<long>"))
    keep = F.greatest(F.lit(0), F.least(F.size(found), F.col("room") + F.size(found))).cast("int")
    return materialize(both.select("node", F.concat(F.slice(found, F.lit(1), keep), "others").alias("keys")).where("size(keys) > 0"), name)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets have in common."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), len(sets)))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[column] > 1
    row, column = np.repeat(np.arange(len(sets)), sizes)[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        part = slice(*np.searchsorted(column, (low, low + _COLUMNS)))
        has = np.zeros((len(sets), _COLUMNS), np.float32)
        has[row[part], column[part] - low] = 1
        out += has @ has.T
    return out


def links(sets: list[np.ndarray], prefixes: list[list[np.ndarray]], group: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Links by position that span what all links between sets of different ``group`` connect."""
    sizes = np.array([len(s) for s in sets], np.int64)
    low, high = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
    may = (group[:, None] != group[None, :]) & (100 * low >= percent * high)
    for each in prefixes:
        if may.any():
            may &= overlaps(each) > 0
    rows = np.flatnonzero(may.any(axis=1))
    if not len(rows):
        return [], []
    both, sizes = overlaps([sets[i] for i in rows]), sizes[rows]
    near = may[np.ix_(rows, rows)] & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
    a: list[int] = []
    b: list[int] = []
    left = near.any(axis=1)
    for first in np.flatnonzero(left).tolist():
        reach = [first] if left[first] else []
        left[first] = False
        while reach:
            at = reach.pop()
            found = np.flatnonzero(near[at] & left).tolist()
            left[found] = False
            a += [int(rows[at])] * len(found)
            b += rows[found].tolist()
            reach += found
    return a, b


def _as_sets(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


def _star_links(pairs: DataFrame, sets: DataFrame, filters: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, many) that are links. Many pairs may have one b: its rows are dealt out with copies of it."""

    def near(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column("a"), batch.column("b").to_pylist()
            keep = []
            for i, (one, other) in enumerate(zip(_as_sets(batch.column("tokens_a")), batch.column("tokens_b").to_pylist())):
                if b[i] not in known:
                    known = {b[i]: np.frombuffer(other, np.uint64)}
                both = len(np.intersect1d(one, known[b[i]], assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(known[b[i]]) - both))
            yield pa.RecordBatch.from_arrays([a, batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def beside(rows: DataFrame, what: DataFrame, columns: list[str]) -> DataFrame:
        dealt = rows.withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("many") / _STAR)))
        copies = rows.groupBy("b").agg(F.max(F.ceil(F.col("many") / _STAR)).alias("parts"))
        side = lambda end: what.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        middles = side("b").join(copies, "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        return dealt.join(side("a"), "a").join(middles, ["b", "part"]).drop("part")

    orders = [c for c in filters.columns if c != "node"]
    passed = beside(pairs, filters, orders)
    for c in orders:
        passed = passed.where(F.arrays_overlap(f"{c}_a", f"{c}_b"))
    passed = materialize(passed.select("a", "b", "many"), "filtered")
    return beside(passed, sets, ["tokens"]).select("a", "b", "tokens_a", "tokens_b").mapInArrow(near, "a long, b long")


def _block_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the rows (key, node, comp, many) of each key, by blocks of groups of keys."""
    most = rows.groupBy("node").agg(F.max(F.struct("many", "key")).alias("m")).select("node", F.col("m.key").alias("label"))
    counted = rows.join(most, "node").groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    chosen = counted.groupBy("key").agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("n")).select("key", "n", F.col("m.label").alias("label"))
    members = join_counted(rows.select("key", "node", "comp"), materialize(chosen, "labels"), ["key"])
    members = materialize(members.select("label", "node", "comp").distinct().join(sets.select("node", "size"), "node"), "members")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    blocks = F.greatest(F.ceil(F.col("n") / _BLOCK), F.ceil(F.col("total") / _SHINGLES)).cast("int")
    sizes = materialize(sizes.where("low < high").select("label", "n", blocks.alias("blocks")), "groups")
    dealt = join_counted(members.select("label", "node", "comp"), sizes, ["label"]).where("blocks is not null")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.where("other <> own or blocks = 1")  # two rows of one block meet beside any other block
    dealt = dealt.select(F.xxhash64("label", F.least("own", "other"), F.greatest("own", "other")).alias("pair"), "node", "comp")

    def compare(batches):
        kept = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            kept = now if kept is None else pa.concat_tables([kept, now])
            pair = kept.column("pair").to_numpy()
            ends = np.flatnonzero(pair[1:] != pair[:-1]) + 1
            for low, high in zip([0, *ends[:-1].tolist()], ends.tolist()):
                yield linked(kept.slice(low, high - low))
            kept = kept.slice(int(ends[-1])) if len(ends) else kept  # the rest may go on in the next batch
        if kept is not None and kept.num_rows:
            yield linked(kept)

    def linked(part):
        own = _as_sets(part.column("tokens"))
        prefixes = [[np.array(x, np.int64) for x in part.column(c).to_pylist()] for c in part.column_names if c.startswith("order_")]
        a, b = links(own, prefixes, part.column("comp").to_numpy(), percent)
        node = part.column("node").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], ["a", "b"])

    sent = dealt.join(sets.drop("size"), "node").repartition("pair").sortWithinPartitions("pair")
    return sent.mapInArrow(compare, "a long, b long").distinct()


def find_links(keys: DataFrame, sets: DataFrame, filters: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) that span the components of all links; keys: (node, keys), sets: (node, size, tokens, order_*)."""
    rows = materialize(keys.join(sets.select("node", "size"), "node").select("node", "size", F.explode("keys").alias("key")), "keys")
    found: DataFrame | None = None
    for pick in (F.min, F.max, None):
        if found is None:
            now = rows.withColumn("comp", F.col("node"))
        else:
            roots = components(found, "linked")
            now = rows.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("comp"))
        middle = [pick(F.struct("node", "size", "comp")).alias("middle")] if pick else []
        apart = now.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("many"), *middle)
        apart = materialize(apart.where("low < high").drop("low", "high").withColumn("n", F.col("many")), "keys-apart")
        now = materialize(join_counted(now, apart, ["key"]).where("many is not null"), "apart")
        if now.isEmpty():
            break
        if pick is None:
            more = _block_links(now, sets, percent)
        else:
            sized = 100 * F.least("size", "middle.size") >= percent * F.greatest("size", "middle.size")
            fit = now.where((F.col("comp") != F.col("middle.comp")) & sized)
            one = fit.groupBy("node").agg(F.max(F.struct("many", "key", "middle")).alias("m"))
            more = _star_links(one.select(F.col("node").alias("a"), F.col("m.middle.node").alias("b"), F.col("m.many").alias("many")), sets, filters, percent)
        more = materialize(more, "links")
        found = more if found is None else found.unionByName(more)
    return found


def jaccard_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest id that links reach, its own included."""
    named = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    named = named.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), "text")
    marked = materialize(_marked(named, words, percent), "marked")
    worded = marked.where("size > 0")
    one = [F.any_value(c).alias(c) for c in ("room", "chosen", "others")]
    classes = worded.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"), F.min("mark").alias("mark"), *one)
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    keys = _prefixes(classes.select("node", "room", "chosen", "others"), "order-0")
    # the sets of what is left are made again from the texts, rather than kept for all
    asked = classes.join(keys.select("node"), "node", "left_semi").select("mark", "node", "digest")
    sets = _sets(named.join(asked, "mark").select("node", "digest", "text"), words)
    sets = materialize(sets.groupBy("node").agg(F.any_value("size").alias("size"), F.any_value("tokens").alias("tokens")), "sets")
    left, filters = sets, None
    for order in range(1, ORDERS):
        more = _prefixes(_under(left, order, percent), f"order-{order}").withColumnRenamed("keys", f"order_{order}")
        filters = more if filters is None else filters.join(more, "node")
        left = left.join(more.select("node"), "node", "left_semi")
    filters = materialize(filters, "filters")
    both = materialize(sets.join(filters, "node"), "left")
    found = find_links(keys.join(filters.select("node"), "node", "left_semi"), both, filters, percent)

    rooted = classes.select("node", "digest", "n", "first")
    if found is None:
        rooted = rooted.withColumn("root", F.col("node"))
    else:
        rooted = rooted.join(components(found, "joined"), "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    rooted = materialize(rooted.select("digest", F.col("n").alias("rows"), "first", "root"), "rooted")
    least = materialize(rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("component_id")), "least")
    by_set = join_counted(rooted, least, ["root"]).select("digest", F.col("rows").alias("n"), "component_id")
    out = join_counted(worded.select("doc_id", "size", "digest"), materialize(by_set, "by-set"), ["digest"])
    alone = marked.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return out.select("doc_id", "size", "component_id").unionByName(alone).withColumnRenamed("size", "n_shingles")


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op13_jaccard_join": op13_jaccard_join}
ORACLES = {
    "op13_jaccard_join": r"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM t),
e AS MATERIALIZED (SELECT r, len(s) AS n, unnest(s) AS x FROM s),
pairs AS (SELECT a.r AS a, b.r AS b, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * c >= 85 * (na + nb - c)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT r, r FROM s UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a)
SELECT s.doc_id, len(s.s) AS n_shingles, min(o.doc_id) AS component_id
FROM reach JOIN s ON s.r = reach.a JOIN s o ON o.r = reach.b GROUP BY s.r, s.doc_id, len(s.s)
"""
}
