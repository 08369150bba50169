"""Nearest vectors in blocks, and scores by the vectors of the other candidates."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import rank as R

#: Numbers of a product at a time.
_CELLS = 1 << 21


MEASURES = ("cosine", "dot", "l1")


def _unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt((m * m).sum(axis=1))
    return m / np.where(size > 0, size, 1)[:, None], size > 0


def matrix(vectors) -> np.ndarray:
    return np.stack(list(vectors)).astype(np.float64)


def similarities(q: np.ndarray, m: np.ndarray, measure: str, digits: int = 9) -> np.ndarray:
    """Of each row of q to each of m, rounded to ``digits``; a distance is negative, so that more is always nearer.
    The cosine with a vector of length 0 is -inf."""
    if measure == "l1":
        out = np.empty((len(q), len(m)))
        for i in range(len(q)):  # one row at a time: |m| x dim numbers, not |q| as many
            out[i] = -np.abs(m - q[i]).sum(axis=1)
        return np.round(out, digits)
    if measure == "dot":
        return np.round(q @ m.T, digits)
    (q, asks), (m, some) = _unit(q), _unit(m)
    out = np.round(q @ m.T, digits)
    out[~asks] = -np.inf
    out[:, ~some] = -np.inf
    return out


def own_similarities(q: np.ndarray, m: np.ndarray, measure: str, digits: int = 9) -> np.ndarray:
    """``similarities`` of each row of q to the same row of m."""
    if measure == "l1":
        return np.round(-np.abs(m - q).sum(axis=1), digits)
    if measure == "dot":
        return np.round(np.einsum("ij,ij->i", q, m), digits)
    (q, asks), (m, some) = _unit(q), _unit(m)
    return np.where(asks & some, np.round(np.einsum("ij,ij->i", q, m), digits), -np.inf)


def best_of(k: int, least: float, measure: str, own: bool = False, digits: int = 9):
    """For applyInPandas on cogroups: the k best rows (item, v) over ``least`` of each query (qid, q), itself left out."""
    best = best_lists(k, least, measure, own, digits)

    def rows(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return best(x, y).explode(["item", "score"], ignore_index=True)

    return rows


def _candidates(q: np.ndarray, m: np.ndarray, k: int, least: float, qid: np.ndarray | None, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of q and of m, of length one each, whose cosine can be over ``least`` and among the k best of the row of q; not those of the same id.

    Products are of single precision, off by less than half of ``slack``; what they let through must be computed again. The
    least cosine that counts rises with the k-th best found so far.
    """
    slack = 2 * (m.shape[1] + 4) * 2.0**-23 + 1e-6
    q, m = q.astype(np.float32), m.astype(np.float32)
    floor, wide, merge_at = np.full(len(q), least - slack, np.float32), 2048, 2048
    row, col, val = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    new = []
    for c in range(0, len(m), wide):
        s = q @ m[c : c + wide].T
        if c == 0 and least < -1 and k + 1 < s.shape[1]:
            floor = np.partition(s, -k - 1, axis=1)[:, -k - 1] - np.float32(slack)
        flat = np.flatnonzero(s >= floor[:, None])
        r, at = np.divmod(flat, s.shape[1])
        at += c
        some = slice(None) if qid is None else qid[r] != item[at]
        new.append((r[some], at[some], s.ravel()[flat][some]))
        if c + wide >= min(merge_at, len(m)):
            row, col, val = (np.concatenate([old, *parts]) for old, parts in zip((row, col, val), zip(*new)))
            new, merge_at = [], 2 * merge_at
            order = np.lexsort((-val, row))
            row, col, val = row[order], col[order], val[order]
            first = np.searchsorted(row, np.arange(len(q) + 1))
            full = np.flatnonzero(np.diff(first) >= k)
            floor[full] = np.maximum(floor[full], val[first[full] + k - 1] - np.float32(slack))
            some = val >= floor[row]
            row, col, val = row[some], col[some], val[some]
    return row, col


def best_lists(k: int, least: float, measure: str, own: bool = False, digits: int = 9):
    """As best_of, a row for each query: qid, and its items and scores as lists, the best first; none without any."""

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found: tuple[list, list, list] = [], [], []
        if len(x) and len(y):
            y = y.sort_values("item", kind="stable")
            item, qid = y["item"].to_numpy(), x["qid"].to_numpy()
            m, q = matrix(y["v"]), matrix(x["q"])
            fast = measure == "cosine" and digits >= 7
            if fast:
                (m, some), (q, asks) = _unit(m), _unit(q)  # those of length 0 and those with nan or infinity have no cosine
                some, asks = some & np.isfinite(m).all(axis=1), asks & np.isfinite(q).all(axis=1)
                m, item, q, qid = m[some], item[some], q[asks], qid[asks]
            step = 512 if fast else max(1, _CELLS // len(m))
            for i in range(0, len(q), step):
                if fast:
                    row, col = _candidates(q[i : i + step], m, k, least, None if own else qid[i : i + step], item)
                    score = np.round(np.einsum("ij,ij->i", q[i : i + step][row], m[col]), digits)
                    over = score > least
                    row, col, score = row[over], col[over], score[over]
                else:
                    s = similarities(q[i : i + step], m, measure, digits)
                    s[~(s > least)] = -np.inf
                    if not own:
                        s[qid[i : i + step, None] == item[None, :]] = -np.inf
                    if k < s.shape[1]:  # those under the k-th can't be among the k best; equal ones can, the lesser item first
                        s[s < np.partition(s, -k, axis=1)[:, -k, None]] = -np.inf
                    row, col = np.nonzero(s > -np.inf)
                    score = s[row, col]
                order = np.lexsort((col, -score, row))
                row, col, score = row[order], col[order], score[order]
                first = np.searchsorted(row, np.arange(len(q[i : i + step]) + 1))
                for j in np.flatnonzero(np.diff(first)):
                    upto = slice(first[j], min(first[j + 1], first[j] + k))
                    for to, part in zip(found, (qid[i + j], item[col[upto]], score[upto])):
                        to.append(part)
        return pd.DataFrame({c: pd.Series(part, dtype=object) for c, part in zip(("qid", "item", "score"), found)})  # lists, also without rows

    return best


def scores_schema(queries: DataFrame, rows: DataFrame) -> str:
    return f"qid {queries.schema['qid'].dataType.simpleString()}, item {rows.schema['item'].dataType.simpleString()}, score double"


def sides(asked: int, held: int, width: int, k: int, block: int = 1 << 30, tasks: int = 64, numbers: int = 1 << 23) -> tuple[int, int]:
    """Into how many blocks queries and rows of ``width`` numbers are dealt.

    A query is sent once for each block of rows and comes back from it with k items, a row is sent once for each block of
    queries: of some ``tasks`` pairs of blocks those that write least. No more than keep 4,096 vectors in a block; but a
    block has at most ``block`` vectors and ``numbers`` numbers, which bounds the memory of a task.
    """
    if not asked or not held:
        return 1, 1
    most = max(1, min(block, numbers // max(width, 1)))
    b = round(math.sqrt(tasks * held * width / (asked * (width + 4 * k))))
    b = max(min(b, math.ceil(held / 4096)), math.ceil(held / most), 1)
    a = max(min(math.ceil(tasks / b), math.ceil(asked / 4096)), math.ceil(asked / most), 1)
    return a, b


def top_k(queries: DataFrame, rows: DataFrame, k: int, least: float = -math.inf, block: int = 131072, measure: str = "cosine", own: bool = False, digits: int = 9) -> DataFrame:
    """qid, item, score: for each query (qid, q) the ``k`` nearest rows (item, v) over ``least``, itself left out unless ``own``.

    ``measure`` is the cosine, the dot product or the negative L1 distance. Both sides are dealt into blocks of at most
    some ``block`` vectors (``sides``), and a task has two blocks, of which it gives a row a query, with lists of k at most: pairs of
    vectors are never rows before the best of all blocks are ranked. Exact: equal scores go by the item. Scores are
    rounded to ``digits`` before they are compared; null vectors are left out, and for the cosine those of length 0.
    """
    if measure not in MEASURES:
        raise ValueError(f"measure must be one of {MEASURES}")
    queries, rows = queries.where("q is not null and qid is not null"), rows.where("v is not null and item is not null")
    n, (m, width) = queries.count(), rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    asked, held = sides(n, m, width or 1, k, block)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(deal("qid", asked).alias("a"), every(held).alias("b"), "qid", "q")
    right = rows.select(every(asked).alias("a"), deal("item", held).alias("b"), "item", "v")
    qid_, item_ = queries.schema["qid"].dataType.simpleString(), rows.schema["item"].dataType.simpleString()
    lists = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(best_lists(k, least, measure, own, digits), f"qid {qid_}, item array<{item_}>, score array<double>")
    if held > 1:  # lists meet as lists, and leave as k rows
        pair = F.transform(F.arrays_zip("item", "score"), lambda x: F.struct((-x["score"]).alias("less"), x["item"].alias("item")))
        best = lists.select("qid", pair.alias("p")).groupBy("qid").agg(F.slice(F.sort_array(F.flatten(F.collect_list("p"))), 1, k).alias("p"))
        return best.select("qid", F.explode("p").alias("p")).select("qid", "p.item", (-F.col("p.less")).alias("score"))
    return lists.select("qid", F.explode(F.arrays_zip("item", "score")).alias("p")).select("qid", "p.item", "p.score")


def struct_context(hits: DataFrame, vectors: DataFrame, most: int = 5) -> DataFrame:
    """The hits (qid, item, score, rank) with context: (1 + cosine) / 2 of an item's vector (item, v) with the mean vector of
    the query's ``most`` best other items, of which those without a vector don't count. Null without both vectors."""
    first = hits.where(F.col("rank") <= most + 1).join(vectors, "item", "left")
    first = first.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "item", V.doubles("v").alias("v")))).alias("first"))
    wide = hits.join(first, "qid").join(vectors, "item", "left")
    others = F.filter(F.slice(F.filter("first", lambda x: x["item"] != F.col("item")), 1, most), lambda x: x["v"].isNotNull())
    wide = wide.withColumn("others", F.transform(others, lambda x: x["v"]))
    # the cosine with the sum is that with the mean
    add = lambda a, x: F.zip_with(a, x, lambda p, q: p + q)
    wide = wide.withColumn("mean", F.when(F.size("others") > 0, F.aggregate(F.slice("others", 2, most), F.col("others")[0], add)))
    context = F.when(F.col("v").isNotNull() & F.col("mean").isNotNull(), (V.cosine("v", "mean") + 1) / 2)
    return wide.select(*hits.columns, context.alias("context"))
