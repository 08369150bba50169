"""What the third review found: small tables on which the results were wrong or the work too much."""

import math
import os
from datetime import date, timedelta
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import align as A
from tessera.operators import link_rank as L
from tessera.operators import nearest as N
from tessera.operators import reach as P
from tessera.plans import retrieval
from tests.test_queries import plain

SF = "/root/testdata/sf0.001"


def with_tables(folder, **made):
    """The tables of sf0.001, some of them replaced by the SQL given."""
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    for name in os.listdir(SF):
        table = name.split(".")[0]
        if table in made:
            con.sql(f"copy ({made[table]}) to '{folder}/{name}' (format parquet)")
        else:
            os.symlink(f"{SF}/{name}", f"{folder}/{name}")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{folder}/{name}'")
    return con


def same_as_sql(spark, con, folder, name):
    got = entry.queries()[name](spark, str(folder))
    found = con.sql(entry.oracle_sql()[name])
    cols = sorted(found.columns)
    assert cols == sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in cols]) for r in got.collect())
    want = sorted(repr([plain(r[found.columns.index(c)]) for c in cols]) for r in found.fetchall())
    assert rows and rows == want


def test_ids_of_over_a_million_rows(spark, tmp_path):
    """the SQL gives six characters."""
    many = "select i as o_orderkey, timestamp '1999-01-01' as o_orderdate from range(1000003) r(i)"
    con = with_tables(tmp_path, orders=many)
    got = entry.queries()["filter_historic"](spark, str(tmp_path)).where("o_orderkey >= 999998").collect()
    want = con.sql(f"select * from ({entry.oracle_sql()['filter_historic']}) where o_orderkey >= 999998").fetchall()
    assert len(want) == 5 and sorted((r.o_orderkey, r.id) for r in got) == sorted(want)


@pytest.mark.parametrize("mode", ["naive", "local", "global", "mix"])
def test_hits_that_six_digits_make_equal(spark, tmp_path, mode):
    """scores that differ in the seventh digit only are equal, and the lesser id is first."""
    close = "select vec_id, label, list_transform(embedding, lambda x: (round(x, 1) + (1000 - vec_id) * 0.000000001)::float) as embedding from embeddings"
    con = with_tables(tmp_path, embeddings=close)
    same_as_sql(spark, con, tmp_path, f"retrieve_kg_{mode}")


@pytest.mark.parametrize("name", ["set_cov_union", "join_filtered_link", "tei", "join_hard_negative"])
def test_pairs_of_members_of_two_industries(spark, tmp_path, monkeypatch, name):
    """Customers of two nations, parts with many orders; no pair is made twice and none is lost."""
    monkeypatch.setattr(P, "_FEW", 1)
    monkeypatch.setattr(P, "_SLOT", 1)
    twice = "select * from customer union all select * replace ((c_nationkey + 7) % 25 as c_nationkey) from customer where c_custkey % 5 = 0"
    con = with_tables(tmp_path, customer=twice)
    same_as_sql(spark, con, tmp_path, name)


@pytest.mark.parametrize("name", ["set_cov_union", "join_filtered_link"])
def test_pairs_are_not_shuffled(spark, name):
    """The pairs are the end of the plan, nothing groups or joins all of them again."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union")


def test_no_walks_where_nothing_is_reached(spark, monkeypatch):
    """without an edge into an enterprise there is nothing to walk to."""

    def walk(*_, **__):
        raise AssertionError

    monkeypatch.setattr(retrieval.G, "seeded_pagerank", walk)
    assert not entry.queries()["tei"](spark, SF).isEmpty()


def copies_of_titles(spark, n=60):
    """Notes and originals of three titles, many of each, of two agencies and many days."""
    name = lambda i: ["plan of trade", "plan for trades", "steel works act"][i % 3]
    day = lambda i: date(2020, 1, 1) + timedelta(i * 37 % 900)
    notes = [(i, "on " + name(i), "ab"[i % 2], day(i)) for i in range(n)]
    originals = [(1000 + i, n - i, name(i // 2), "ab"[i % 2], day(i * 5)) for i in range(n)]
    return notes, originals, spark.createDataFrame(notes, "id long, title string, agency string, day date"), spark.createDataFrame(originals, "original long, pos long, title string, agency string, day date")


@pytest.mark.parametrize("name", ["soft", "constrained"])
def test_different_titles_are_compared_once(spark, monkeypatch, name):
    """of copies of a title each was compared with each copy of another."""
    seen = spark.sparkContext.accumulator(0)

    def one(a, b):
        seen.add(1)
        return 1.0

    monkeypatch.setattr(A, "_by_pair", lambda of, least, a, b: F.udf(one, "double")(a, b))
    *_, notes, originals = copies_of_titles(spark)
    rows = getattr(A, name)(notes, originals).collect()
    assert len(rows) == 60 and 0 < seen.value <= 18  # three titles by three, at most twice in a plan


def test_first_original_of_copies(spark):
    """of copies of the best title, the first by position, for the constrained match within its agency and days."""
    notes, originals, a, b = copies_of_titles(spark)
    score = lambda t, o: SequenceMatcher(None, t.replace(" ", ""), o.replace(" ", "")).ratio()
    near = {i: [(-score(t, x), pos, o) for o, pos, x, g, e in originals if g == agency and abs((day - e).days) <= A.DAYS] for i, t, agency, day in notes}
    want = {i: min(found)[2] for i, found in near.items() if found and -min(found)[0] >= A.CONSTRAINED}
    assert want and {r.id: r.original for r in A.constrained(a, b).collect()} == want
    first = {x: min((pos, o) for o, pos, y, *_ in originals if y == x)[1] for _, _, x, *_ in originals}
    assert {r.id: r.original for r in A.soft(a, b).collect()} == {i: first[t[3:]] for i, t, *_ in notes}


def test_ranks_within_a_kind(spark):
    """a range that is a class of entities is compared in the blocks and needs no row for each triple and entity."""
    rnd = np.random.default_rng(4)
    v, kind = rnd.integers(-2, 3, (50, 3)).astype(float), [None if i % 11 == 5 else i % 3 for i in range(50)]
    triples = [(i, i * 7 % 50, None if i == 8 else i % 4, rnd.integers(-2, 3, 3).astype(float)) for i in range(40)]
    known = {(i, t) for i in range(40) for t in (i, i + 1, i * 7 % 50)}
    got = L.vector_ranks(
        spark.createDataFrame([(i, i, t, k, x.tolist()) for i, t, k, x in triples], "id long, q long, t long, k int, x array<double>"),
        spark.createDataFrame([(i, kind[i], x.tolist()) for i, x in enumerate(v)], "t long, k int, v array<double>"),
        spark.createDataFrame(list(known), "q long, t long"), measure="dot", block=16, kind="k",
    )
    want = {}
    for i, t, k, x in triples:
        better = [e for e in range(50) if v[e] @ x > v[t] @ x and k is not None and kind[e] == k]
        want[i] = (1 + len(better), 1 + len([e for e in better if (i, e) not in known]))
    assert {r.id: (r.raw, r.filtered) for r in got.collect()} == want


def test_typed_ranks_make_no_pairs(spark, monkeypatch):
    """the query gives a kind, not a list of what each triple may be compared with."""
    given = {}
    monkeypatch.setattr(L, "vector_ranks", lambda *tables, **more: given.update(more, tables=len(tables)) or tables[0])
    entry.queries()["lp_rank_vectors_typed"](spark, SF)
    assert given == {"tables": 3, "measure": "dot", "kind": "k"}


def test_searched_blocks_write_little():
    """at 4,096 vectors a block all vectors were sent, and k rows a query came back, n / 4,096 times."""
    for n in (2000, 60_000, 720_000):
        a, b = N.sides(n, n, 64, 101)
        assert n * 64 / min(a, b) <= 1.1 * (1 << 23)  # a block's memory is bounded
        assert a * 64 + b * (64 + 4 * 101) < 60 * 64  # numbers written a vector
    assert N.sides(36_000, 720_000, 1536, 10)[1] >= 720_000 * 1536 / (1 << 23)
    assert N.sides(0, 5, 64, 3) == (1, 1) == N.sides(10, 10, 64, 3)


def test_links_over_a_threshold_leave_the_blocks_only(spark):
    """a query's best of two blocks come as one row; scores that equal the threshold stay, vectors with nan drop out."""
    v = np.array([[3.0, 4.0], [1.0, 0.0], [0.0, 1.0], [np.nan, 1.0], [0.0, 0.0], [6.0, 8.0], [-1.0, 0.0], [3.0, 4.0]])
    df = spark.createDataFrame([(f"i{i}", x.tolist()) for i, x in enumerate(v)], "item string, v array<double>")
    got = N.top_k(df.selectExpr("item qid", "v q"), df, 3, math.nextafter(0.6, 0), block=2)
    want = {(f"i{q}", f"i{i}"): 1.0 if {q, i} <= {0, 5, 7} else 0.6 if 1 in (q, i) else 0.8 for q, i in [(0, 5), (0, 7), (0, 2), (5, 0), (5, 7), (5, 2), (7, 0), (7, 5), (7, 2), (1, 0), (1, 5), (1, 7), (2, 0), (2, 5), (2, 7)]}
    assert {(r.qid, r.item): r.score for r in got.collect()} == want
    best = N.best_lists(2, 0.5, "cosine")
    x = pd.DataFrame({"qid": [9, 8], "q": [[1.0, 0.0], [-1.0, 0.0]]})
    lists = best(x, pd.DataFrame({"item": [3, 2, 1, 0], "v": [[1.0, 0.0], [2.0, 0.0], [1.0, 1.0], [3.0, 0.0]]}))
    assert lists["qid"].tolist() == [9] and lists["item"].iloc[0].tolist() == [0, 2]
