"""Readers and writers of the graph formats, by round trip."""

from tessera.operators import merge as M
from tessera.sources import files


def test_id_map_and_triples_come_back(spark, tmp_path):
    ids = files.dense_ids(spark.createDataFrame([("b",), ("a",), ("c",), ("a",), (None,)], "name string"), "name", 3)
    assert sorted(map(tuple, ids.collect())) == [("a", 0), ("b", 1), ("c", 2)]
    files.write_id_map(ids, str(tmp_path / "ids"))
    assert sorted(map(tuple, files.read_id_map(spark, str(tmp_path / "ids/lines")).collect())) == [("a", 0), ("b", 1), ("c", 2)]
    assert spark.read.text(str(tmp_path / "ids/count")).first()[0] == "3"
    triples = spark.createDataFrame([(0, 1, 0), (2, 0, 1)], "h long, t long, r long")
    files.write_triple2id(triples, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_triple2id(spark, str(tmp_path / "t/lines")).collect())) == [(0, 1, 0), (2, 0, 1)]
    assert files.type_constraints(triples).count() == 4


def test_counts_and_lines_of_another_arity_are_left_out(spark, tmp_path):
    (tmp_path / "a.txt").write_text("2\n0 1 0\n1 2\n3 4 5 6\n7 8 9\n")
    assert sorted(map(tuple, files.read_triple2id(spark, str(tmp_path / "a.txt")).collect())) == [(0, 1, 0), (7, 8, 9)]


def test_dates_and_partial_years(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("a\tr\tb\t2014-01-11\nc\tr\td\tnever\n")
    assert [r.step for r in files.read_tsv_quads(spark, str(tmp_path / "q.tsv"), "2014-01-01", 3).collect()] == [3]
    (tmp_path / "y.tsv").write_text("a\tr\tb\t19##-##-##\t####-##-##\nc\tr\td\t-44-01-01\t2001-05-05\n")
    got = files.read_interval_quads(spark, str(tmp_path / "y.tsv")).orderBy("h").collect()
    assert [(r.begin, r.end) for r in got] == [(1900, 3000), (-44, 2001)]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "x|y"), (2, None)], "k long, v string")
    for kind in ("json", "csv", "parquet"):
        files.write_table(df, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    assert sorted(r[0] for r in files.export_markdown(df).collect()) == ["| 1 | x y |", "| 2 |  |"]
    assert files.read_json_list(spark, str(tmp_path / "json"), "k long, v string").count() == 2


def test_merging_empty_tables(spark):
    none = spark.createDataFrame([], "src string, dst string, weight double, keywords string")
    assert M.merge_edges(none).count() == 0
    edges = spark.createDataFrame([("a", "a", 1.0, "k"), ("b", "a", 2.0, None), ("a", "b", 1.0, "z, k")], "src string, dst string, weight double, keywords string")
    assert [tuple(r) for r in M.merge_edges(edges).select("src", "dst", "weight", "keywords").collect()] == [("a", "b", 3.0, "k,z")]
    quota = spark.createDataFrame([(1, 0, 1), (1, 1, 9), (1, 2, 9)], "qid int, pos int, has int")
    assert [r.took for r in M.linear_quota(quota, 4, 2).orderBy("pos").collect()] == [1, 6, 2]


def test_cached_extractions(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"docs": [{"idx": "chunk-900150983cd24fb0d6963f7d28e17f72", "passage": "abc", "extracted_entities": ["a"], "extracted_triples": [["a", "b", "c"]]}]}')
    done = files.read_extractions(spark, str(tmp_path / "e.json"))
    assert [(r.passage, r.entities, r.triples) for r in done.collect()] == [("abc", ["a"], [["a", "b", "c"]])]
    chunks = spark.createDataFrame([("abc",), ("abd",)], "content string")
    assert [r.content for r in files.pending(chunks, done).collect()] == ["abd"]


def test_text_triples_and_quads(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    lines = lambda path: sorted(r.value for r in spark.read.text(path).collect())
    triples = spark.createDataFrame([("e0", "r0", "e1", "2014-01-04"), ("e1", "r0", "e1", None)], "h string, r string, t string, d string")
    named = spark.createDataFrame([("e0", "a  政 b"), ("e1", "策"), ("e2", None)], "name string, text string")
    files.write_text_triples({"train": triples, "dev": triples.limit(0)}, named, named.limit(0), at("x"))
    assert lines(at("x/train")) == ["e0\tr0\te1", "e1\tr0\te1"] and lines(at("x/dev")) == []
    assert lines(at("x/entities")) == ["e0", "e1", "e2"] and lines(at("x/relation2text")) == []
    assert lines(at("x/entity2text")) == ["e0\ta b", "e1\tentity e1", "e2\tentity e2"]
    ids = spark.createDataFrame([("e0", 0), ("e1", 1)], "name string, id long")
    files.write_quads({"train": triples.where("d is not null")}, ids, ids, at("q"))
    assert [tuple(r) for r in files.read_tsv_quads(spark, at("q/train"), "2014-01-01").collect()] == [("e0", "r0", "e1", 3)]
    assert sorted(map(tuple, files.read_id_map(spark, at("q/entity2id")).collect())) == [("e0", 0), ("e1", 1)]
    files.write_type_constraints(spark.createDataFrame([(5, 1, 0), (2, 1, 0), (2, 3, 1)], "h long, t long, r long"), at("c"))
    assert lines(at("c/lines")) == ["0\t1\t1", "0\t2\t2\t5", "1\t1\t2", "1\t1\t3"] and lines(at("c/count")) == ["2"]


def test_type_constraints_come_back_from_parts_of_a_file(spark, tmp_path):
    triples = spark.createDataFrame([(h, (h * 7 + r) % 50, r) for r in range(40) for h in range(r % 9 + 1)], "h long, t long, r long")
    files.write_type_constraints(triples, str(tmp_path / "types"))
    want = sorted(map(tuple, files.type_constraints(triples).select("r", "side", "id").collect()))
    assert sorted(map(tuple, files.read_type_constraints(spark, str(tmp_path / "types/lines")).collect())) == want
    lines = [r.value for r in spark.read.text(str(tmp_path / "types/lines")).collect()]
    ordered = sorted(lines, key=lambda x: int(x.split("\t")[0]))  # stable: heads stay before tails
    (tmp_path / "one.txt").write_text("40\n" + "\n".join(ordered) + "\n41\t0\n41\t1\tx\nbad line\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = files.read_type_constraints(spark, str(tmp_path / "one.txt"))
        assert spark.read.text(str(tmp_path / "one.txt")).rdd.getNumPartitions() > 1
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    files.write_table(spark.createDataFrame([(1, "ü")], "k long, v string"), str(tmp_path / "csv"), "csv", marked=True)
    part = next((tmp_path / "csv").glob("part-*.csv")).read_bytes()
    assert part.startswith(b"\xef\xbb\xbfk,v") and part.decode("utf-8-sig").splitlines()[1] == "1,ü"
