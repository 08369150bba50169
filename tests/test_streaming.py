"""Streams give what a batch over the same rows gives, and running them again adds nothing."""

from pyspark.sql import functions as F

from tessera.streaming import events as E

SF = "/root/testdata/sf0.001"


def _parts(spark, tmp_path, name, n=3):
    spark.read.parquet(f"{SF}/{name}.parquet").repartition(n).write.parquet(str(tmp_path / name))
    return str(tmp_path / name)


def test_windows_and_sessions_count_every_event(spark, tmp_path):
    path = _parts(spark, tmp_path, "events")
    rows = spark.read.parquet(path)
    for k, (f, n) in enumerate(((E.tumbling, rows.count()), (E.sessions, rows.count()))):
        q = f(E.read_stream(spark, path), late="10000 days").writeStream.outputMode("complete").format("memory").queryName(f"w{k}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        got = spark.table(f"w{k}")
        assert got.agg(F.sum("n")).first()[0] == n
        assert sorted(map(repr, got.collect())) == sorted(map(repr, f(rows).select(got.columns).collect()))


def test_enqueue_twice(spark, tmp_path):
    path = _parts(spark, tmp_path, "documents")
    want = spark.read.parquet(path).select("text").distinct().count()
    for _ in range(2):
        E.enqueue(E.read_stream(spark, path, 1), str(tmp_path / "queue"), str(tmp_path / f"c{_}")).awaitTermination(90)
        assert spark.read.parquet(str(tmp_path / "queue")).count() == want


def test_upsert(spark, tmp_path):
    path = _parts(spark, tmp_path, "events")
    E.upsert_into(E.read_stream(spark, path, 1), str(tmp_path / "state"), str(tmp_path / "c"), "user_id", "event_id").awaitTermination(60)
    got = E.latest(spark.read.parquet(str(tmp_path / "state")), "user_id", "event_id").select("user_id", "event_id")
    want = spark.read.parquet(path).groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
