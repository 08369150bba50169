"""The stream of states against a plain fold of the events; a query that stops goes on where it was."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import status as S

BEGIN = datetime(2024, 1, 1)
SCHEMA = "doc string, event string, at timestamp"


def at(seconds):
    return BEGIN + timedelta(seconds=seconds)


@pytest.fixture
def store(spark):
    key, value = S.PROVIDER
    spark.conf.set(key, value)
    yield
    spark.conf.unset(key)


class Feed:
    """A folder of events, and a query over it that is started anew for each batch from the same checkpoint."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.path, self.options, self.seen = spark, tmp_path, options, 0
        spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))

    def send(self, *events):
        self.spark.createDataFrame([(d, e, at(t)) for d, e, t in events], SCHEMA).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        rows = self.spark.readStream.schema(SCHEMA).parquet(str(self.path / "in"))
        out = S.transitions(rows, **self.options).writeStream.format("parquet").option("checkpointLocation", str(self.path / "c"))
        out.trigger(availableNow=True).start(str(self.path / "out")).awaitTermination(120)
        found = sorted((r.at, r.doc, r.was, r.status, r.attempts, r.cause) for r in self.changes().collect())
        new = [((x[0] - BEGIN).total_seconds(), *x[1:]) for x in found]
        fresh = [x for x in new if x not in getattr(self, "old", [])]
        self.old = new
        return fresh

    def changes(self):
        return self.spark.read.schema(S.OUT).parquet(str(self.path / "out"))


def test_restarts_between_transitions_and_timers(spark, tmp_path, store):
    feed = Feed(spark, tmp_path, stuck_seconds=600, late="60 seconds", retries=1)
    assert feed.send(("a", "queued", 0), ("b", "queued", 1), ("b", "done", 2)) == [(0, "a", None, "PENDING", 0, "queued"), (1, "b", None, "PENDING", 0, "queued")]
    assert feed.send(("a", "started", 10), ("b", "started", 11)) == [(10, "a", "PENDING", "PROCESSING", 1, "started"), (11, "b", "PENDING", "PROCESSING", 1, "started")]
    assert feed.send(("a", "prepared", 20), ("b", "failed", 21)) == [(20, "a", "PROCESSING", "PREPROCESSED", 1, "prepared"), (21, "b", "PROCESSING", "PENDING", 1, "retry")]
    assert feed.send(("b", "started", 30), ("a", "done", 40), ("a", "failed", 41)) == [(30, "b", "PENDING", "PROCESSING", 2, "started"), (40, "a", "PREPROCESSED", "PROCESSED", 1, "done")]
    # b is stuck: another document's event moves the time on
    assert feed.send(("c", "queued", 1000)) == [(630, "b", "PROCESSING", "PENDING", 2, "stuck"), (1000, "c", None, "PENDING", 0, "queued")]
    assert feed.send(("b", "started", 1010)) == [(1010, "b", "PENDING", "PROCESSING", 3, "started")]
    assert feed.send(("b", "failed", 1020)) == [(1020, "b", "PROCESSING", "FAILED", 3, "failed")]
    assert feed.send(("b", "started", 1030)) == []  # a failed document has to be queued again
    assert feed.send(("b", "queued", 1040)) == [(1040, "b", "FAILED", "PENDING", 0, "queued")]
    now = {r.doc: (r.status, r.attempts) for r in S.current(feed.changes()).collect()}
    assert now == {"a": ("PROCESSED", 1), "b": ("PENDING", 0), "c": ("PENDING", 0)}


def test_many_documents_give_what_a_fold_gives(spark, tmp_path, store):
    rnd = random.Random(7)
    events = [(f"d{rnd.randrange(20)}", rnd.choice(["queued", "started", "started", "prepared", "done", "failed", "unknown"]), t) for t in range(400)]
    feed = Feed(spark, tmp_path, stuck_seconds=10_000, late="1 day", retries=2)
    for low in (0, 150, 300):
        feed.send(*events[low : low + 150])
    state, want = {}, []
    for doc, event, t in events:
        status, attempts = state.get(doc, (None, 0))
        to = S.MOVES.get((event, status))
        if to:
            cause = event
            attempts += to == S.PROCESSING
            if to == S.FAILED and attempts <= 2:
                to, cause = S.PENDING, "retry"
            attempts = 0 if event == "queued" else attempts
            want.append((t, doc, status, to, attempts, cause))
            state[doc] = to, attempts
    assert feed.old == sorted(want)
    assert {r.doc: (r.status, r.attempts) for r in S.current(feed.changes()).collect()} == state


def test_nulls_are_left_out(spark, tmp_path, store):
    feed = Feed(spark, tmp_path)
    df = spark.createDataFrame([(None, "queued", at(0)), ("x", None, at(1)), ("x", "queued", None)], SCHEMA)
    df.write.mode("append").parquet(str(tmp_path / "in"))
    assert feed.send(("y", "queued", 5)) == [(5, "y", None, "PENDING", 0, "queued")]
    assert feed.changes().where(F.col("doc") == "x").count() == 0
