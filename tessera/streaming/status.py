"""The status of each document as a stream: what happens to it moves it between states, and timers move it back.

    PENDING -> PROCESSING -> PREPROCESSED -> PROCESSED
                  |   ^ a worker that is stuck, or the first failures
                  v   |
                FAILED

State lives in Spark's state store, keyed by document, so a query that is stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PENDING, PROCESSING, PREPROCESSED, PROCESSED, FAILED = "PENDING", "PROCESSING", "PREPROCESSED", "PROCESSED", "FAILED"
#: What an event does, by the state it finds; an event that doesn't fit the state changes nothing.
MOVES = {
    ("queued", None): PENDING,
    ("queued", FAILED): PENDING,
    ("started", PENDING): PROCESSING,
    ("prepared", PROCESSING): PREPROCESSED,
    ("done", PROCESSING): PROCESSED,
    ("done", PREPROCESSED): PROCESSED,
    ("failed", PROCESSING): FAILED,
    ("failed", PREPROCESSED): FAILED,
}
#: Needed by the state that ``transitions`` keeps.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUT = "doc string, was string, status string, attempts int, at timestamp, cause string"


class Status(StatefulProcessor):
    """One row for each change of state. ``stuck_ms``: how long work may take; ``retries``: failures that lead back to PENDING."""

    def __init__(self, stuck_ms: int, retries: int):
        self.stuck_ms, self.retries = stuck_ms, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, attempts int, since long")

    def _load(self) -> tuple:
        return self.state.get() if self.state.exists() else (None, 0, 0)

    def _set(self, status: str, attempts: int, since: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((status, attempts, since))
        if status in (PROCESSING, PREPROCESSED):
            self.handle.registerTimer(since + self.stuck_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at", "event"], kind="stable")  # events of one document
        status, attempts, since = self._load()
        out = []
        for event, at in zip(events["event"], events["at"]):
            ms = int(at.value // 1_000_000)
            to = MOVES.get((event, status))
            if to is None:
                continue
            cause = event
            if to == PROCESSING:
                attempts += 1
            if to == FAILED and attempts <= self.retries:
                to, cause = PENDING, "retry"
            if event == "queued":
                attempts = 0
            out.append((key[0], status, to, attempts, at, cause))
            status, since = to, ms
        if out:
            self._set(status, attempts, since)
        yield pd.DataFrame(out, columns=["doc", "was", "status", "attempts", "at", "cause"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, attempts, since = self._load()
        due = expiredTimerInfo.getExpiryTimeInMs()
        out = []
        if status in (PROCESSING, PREPROCESSED) and since + self.stuck_ms <= due:
            at = pd.Timestamp(due, unit="ms")
            out.append((key[0], status, PENDING, attempts, at, "stuck"))
            self._set(PENDING, attempts, due)
        yield pd.DataFrame(out, columns=["doc", "was", "status", "attempts", "at", "cause"])

    def close(self) -> None:
        pass


def transitions(events: DataFrame, stuck_seconds: int = 600, late: str = "1 minute", retries: int = 1) -> DataFrame:
    """doc, was, status, attempts, at, cause: the changes that a stream of events (doc, event, at) makes.

    Events are queued, started, prepared, done and failed; those that don't fit a document's state, or that come later
    than ``late`` behind the newest, change nothing. Work that isn't done ``stuck_seconds`` after it started goes back to PENDING
    once an event of any document is that much newer; a failure does so ``retries`` times, then the document is FAILED
    until it is queued again. Rows with a null in any column are left out. The session needs the state store of
    ``PROVIDER``.
    """
    rows = events.select("doc", "event", F.col("at").cast("timestamp").alias("at")).dropna().withWatermark("at", late)
    return rows.groupBy("doc").transformWithStateInPandas(Status(stuck_seconds * 1000, retries), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def current(changes: DataFrame) -> DataFrame:
    """doc, status, attempts: the latest state of each document from the changes that a query has written."""
    last = changes.groupBy("doc").agg(F.max_by(F.struct("status", "attempts"), F.struct("at", "attempts", F.col("status") == PROCESSED)).alias("s"))
    return last.select("doc", "s.status", "s.attempts")
