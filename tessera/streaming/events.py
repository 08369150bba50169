"""Streams of events and documents: windows over late events, and batches that add to tables.

The incremental steps (``enqueue``, ``upsert_into``) can be repeated: a batch that is run again after a failure finds its
ids in place and adds nothing. The windows are extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def read_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of the Parquet files in ``path``, with the schema they have now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need a time with a zone: that of the session, for times without one."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """begin, event_type, n, total. Events later than ``late`` behind the newest are not counted."""
    w = _timed(events, late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("begin"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, begin, end, n: runs of a user's events with no longer pause than ``gap``."""
    w = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id")
    return w.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return _timed(events, late).dropDuplicatesWithinWatermark([key])


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    try:
        return spark.read.schema(like.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def enqueue(docs: DataFrame, queue: str, checkpoint: str):
    """Starts a query that appends documents whose content no queued one has, as PENDING; of equal ones the least id."""

    def add(batch: DataFrame, _: int) -> None:
        new = batch.withColumn("id", F.concat(F.lit("doc-"), F.md5(F.coalesce("text", F.lit("")))))
        first = new.join(new.groupBy("id").agg(F.min("doc_id").alias("doc_id")), ["id", "doc_id"], "left_semi").dropDuplicates(["id"]).withColumn("status", F.lit("PENDING"))
        first.join(_stored(batch.sparkSession, queue, first).select("id"), "id", "left_anti").select(first.columns).write.mode("append").parquet(queue)

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def upsert_into(rows: DataFrame, path: str, checkpoint: str, key: str, at: str):
    """Starts a query that appends the latest row of each key in a batch; ``latest`` over the table gives its state."""

    def add(batch: DataFrame, number: int) -> None:
        latest(batch, key, at).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
