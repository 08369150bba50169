"""A training-text pipeline over ``documents``: each stage works on what the one before it kept.

Toxic documents go, then exact copies, then near-duplicates (shingles of five words; the smallest id of each group
stays), then documents that hold a benchmark passage. What is left is encoded and decoded with a byte-level
tokenizer.

The near-duplicate stage finds copies by SimHash fingerprints through anchors, then by min-hashes what fingerprints leave apart (at
0.8 they differ in some ten bits, README); each link is verified by its Jaccard similarity. Null texts count as empty in each stage. Rows with a null id stay unless
they are exact copies; rows that repeat an id and a text are one document. An empty table gives an empty result. Columns
beside those of ``documents`` are kept up to the last stage, which returns digests.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from tessera.llm.common import materialize, table


#: Rows that a Python worker gets at a time. Texts may be long, and the workers of an executor share its memory with the heap.
BATCH = 1000


def in_small_batches(stage):
    """The stage with Arrow batches of ``BATCH`` rows at most; it changes memory, never results."""

    @functools.wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        if not 0 < int(spark.conf.get(name)) <= BATCH:
            spark.conf.set(name, str(BATCH))
        return stage(spark, docs, sf_dir)

    return bounded


@in_small_batches
def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_civil(docs, table(spark, sf_dir, "labels"))


@in_small_batches
def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_unique(docs)


@in_small_batches
def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, words=5)


@in_small_batches
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [("toxicity", civil), ("exact_dedup", unique), ("simhash", distinct), ("decontamination", clean), ("byte_bpe", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
