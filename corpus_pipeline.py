"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Quality rules and decontamination keep whole documents or drop them; of near-duplicates one stays; mixing repeats the
blocks of small sources and hands the rows on in the permuted order of the blocks; the token files hold that order.

ORACLE_SQL is None: a sketch and an alignment decide the second stage, which SQL doesn't express; tests hold each stage
against a plain version of it.

Defined cases: a null or empty text has under 50 words and goes in the first stage; a null doc_id is kept like any other
and null in the result; of equal and of repeated rows one stays; doc_id keeps its type; texts of any length are read
whole; an empty table gives no rows; columns that are not of documents are handed on up to the last stage, whatever
their names outside the package's prefix. A stage's table is deleted once the next one is written; the token files stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugework.llm import decontam, mixing, neardup, quality, token_output
from gaugework.llm.common import Scratch, table

#: Word tables of a worker in the last stage: small, as executors still hold what the stages before have left them.
CACHE_BYTES = 30_000_000

#: Bytes of rows that Spark hands to a Python worker at once. What a worker holds of a batch, and keeps when it has freed
#: it, is a multiple of it; workers of all stages stay beside the JVM's heap.
BATCH_BYTES = 4_000_000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.filtered(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.filtered(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontam.filtered(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return token_output.round_trip(docs, order="files", cache_bytes=CACHE_BYTES)


STAGES: list[tuple[str, Stage]] = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("decontamination", decontaminate), ("mixing", mix_sources), ("token output", write_tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            before, docs = docs, scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            scratch.drop(before)
        return STAGES[-1][1](spark, docs, sf_dir)  # its files are written when it returns
