"""A training-data pipeline over ``documents``: quality, exact and near copies, mixing, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retailflow.llm import exact, mixing, near, pieces, quality
from retailflow.llm.common import written
from retailflow.llm.queries import model_file, table

#: Rows that go to a Python worker at once. Documents are kilobytes to megabytes, so Spark's default of 10,000 rows
#: would hold tens to hundreds of megabytes in the JVM and again in the worker; the stages set this for their session.
BATCH_ROWS = 500

#: SQL can't express the nearest-neighbour scores and draws.
ORACLE_SQL = None


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    small_batches(spark)
    return exact.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    small_batches(spark)
    return near.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: a row for each pass in which words of a document are taken."""
    small_batches(spark)
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with its token ids and the text that they stand for."""
    small_batches(spark)
    return pieces.encode(docs, model_file(), keep_text=False).withColumnRenamed("decoded", "text")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
                                   ("mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
