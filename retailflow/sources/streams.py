"""Streaming message sources: Kafka on a cluster, file streams for backfill and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def kafka_options(servers: str, topic: str, starting_offsets: str = "latest",
                  max_offsets_per_trigger: int | None = None, **extra: str) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "failOnDataLoss": "false",
        **extra,
    }
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def kafka_stream(spark: SparkSession, servers: str, topic: str, **kwargs) -> DataFrame:
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, **kwargs)).load()


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """Files under ``path`` (a folder, a glob or one file) as an unbounded table."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def with_event_time(df: DataFrame, column: str, lateness: str) -> DataFrame:
    """Declare event time once, at the source; a no-op for batch input."""
    return df.withWatermark(column, lateness)
