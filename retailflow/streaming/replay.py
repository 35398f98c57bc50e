"""Drain a stream over the files that exist now and read back what it emitted."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame

from retailflow.session import shared_folder, stream_settings
from retailflow.sources.tables import matching_paths, path_exists
from retailflow.streaming import sinks
from retailflow.streaming.progress import ProgressLog


def replay(stream: DataFrame, output_mode: str = "append", folder: str | None = None,
           log: ProgressLog | None = None, job: str = "replay", input_bytes: int = 0) -> DataFrame:
    """Run ``stream`` with the batch sink until its input is used up; return the emitted rows.

    In append mode these are the windows that the watermark has closed, as a continuous job emits
    them. Complete mode emits all groups with each batch; the newest batch then holds those
    of the whole input, open windows included. A stream that emits nothing gives an empty frame
    of its schema. What the stream did is added to ``log`` under the name ``job``. State has more partitions the more
    ``input_bytes`` there are.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark)}/replay-{uuid4().hex}"
    # One writer needs no copy of the batch.
    with stream_settings(spark, input_bytes, counts=log is not None):
        query = sinks.start(stream, sinks.parquet_batches(f"{folder}/rows"), f"{folder}/checkpoint", output_mode=output_mode,
                            available_now=True)
    query.awaitTermination()
    if log:
        log.add(job, query.recentProgress)
    if not path_exists(spark, f"{folder}/rows"):
        return spark.createDataFrame([], stream.schema)
    batches = matching_paths(spark, f"{folder}/rows/batch_id=*")
    if output_mode == "complete":
        batches = [max(batches, key=lambda p: int(p.rsplit("=", 1)[1]))]
    return spark.read.schema(stream.schema).parquet(*batches)
