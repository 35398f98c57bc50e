"""Replay-safe sinks for micro-batches and batch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from retailflow.operators.anomalies import alert_messages, critical_alerts
from retailflow.operators.ingest import stamped
from retailflow.session import cut_lineage
from retailflow.sources.tables import Jdbc, matching_paths, path_exists, remove, rename

BatchWriter = Callable[[DataFrame, int], None]


# --- micro-batches ------------------------------------------------------------------------

def parquet_batches(path: str) -> BatchWriter:
    """One ``batch_id=<n>`` folder per micro-batch; a replayed batch overwrites its own folder."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def console_batches(rows: int = 20) -> BatchWriter:
    """Print the first rows of each micro-batch."""
    def write(df: DataFrame, batch_id: int) -> None:
        print(f"batch {batch_id}")
        df.show(rows, truncate=False)
    return write


def transformed(change: Callable[[DataFrame], DataFrame], write: BatchWriter) -> BatchWriter:
    """Write what ``change`` makes of a batch; nothing if that is empty."""
    def process(df: DataFrame, batch_id: int) -> None:
        changed = change(df)
        if not changed.isEmpty():
            write(changed, batch_id)
    return process


def jdbc_batches(db: Jdbc, table: str) -> BatchWriter:
    """Append to a database table with the batch id as a column, which a key there can deduplicate on."""
    def write(df: DataFrame, batch_id: int) -> None:
        (df.withColumn("batch_id", F.lit(batch_id)).write.format("jdbc")
         .options(**db.options(table=table)).mode("append").save())
    return write


def kafka_alerts(servers: str, topic: str) -> BatchWriter:
    def write(df: DataFrame, batch_id: int) -> None:
        (alert_messages(df).write.format("kafka")
         .option("kafka.bootstrap.servers", servers).option("topic", topic).save())
    return write


def file_alerts(path: str) -> BatchWriter:
    def write(df: DataFrame, batch_id: int) -> None:
        alert_messages(df).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def each_batch(*writers: BatchWriter) -> BatchWriter:
    """Run the writers on one evaluation of the batch; an empty batch writes nothing."""
    def process(df: DataFrame, batch_id: int) -> None:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not df.isEmpty():
                for write in writers:
                    write(df, batch_id)
        finally:
            df.unpersist()
    return process


def with_alerts(table: BatchWriter, alerts: BatchWriter) -> BatchWriter:
    """Store the anomalies and publish their critical rows in the same micro-batch."""
    return each_batch(table, lambda df, batch_id: alerts(stamped(critical_alerts(df), "created_at"), batch_id))


def start(df: DataFrame, writer: BatchWriter, checkpoint: str, name: str | None = None,
          output_mode: str = "append", every: str | None = None, available_now: bool = False) -> StreamingQuery:
    out: DataStreamWriter = (df.writeStream.outputMode(output_mode).foreachBatch(writer)
                             .option("checkpointLocation", checkpoint))
    if name:
        out = out.queryName(name)
    if available_now:
        out = out.trigger(availableNow=True)
    elif every:
        out = out.trigger(processingTime=every)
    return out.start()


def start_console(df: DataFrame, name: str, output_mode: str = "update") -> StreamingQuery:
    return (df.writeStream.outputMode(output_mode).format("console").option("truncate", "false")
            .queryName(name).start())


# --- batch tables ----------------------------------------------------------------------------

def counted(df: DataFrame, write: Callable[[DataFrame], object]) -> int:
    """Rows that passed into ``write``, observed while it runs instead of counted by another job."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return seen.get["rows"]


def write_jdbc(df: DataFrame, db: Jdbc, table: str, mode: str = "append") -> None:
    df.write.format("jdbc").options(**db.options(table=table)).mode(mode).save()


def append(df: DataFrame, path: str, partition_by: str | None = None, **options: str) -> None:
    writer = df.write.mode("append").options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def replace_all(df: DataFrame, path: str) -> None:
    """Replace a table's rows; a write that fails leaves the old ones readable.

    The new rows are written beside the table, which they then replace by a rename. ``df`` may read the table.
    Should the job end between the two renames, the next call finds the old table aside and puts it back first.
    """
    spark = df.sparkSession
    aside, staged = f"{path}.replaced", f"{path}.next"
    if path_exists(spark, aside):
        if path_exists(spark, path):
            remove(spark, aside)
        else:
            rename(spark, aside, path)
    df.write.mode("overwrite").parquet(staged)
    if path_exists(spark, path):
        rename(spark, path, aside)
    rename(spark, staged, path)
    remove(spark, aside)
    spark.catalog.refreshByPath(path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise rows that are about to replace what they are read from."""
    return cut_lineage(df)


def replace_partitions(df: DataFrame, path: str, column: str = "analysis_date", **options: str) -> None:
    """Replace only the values of ``column`` present in ``df``; others stay.

    ``df`` may read the table: new files are written beside the old ones, which go when all are there.
    """
    (df.write.mode("overwrite").options(**options).option("partitionOverwriteMode", "dynamic")
     .partitionBy(column).parquet(path))


def load_once(df: DataFrame, path: str) -> bool:
    """Write unless the target already holds rows; tells whether it wrote."""
    spark = df.sparkSession
    if path_exists(spark, path) and not spark.read.parquet(path).isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def publish_version(df: DataFrame, path: str, partition_by: str | None = "is_current") -> int:
    """Write the next ``version=<n>`` of a snapshot table.

    Readers take the newest version whose commit marker exists, so they never see half a
    snapshot, and the version being read can feed the one being written.
    """
    version = (newest_version(df.sparkSession, path) or 0) + 1
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{path}/version={version}")
    return version


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    version = version or newest_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no committed version under {path}")
    table = spark.read.parquet(f"{path}/version={version}")
    # Partition values are read as text unless they look like numbers or dates.
    flag = "is_current"
    return table.withColumn(flag, F.col(flag).cast("boolean")) if dict(table.dtypes).get(flag) == "string" else table


def newest_version(spark: SparkSession, path: str) -> int | None:
    committed = matching_paths(spark, f"{path}/version=*/_SUCCESS")
    return max((int(p.split("/")[-2].split("=")[1]) for p in committed), default=None)
