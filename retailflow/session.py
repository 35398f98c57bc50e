"""Session settings and the lineage cut used by iterative or multi-pass operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What results depend on: days and windows are cut in UTC.
RESULT_CONF = {"spark.sql.session.timeZone": "UTC"}

#: Settings of the sessions that the library builds.
RUNTIME_CONF = {
    **RESULT_CONF,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Before execution a join's size is guessed as the product of its inputs, which can turn the
    # fact side into the broadcast side. Only tiny tables are broadcast on such estimates;
    # larger sides wait for the size their shuffle measures.
    "spark.sql.autoBroadcastJoinThreshold": "1MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # A hot join key is worth one more shuffle downstream.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "retailflow", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session with the library's settings."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


#: Bytes of input tables per shuffle partition, and of shuffled rows that a task reads or keeps as one side of a join.
PARTITION_BYTES, TASK_BYTES = 2 << 20, "16MB"


def configure(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Set what results depend on in a session that somebody else created; leave its other settings.

    With ``input_bytes``, the number of shuffle partitions grows with the input, so that a task's share and memory don't;
    the adaptive planner merges small ones. Joins whose smaller side is small in every task keep it as a hash table, which
    spares them from sorting the larger one. Sizes that the session sets itself stay.
    """
    for key, value in RESULT_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if input_bytes is not None:
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // PARTITION_BYTES))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
        for key in ("advisoryPartitionSizeInBytes", "maxShuffledHashJoinLocalMapThreshold"):
            if spark.conf.get(f"spark.sql.adaptive.{key}", None) is None:
                spark.conf.set(f"spark.sql.adaptive.{key}", TASK_BYTES)
    return spark


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings that end with the block; as keywords, their dots are written as two underscores."""
    named = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in named}
    for key, value in named.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def freed_shuffles(spark: SparkSession):
    """Within the block, the shuffle files of a job are removed when it ends; else they stay until the JVM collects garbage."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


#: Bytes of input tables per partition of a stream's state.
STATE_BYTES = 64 << 20

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Each write to state is preceded by a look-up that only counts its rows.
STATE_COUNTS = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"


def stream_settings(spark: SparkSession, input_bytes: int = 0, counts: bool = True):
    """What a stream starts with inside the block: state on disk, its rows counted if ``counts``, where the session sets nothing
    itself, and partitions of state whose number grows with the input, since the planner merges or splits none of a stream's."""
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes // STATE_BYTES))
    wanted = {STATE_PROVIDER: RUNTIME_CONF[STATE_PROVIDER], STATE_COUNTS: str(counts).lower()}
    unset = {key: value for key, value in wanted.items() if spark.conf.get(key, None) is None}
    return settings(spark, **{"spark.sql.shuffle.partitions": str(partitions)}, **unset)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage so that later passes read the same rows once."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
