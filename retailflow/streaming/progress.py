"""What streams really did: rows, seconds, watermarks and offsets of each micro-batch as a table, and reports on it."""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from retailflow.streaming.managed import ManagedTable

PROGRESS = (
    "job string, run string, batch_id long, started timestamp, input_rows long, output_rows long, seconds double, "
    "write_seconds double, watermark timestamp, state_rows long, late_rows long, source string, end_offset string")


def _time(text: str | None) -> dt.datetime | None:
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00")) if text and not text.startswith("1970-01-01") else None


def progress_rows(job: str, progress) -> list[tuple]:
    """One row for each source of a micro-batch; figures of the whole batch stand with its first source."""
    spent, states = progress.durationMs or {}, progress.stateOperators or []
    rows = []
    for i, source in enumerate(progress.sources):
        first = i == 0
        rows.append((
            job, str(progress.runId), progress.batchId, _time(progress.timestamp), source.numInputRows,
            progress.sink.numOutputRows if first and progress.sink else None, spent.get("triggerExecution", 0) / 1000 if first else None,
            spent.get("addBatch", 0) / 1000 if first else None, _time((progress.eventTime or {}).get("watermark")) if first else None,
            sum(s.numRowsTotal for s in states) if first else None, sum(s.numRowsDroppedByWatermark for s in states) if first else None,
            source.description, source.endOffset))
    return rows


class ProgressLog(StreamingQueryListener):
    """Adds every micro-batch of a session's streams to a managed table.

    ``spark.streams.addListener(log)`` follows all streams of the session by their names; rows are written ``every`` so
    many and by :meth:`flush`. Idle triggers without rows are left out.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 100):
        self.spark, self.every = spark, every
        self.table = ManagedTable(spark, path, ("day", F.to_date("started")), ["started"])
        self._held: list[tuple] = []
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.add(event.progress.name or str(event.progress.id), [event.progress])

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.flush()

    def add(self, job: str, progress: Iterable) -> None:
        rows = [r for p in progress if p.numInputRows for r in progress_rows(job, p)]
        with self._lock:
            self._held += rows
            full = len(self._held) >= self.every
        if full:
            self.flush()

    def flush(self) -> None:
        with self._lock:
            rows, self._held = self._held, []
        if rows:
            self.table.append(self.spark.createDataFrame(rows, PROGRESS).coalesce(1))

    def read(self) -> DataFrame:
        self.flush()
        return self.table.read()


# --- reports ---------------------------------------------------------------------------------------

def _per_window(progress: DataFrame, width: str, *aggregates) -> DataFrame:
    grouped = progress.groupBy(F.window("started", width), "job").agg(*aggregates)
    return grouped.select(F.col("window.start").alias("time"), *[c for c in grouped.columns if c != "window"])


def throughput(progress: DataFrame, width: str = "1 minute") -> DataFrame:
    """Rows that each job took in per window, and per second of the time its batches ran."""
    return _per_window(progress, width, F.sum("input_rows").alias("input_rows"), F.sum("seconds").alias("busy_seconds"),
                       F.try_divide(F.sum("input_rows").cast("double"), F.sum("seconds")).alias("rows_per_second"))


def batch_latency(progress: DataFrame, width: str = "1 minute") -> DataFrame:
    """Seconds from trigger to committed output, and how far the watermark was behind the clock."""
    behind = F.col("started").cast("double") - F.col("watermark").cast("double")
    return _per_window(progress.filter(F.col("seconds").isNotNull()), width, F.count(F.lit(1)).alias("batches"),
                       F.avg("seconds").alias("avg_seconds"), F.max("seconds").alias("max_seconds"), F.avg(behind).alias("avg_watermark_lag"))


def totals(progress: DataFrame) -> DataFrame:
    """Batches, rows taken in and rows dropped as late, per job."""
    return progress.groupBy("job").agg(F.countDistinct("run", "batch_id").alias("batches"), F.sum("input_rows").alias("input_rows"),
                                       F.coalesce(F.sum("late_rows"), F.lit(0).cast("long")).alias("late_rows"))


def latest_offsets(progress: DataFrame) -> DataFrame:
    """The newest end offset of each source of a job, as its source wrote it (JSON by topic and partition for Kafka)."""
    newest = F.max_by(F.struct("end_offset", "started"), F.struct("started", "batch_id"))
    return progress.groupBy("job", "source").agg(newest.alias("n")).select("job", "source", "n.end_offset", F.col("n.started").alias("seen"))
