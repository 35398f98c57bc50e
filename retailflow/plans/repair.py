"""Late members: facts that were loaded before their customer, product or country was known get their key."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.streaming import sinks


@dataclass(frozen=True)
class Lookup:
    """All versions of a dimension, with the names of its natural key and surrogate."""
    versions: DataFrame
    natural: str
    surrogate: str


def valid_or_first(events: DataFrame, by: Lookup, ts: str) -> DataFrame:
    """``events`` with the surrogate of the version valid at their time; before a key's first version, that one.

    A key's versions don't overlap, so an event meets one of them; the first one is stretched back to all
    earlier times. NULL for unknown keys.
    """
    firsts = by.versions.groupBy(by.natural).agg(F.min("effective_start_date").alias("_first"))
    spans = by.versions.join(firsts, by.natural).select(
        F.col(by.natural).alias("_natural"), F.col(by.surrogate),
        F.when(F.col("effective_start_date") > F.col("_first"), F.col("effective_start_date")).alias("_from"),
        F.col("effective_end_date").alias("_until"))
    valid = (F.col("_from").isNull() | (F.col(ts) >= F.col("_from"))) & (F.col(ts) < F.col("_until"))
    return events.join(spans, (F.col(by.natural) == F.col("_natural")) & valid, "left").drop("_natural", "_from", "_until")


#: Rows up to which what is looked up or filled goes to every task, so that the many rows it meets aren't shuffled.
FEW = 100_000


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def repair_facts(spark: SparkSession, path: str, events: DataFrame, lookups: list[Lookup], ts: str,
                 key: str = "event_id", partition: str = "date_id", **options: str) -> int:
    """Fill NULL surrogates of a stored fact table; returns the number of its partitions that were rewritten.

    ``events`` are the loaded events with ``key`` and the natural keys; facts hold none. Facts may share a ``key`` that fixes their
    natural keys and time, as lines of a transaction do. Only facts with a NULL
    surrogate whose member is known by now are looked up, and only their days (or months: whatever the table is partitioned
    by) are rewritten, with the writer's ``options``. Surrogates that are there stay. Facts without a day are a partition of their own. An event without its natural key keeps its NULL.
    """
    facts = spark.read.parquet(path)
    missing = " or ".join(f"{by.surrogate} is null" for by in lookups)
    open_ = facts.filter(missing).select(F.col(key).alias("_fact"), F.col(partition), F.col(ts),
                                         *(F.col(by.surrogate).alias(f"_{by.surrogate}") for by in lookups))
    naturals = events.select(F.col(key).alias("_event"), *(by.natural for by in lookups))
    found = naturals.join(_few(open_, open_.count()), F.col("_fact") == F.col("_event"))
    for by in lookups:
        found = valid_or_first(found, by, ts)
    fillable = " or ".join(f"(_{by.surrogate} is null and {by.surrogate} is not null)" for by in lookups)
    # Neither an event nor a fact that comes twice doubles a fact: a key has one row a partition.
    fixed = sinks.cut(found.filter(fillable).select(
        "_fact", F.col(partition).alias("_part"), *(F.col(by.surrogate).alias(f"_new_{by.surrogate}") for by in lookups))
        .dropDuplicates(["_fact", "_part"]))
    counts = fixed.groupBy("_part").count().collect()  # a number a day
    days = [r[0] for r in counts]
    if not days:
        return 0
    touched = facts.filter(F.col(partition).isin([d for d in days if d is not None])
                           | (F.col(partition).isNull() if None in days else F.lit(False)))
    replaced = {by.surrogate: F.coalesce(by.surrogate, f"_new_{by.surrogate}") for by in lookups}
    same = (F.col(key) == F.col("_fact")) & F.col(partition).eqNullSafe(F.col("_part"))
    repaired = touched.join(_few(fixed, sum(r["count"] for r in counts)), same, "left").withColumns(replaced).select(*facts.columns)
    sinks.replace_partitions(repaired, path, partition, **options)
    return len(days)
