"""Totals that grow by batches: per key and batch partial sums, counts and bounds that merge to those of all events.

A daily run aggregates the day's events only and adds one partial row a key; a report merges the partial rows. Every
measure is a sum, a least or a greatest value, so partial rows merge in any order and to the same bits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.functions.money import cents, from_cents
from retailflow.streaming.managed import Conflict, ManagedTable

_MERGE: dict[str, Callable[[str], Column]] = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Totals:
    """Keys and measures: name, its aggregate over events, and how partial values merge (sum, min or max)."""
    keys: tuple[str, ...]
    measures: tuple[tuple[str, Column, str], ...]

    def of(self, events: DataFrame) -> DataFrame:
        """One partial row per key."""
        return events.groupBy(*self.keys).agg(*(made.alias(name) for name, made, _ in self.measures))

    def merged(self, partial: DataFrame) -> DataFrame:
        """One row per key of any number of partial rows."""
        return partial.groupBy(*self.keys).agg(*(_MERGE[how](name).alias(name) for name, _, how in self.measures))


def customer_totals() -> Totals:
    """What the customer dimension and the recency, frequency and spend of a user need."""
    return Totals(("user_id",), (
        ("first_time", F.min("transaction_timestamp"), "min"), ("last_time", F.max("transaction_timestamp"), "max"),
        ("lines", F.count("transaction_id"), "sum"), ("spent", F.sum(cents("total_amount")), "sum"),
        ("scored_lines", F.count(F.when(F.col("transaction_timestamp").isNotNull(), F.col("transaction_id"))), "sum"),
        ("scored_spent", F.sum(F.when(F.col("transaction_timestamp").isNotNull(), cents("total_amount"))), "sum"),
        ("scored_rows", F.count("transaction_timestamp"), "sum")))


def product_totals() -> Totals:
    """What the performance of a product needs from its sales."""
    return Totals(("product_id", "category"), (
        ("rows", F.count(F.lit(1)), "sum"), ("revenue", F.sum(cents("total_amount")), "sum"),
        ("quantity", F.sum("quantity"), "sum"), ("prices", F.sum(cents("unit_price")), "sum"),
        ("priced", F.count("unit_price"), "sum")))


def view_totals() -> Totals:
    return Totals(("product_id",), (("view_rows", F.count(F.lit(1)), "sum"),))


class TotalsTable:
    """Partial rows in a managed table: each batch once, whatever is run again."""

    def __init__(self, table: ManagedTable, totals: Totals):
        self.table, self.totals = table, totals

    def add(self, batch: int | str, events: DataFrame) -> bool:
        """Add a batch's events; a batch that was added before changes nothing."""
        return self.table.append(self.totals.of(events), batch)

    def read(self) -> DataFrame:
        return self.totals.merged(self.table.read())

    def fold(self) -> bool:
        """Merge the partial rows of all batches into one row a key, so reads stay as small as the keys are many."""
        now = self.table.log.snapshot()
        if len(now.live) < 2:
            return False
        staged = self.table.stage(self.totals.merged(self.table.rows(sorted(now.live), now.schema)))
        try:
            self.table.commit([staged], now.live)
        except Conflict:
            self.table._delete(staged)
            return False
        return True


def customer_stats(totals: DataFrame) -> DataFrame:
    """The statistics that ``dimensions.customer_stats`` makes of all events."""
    return totals.select(
        "user_id", F.col("first_time").cast("date").alias("first_transaction_date"),
        F.col("last_time").cast("date").alias("last_transaction_date"), F.col("lines").alias("total_transactions"),
        from_cents("spent").alias("total_spent"))


def rfm_metrics(totals: DataFrame, analysis_date: Column) -> DataFrame:
    """The metrics that ``analytics.rfm_metrics`` makes of all sales."""
    return (totals.filter(F.col("user_id").isNotNull() & (F.col("scored_rows") > 0)).select(
        "user_id", F.datediff(analysis_date, F.col("last_time").cast("date")).alias("recency_days"),
        F.col("scored_lines").alias("frequency_count"), from_cents("scored_spent").alias("monetary_value"))
        .withColumn("analysis_date", analysis_date))


def product_performance(sales: DataFrame, views: DataFrame) -> DataFrame:
    """The table that ``analytics.product_performance`` makes of all sales and views.

    ``sales`` are totals of sales with a time and a product, ``views`` of views with a product.
    """
    metrics = sales.select(
        "product_id", "category", F.col("rows").alias("total_sales"), from_cents("revenue").alias("total_revenue"),
        F.col("quantity").alias("total_quantity"),
        F.try_divide(from_cents("prices"), F.col("priced").cast("double")).alias("avg_price"))
    joined = metrics.join(views, "product_id", "left").withColumn("total_views", F.coalesce("view_rows", F.lit(0).cast("bigint")))
    return joined.drop("view_rows").withColumn(
        "conversion_rate", F.when(F.col("total_views") > 0, F.col("total_sales") / F.col("total_views") * 100.0))
