"""Dimension builders and slowly changing (type 2) history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.config import OPEN_END, SCORING, Scoring
from retailflow.functions.labels import at_least
from retailflow.functions.money import money_sum

SCD_COLUMNS = ("effective_start_date", "effective_end_date", "is_current")


# --- attributes --------------------------------------------------------------------

def date_dimension(days: DataFrame) -> DataFrame:
    """Calendar attributes; the key is the date written as yyyymmdd."""
    d = F.col("date")
    weekday = F.dayofweek(d)
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_id"), d,
        F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.weekofyear(d).alias("week"), F.dayofmonth(d).alias("day"), weekday.alias("day_of_week"),
        F.date_format(d, "EEEE").alias("day_name"), F.date_format(d, "MMMM").alias("month_name"),
        weekday.isin(1, 7).alias("is_weekend"), F.lit(False).alias("is_holiday"))


def geography_dimension(rows: DataFrame) -> DataFrame:
    return rows.select("country", "region", "continent", "currency", "timezone")


def customer_stats(lines: DataFrame) -> DataFrame:
    """First and last purchase day, number of sale lines and spend per user."""
    return lines.groupBy("user_id").agg(
        F.min("transaction_timestamp").cast("date").alias("first_transaction_date"),
        F.max("transaction_timestamp").cast("date").alias("last_transaction_date"),
        F.count("transaction_id").alias("total_transactions"),
        money_sum("total_amount").alias("total_spent"))


def customer_dimension(stats: DataFrame, cfg: Scoring = SCORING) -> DataFrame:
    high, medium, low = cfg.spend_segments
    n = F.col("total_transactions")
    return stats.select(
        "user_id", "first_transaction_date", "last_transaction_date", "total_transactions", "total_spent",
        F.when(n > 0, F.col("total_spent") / n).otherwise(F.lit(0.0)).alias("avg_order_value"),
        at_least("total_spent", [(high, "High Value"), (medium, "Medium Value"), (low, "Low Value")], "New")
        .alias("customer_segment"),
        F.lit(None).cast("int").alias("rfm_score"),
        (n > 0).alias("is_active"))


def product_dimension(catalog: DataFrame) -> DataFrame:
    return catalog.select(
        "product_id", F.col("name").alias("product_name"), "category",
        F.lit(None).cast("string").alias("subcategory"),
        F.col("price").alias("base_price"),
        (F.col("price") * 0.6).alias("cost"), (F.col("price") * 0.4).alias("margin"),
        F.lit(True).alias("is_active"))


# --- type 2 history ------------------------------------------------------------------

def surrogate(natural_key: str, start: str = "effective_start_date") -> Column:
    """64-bit key of one version: stable across reruns, no global counter."""
    return F.xxhash64(F.col(natural_key), F.col(start))


def colliding_keys(dim: DataFrame, surrogate_key: str) -> DataFrame:
    """Surrogates shared by two versions; a load must find none."""
    return dim.groupBy(surrogate_key).agg(F.count(F.lit(1)).alias("versions")).filter("versions > 1")


def as_of(events: DataFrame, dim: DataFrame, natural: str, ts: str, *attributes: str) -> DataFrame:
    """``attributes`` of the version that was valid at the time of each event; NULL before the first one."""
    versions = dim.select(F.col(natural).alias("_key"), "effective_start_date", "effective_end_date", *attributes)
    valid = (F.col(ts) >= F.col("effective_start_date")) & (F.col(ts) < F.col("effective_end_date"))
    return (events.join(versions, (F.col(natural) == F.col("_key")) & valid, "left")
            .drop("_key", "effective_start_date", "effective_end_date"))


def first_versions(incoming: DataFrame, now: Column) -> DataFrame:
    return incoming.select(
        "*", now.cast("timestamp").alias("effective_start_date"),
        F.lit(OPEN_END).cast("timestamp").alias("effective_end_date"), F.lit(True).alias("is_current"))


def current(dim: DataFrame) -> DataFrame:
    return dim.filter("is_current")


def _attributes(incoming: DataFrame, key: str, ignore: Sequence[str]) -> list[str]:
    return [c for c in incoming.columns if c != key and c not in ignore and c not in SCD_COLUMNS]


def _changed(attributes: list[str]) -> Column:
    """Some attribute differs, NULL counting as a value."""
    differs = F.lit(False)
    for a in attributes:
        differs = differs | ~F.col(f"old.{a}").eqNullSafe(F.col(f"new.{a}"))
    return differs


def new_keys(dim: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    return incoming.join(current(dim).select(key), key, "left_anti")


def changed_rows(dim: DataFrame, incoming: DataFrame, key: str, ignore: Sequence[str] = ()) -> DataFrame:
    """Incoming rows whose current version has other attribute values."""
    new, old = incoming.alias("new"), current(dim).alias("old")
    return (new.join(old, F.col(f"new.{key}") == F.col(f"old.{key}"))
            .filter(_changed(_attributes(incoming, key, ignore)))
            .select("new.*"))


def _joined_versions(dim: DataFrame, incoming: DataFrame, key: str, now: Column, ignore: Sequence[str],
                     columns: list[str]) -> tuple[DataFrame, Column, Column, Column]:
    """Current versions joined with incoming rows: (join, the old version as it becomes, the version that is added, whether
    the old one is replaced)."""
    new = incoming.select(*columns, F.lit(True).alias("here")).alias("new")
    old = current(dim).select(*columns, *SCD_COLUMNS, F.lit(True).alias("here")).alias("old")

    is_old, is_new = F.col("old.here").isNotNull(), F.col("new.here").isNotNull()
    replaced = is_old & is_new & _changed(_attributes(incoming, key, ignore))

    def version(side: str, start: Column, end: Column, flag: Column) -> Column:
        return F.struct(*[F.col(f"{side}.{c}").alias(c) for c in columns],
                        start.alias("effective_start_date"), end.alias("effective_end_date"),
                        flag.alias("is_current"))

    kept = F.when(is_old, version(
        "old", F.col("old.effective_start_date"),
        F.when(replaced, now).otherwise(F.col("old.effective_end_date")), ~replaced))
    added = F.when(is_new & (~is_old | replaced), version(
        "new", now, F.lit(OPEN_END).cast("timestamp"), F.lit(True)))
    return new.join(old, F.col(f"new.{key}") == F.col(f"old.{key}"), "full_outer"), kept, added, replaced


def _listed(joined: DataFrame, *versions: Column) -> DataFrame:
    return (joined.select(F.explode(F.filter(F.array(*versions), lambda v: v.isNotNull())).alias("v")).select("v.*"))


def scd2_merge(dim: DataFrame, incoming: DataFrame, key: str, now: Column,
               ignore: Sequence[str] = ()) -> DataFrame:
    """Next snapshot of a dimension.

    One full outer join of the current versions with the incoming rows decides what each
    key becomes: untouched, unchanged, expired plus a new version, or a first version.
    Closed versions pass through. With no current rows everything is a first version.
    """
    columns = [c for c in incoming.columns if c not in SCD_COLUMNS]
    joined, kept, added, _ = _joined_versions(dim, incoming, key, now.cast("timestamp"), ignore, columns)
    closed = dim.filter(~F.col("is_current")).select(*columns, *SCD_COLUMNS)
    return closed.unionByName(_listed(joined, kept, added))


def scd2_delta(dim: DataFrame, incoming: DataFrame, key: str, now: Column, ignore: Sequence[str] = ()) -> DataFrame:
    """What :func:`scd2_merge` changes: the versions that end, with their end, and those that begin."""
    columns = [c for c in incoming.columns if c not in SCD_COLUMNS]
    joined, kept, added, replaced = _joined_versions(dim, incoming, key, now.cast("timestamp"), ignore, columns)
    return _listed(joined, F.when(replaced, kept), added)
