"""Ranks that do not sort a whole group inside one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailflow.session import cut_lineage


def _renamed(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in columns})


def _same(columns: list[str]) -> Column:
    """Null-safe equality with the ``_renamed`` side."""
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns])


def dense_rank_desc(df: DataFrame, value: str, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """``dense_rank() over (partition by within order by value desc)`` at any group size.

    Distinct values are range-partitioned, so even one group's values spread over all
    tasks. Each slice is ranked locally and shifted by the number of distinct values in
    the slices before it; only those per-slice counts (slices + groups rows) meet in one
    task per group. The slices are materialised because range bounds come from
    sampling and both passes must see the same ones.
    """
    keys = [*within, value]
    order = [F.col(k).asc_nulls_first() for k in within] + [F.col(value).desc_nulls_last()]
    sliced = cut_lineage(df.select(*keys).distinct().repartitionByRange(*order)
                         .withColumn("slice", F.spark_partition_id()))

    local = F.row_number().over(Window.partitionBy(*within, "slice").orderBy(F.col(value).desc_nulls_last()))
    before = (Window.partitionBy(*within).orderBy("slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    shift = (sliced.groupBy(*within, "slice").agg(F.count(F.lit(1)).alias("values"))
             .withColumn("shift", F.coalesce(F.sum("values").over(before), F.lit(0)))
             .drop("values"))
    places = [*within, "slice"]
    ranks = (sliced.withColumn("local", local)
             .join(_renamed(shift, places), _same(places))
             .select(*keys, (F.col("local") + F.col("shift")).cast("int").alias(name)))
    return df.join(_renamed(ranks, keys), _same(keys), "left").select(*df.columns, name)
