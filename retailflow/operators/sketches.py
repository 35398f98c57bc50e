"""Distinct users and products over any range: a sketch per window, merged to hours, days or months.

Counts of distinct users don't add up over windows; sketches do. A window row stores one of a few kB, streams can make
it, and the relative error is about 1.04 / 2^(lg_k / 2) at every size: 1.6 % at the default, five such in no practical case.
Counts far below 2^lg_k are met exactly. Where counts must be exact at every size, the members themselves are kept: a row
per window, key and distinct id, which rolls up the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.config import Windowing
from retailflow.functions.money import cents, from_cents
from retailflow.operators.windows import windowed

LG_K = 12


def error_bound(lg_k: int = LG_K, sigmas: float = 3.0) -> float:
    """Relative error that an estimate of merged sketches stays within, for so many standard errors."""
    return sigmas * 1.04 / 2 ** (lg_k / 2)


def view_sketches(views: DataFrame, spec: Windowing, keys: tuple[str, ...] = ("category", "country"), lg_k: int = LG_K) -> DataFrame:
    """Views per window and key: rows, cents of the prices, and sketches of users and products; batch or stream."""
    return windowed(views.filter(F.col("event_type") == "view"), spec, list(keys),
                    F.count(F.lit(1)).alias("total_views"), F.sum(cents("price")).alias("price_cents"), F.count("price").alias("priced"),
                    F.hll_sketch_agg("user_id", lg_k).alias("users"), F.hll_sketch_agg("product_id", lg_k).alias("products"))


def rolled_up(table: DataFrame, unit: str, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """Windows of a finer table as windows of one ``unit`` (hour, day, month, ...) and fewer keys, sketches again.

    Reads window rows, never events; rolls up its own results as well.
    """
    start = F.date_trunc(unit, F.col("window_start")) if "window_start" in table.columns else F.date_trunc(unit, F.col("period"))
    return table.groupBy(start.alias("period"), *keys).agg(
        F.sum("total_views").alias("total_views"), F.sum("price_cents").alias("price_cents"), F.sum("priced").alias("priced"),
        F.hll_union_agg("users").alias("users"), F.hll_union_agg("products").alias("products"))


def estimated(table: DataFrame) -> DataFrame:
    """The counts that the sketches stand for."""
    kept = [c for c in table.columns if c not in ("users", "products", "price_cents", "priced")]
    return table.select(*kept, F.hll_sketch_estimate("users").alias("unique_users"),
                        F.hll_sketch_estimate("products").alias("unique_products"),
                        F.try_divide(from_cents("price_cents"), F.col("priced").cast("double")).alias("avg_product_price"))


def view_members(views: DataFrame, spec: Windowing, keys: tuple[str, ...] = ("category", "country")) -> DataFrame:
    """Views per window and key as rows of their distinct users and products; totals are on the users' rows.

    Reduced in the tasks first, so a hot window or key sends a row per task and id.
    """
    def member(kind: str, *totals: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_id").cast("string").alias("id"),
                        *(c.cast("bigint").alias(name) for c, name in zip(totals, ("n", "cents", "has_price"))))

    zero, price = F.lit(0), cents("price")
    members = F.array(member("user", F.lit(1), price, price.isNotNull().cast("int")), member("product", zero, F.lit(None), zero))
    rows = views.filter(F.col("event_type") == "view").select("timestamp", *keys, F.inline(members))
    return windowed(rows, spec, [*keys, "kind", "id"], F.sum("n").alias("total_views"),
                    F.sum("cents").alias("price_cents"), F.sum("has_price").alias("priced"))


def rolled_up_members(table: DataFrame, unit: str, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """:func:`rolled_up` for rows of members: each distinct member once per ``unit`` and fewer keys."""
    start = F.date_trunc(unit, F.col("window_start")) if "window_start" in table.columns else F.date_trunc(unit, F.col("period"))
    return table.groupBy(start.alias("period"), *keys, "kind", "id").agg(
        *(F.sum(c).alias(c) for c in ("total_views", "price_cents", "priced")))


def counted_members(table: DataFrame, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """The exact counts of rolled up members; an id that is NULL is no member."""
    def members(kind: str) -> Column:
        return F.count(F.when(F.col("kind") == kind, F.col("id")))

    return table.groupBy("period", *keys).agg(
        F.sum("total_views").alias("total_views"), members("user").alias("unique_users"), members("product").alias("unique_products"),
        F.try_divide(from_cents(F.sum("price_cents")), F.sum("priced").cast("double")).alias("avg_product_price"))
