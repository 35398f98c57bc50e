"""Event-time window operators over transactions, carts, views and sale lines.

None of them sets a watermark: the source declares it once. Every aggregate has a
map-side partial, so a window or country that holds most of the rows still reaches
the shuffle as one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.config import REALTIME, SESSION_TIMEOUT, Realtime, Windowing
from retailflow.functions.eventtime import duration
from retailflow.functions.labels import at_least, count_where, distinct_count
from retailflow.functions.money import line_total, money_avg, money_sum


def windowed(df: DataFrame, spec: Windowing, keys: list[str], *aggregates: Column) -> DataFrame:
    """Group by window and keys; the window struct is flattened to its two ends."""
    frame = F.window("timestamp", spec.width, spec.slide) if spec.slide else F.window("timestamp", spec.width)
    grouped = df.groupBy(frame, *keys).agg(*aggregates)
    rest = [c for c in grouped.columns if c != "window"]
    return grouped.select(F.col("window.start").alias("window_start"),
                          F.col("window.end").alias("window_end"), *rest)


def _is(event_type: str) -> Column:
    return F.col("event_type") == event_type


def _rows() -> Column:
    return F.count(F.lit(1))


# --- sales -------------------------------------------------------------------

def _sales(transactions: DataFrame, spec: Windowing, keys: list[str]) -> DataFrame:
    return windowed(transactions, spec, keys,
                    F.count("transaction_id").alias("total_transactions"),
                    money_sum("total_amount").alias("total_revenue"),
                    money_avg("total_amount").alias("avg_order_value"))


def sales_per_window(transactions: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    return _sales(transactions, cfg.sales, [])


def sales_by_country(transactions: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    return _sales(transactions, cfg.sales, ["country"])


# --- carts -------------------------------------------------------------------

def cart_sessions(carts: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    sessions = windowed(
        carts, cfg.cart_sessions, ["user_id", "session_id", "country"],
        count_where(_is("add_to_cart")).alias("add_count"),
        count_where(_is("remove_from_cart")).alias("remove_count"),
        count_where(_is("update_quantity")).alias("update_count"),
        count_where(_is("checkout")).alias("checkout_count"),
        F.max("cart_value").alias("max_cart_value"),
        F.max("timestamp").alias("last_activity"),
        _rows().alias("total_events"))
    return sessions.withColumn("session_completed", F.col("checkout_count") > 0)


def abandoned_carts(carts: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    """Sliding windows in which a session added items and never checked out."""
    return (windowed(
        carts, cfg.abandonment, ["user_id", "session_id", "country"],
        count_where(_is("add_to_cart")).alias("items_added"),
        count_where(_is("checkout")).alias("checkouts"),
        F.max("cart_value").alias("abandoned_cart_value"),
        F.max("timestamp").alias("last_activity"),
        _rows().alias("total_events"))
        .filter((F.col("items_added") > 0) & (F.col("checkouts") == 0))
        .drop("checkouts"))


def cart_metrics(carts: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    metrics = windowed(
        carts, cfg.cart_metrics, ["country"],
        _rows().alias("total_cart_events"),
        count_where(_is("add_to_cart")).alias("adds"),
        count_where(_is("remove_from_cart")).alias("removes"),
        count_where(_is("update_quantity")).alias("updates"),
        count_where(_is("checkout")).alias("checkouts"),
        money_avg("cart_value").alias("avg_cart_value"),
        F.max("cart_value").alias("max_cart_value"))
    rate = (F.col("adds") - F.col("checkouts")) / F.col("adds") * 100
    return metrics.withColumn("abandonment_rate_pct", F.when(F.col("adds") > 0, rate).otherwise(F.lit(0.0)))


# --- views -------------------------------------------------------------------

def trending_products(views: DataFrame, cfg: Realtime = REALTIME, exact: bool = False) -> DataFrame:
    return windowed(
        views.filter(_is("view")), cfg.trending, ["product_id", "product_name", "category"],
        _rows().alias("view_count"),
        distinct_count("user_id", exact).alias("unique_viewers"),
        F.avg("view_duration").alias("avg_view_duration"),
        F.max("price").alias("product_price")).filter(F.col("view_count") >= cfg.trending_min_views)


def category_performance(views: DataFrame, cfg: Realtime = REALTIME, exact: bool = False) -> DataFrame:
    return windowed(
        views.filter(_is("view")), cfg.categories, ["category", "country"],
        _rows().alias("total_views"),
        distinct_count("user_id", exact).alias("unique_users"),
        distinct_count("product_id", exact).alias("unique_products"),
        F.avg("view_duration").alias("avg_view_duration"),
        money_avg("price").alias("avg_product_price"))


def search_behavior(views: DataFrame, cfg: Realtime = REALTIME, exact: bool = False) -> DataFrame:
    return windowed(
        views.filter(_is("search")), cfg.searches, ["search_query", "country"],
        _rows().alias("search_count"),
        distinct_count("user_id", exact).alias("unique_searchers"),
        F.avg("results_count").alias("avg_results")).filter(F.col("search_count") >= cfg.search_min_count)


def activity_sessions(events: DataFrame, gap: str = SESSION_TIMEOUT) -> DataFrame:
    """Sessions of a user, ended by a pause of ``gap``; the end is the last event plus the pause."""
    return (events.groupBy(F.session_window("timestamp", gap).alias("s"), "user_id")
            .agg(F.count(F.lit(1)).alias("events"), F.max("timestamp").alias("last_event"))
            .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "events", "last_event"))


def browsing_sessions(views: DataFrame, cfg: Realtime = REALTIME, exact: bool = False) -> DataFrame:
    sessions = windowed(
        views, cfg.browsing, ["user_id", "session_id", "country"],
        count_where(_is("view")).alias("views"),
        count_where(_is("search")).alias("searches"),
        count_where(_is("filter")).alias("filters"),
        count_where(_is("compare")).alias("compares"),
        distinct_count("product_id", exact).alias("unique_products_viewed"),
        F.avg("view_duration").alias("avg_view_duration"),
        F.min("timestamp").alias("first_activity"),
        F.max("timestamp").alias("last_activity"),
        _rows().alias("total_events"))
    return sessions.withColumn(
        "session_duration_sec", F.col("last_activity").cast("long") - F.col("first_activity").cast("long"))


# --- sale lines ---------------------------------------------------------------

def _units() -> Column:
    return F.sum("quantity").alias("units_sold")


def _revenue() -> Column:
    return line_total("quantity", "unit_price").alias("total_revenue")


def product_sales_velocity(lines: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    return windowed(lines, cfg.velocity, ["product_id"], _units(), _revenue(),
                    money_avg("unit_price").alias("avg_price"))


def inventory_by_country(lines: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    return windowed(lines, cfg.velocity, ["product_id", "country"], _units(), _revenue())


def high_demand_alerts(lines: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    minimum, high, critical = cfg.demand_units
    return (windowed(lines, cfg.demand, ["product_id"], _units(), _revenue())
            .filter(F.col("units_sold") >= minimum)
            .withColumn("demand_level", at_least("units_sold", [(critical, "critical"), (high, "high")], "medium")))


def restock_alerts(lines: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    """Rate of sale per ``restock_rate_unit``; the divisor follows the window width."""
    low, medium, high = cfg.restock_rates
    units = duration(cfg.restock.width) / duration(cfg.restock_rate_unit)
    rate = "sales_rate_per_" + {"minute": "min"}.get(cfg.restock_rate_unit.split()[1], cfg.restock_rate_unit.split()[1])
    return (windowed(lines, cfg.restock, ["product_id", "country"], _units())
            .withColumn(rate, F.col("units_sold") / F.lit(float(units)))
            .filter(F.col(rate) >= low)
            .withColumn("urgency", at_least(rate, [(high, "high"), (medium, "medium")], "low")))


def inventory_metrics(lines: DataFrame, cfg: Realtime = REALTIME, exact: bool = False) -> DataFrame:
    return windowed(lines, cfg.inventory, ["country"],
                    F.sum("quantity").alias("total_units_sold"),
                    distinct_count("product_id", exact).alias("unique_products_sold"),
                    _revenue(),
                    count_where(F.col("quantity") >= cfg.fast_moving_quantity).alias("fast_moving_products"))
