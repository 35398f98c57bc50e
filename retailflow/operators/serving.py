"""Report queries over the real-time tables and the warehouse.

Every report takes the tables it reads; apply ``ingest.time_range`` to them first for a
dashboard range. Ties in top-k reports are broken by the group keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailflow.functions.money import exact_avg, money_avg, money_sum, rounded_pct


def _sum(name: str) -> Column:
    return F.sum(name).cast("bigint")


def series(df: DataFrame, **measures: Column) -> DataFrame:
    """Measures per window end, in time order."""
    return (df.groupBy(F.col("window_end").alias("time"))
            .agg(*[c.alias(n) for n, c in measures.items()]).orderBy("time"))


def top(df: DataFrame, keys: list[str], n: int, by: str, **measures: Column) -> DataFrame:
    return (df.groupBy(*keys).agg(*[c.alias(name) for name, c in measures.items()])
            .orderBy(F.col(by).desc_nulls_last(), *keys).limit(n))


# --- business dashboard ------------------------------------------------------------------

def kpi_sales(sales: DataFrame) -> DataFrame:
    return sales.agg(money_sum("total_revenue").alias("total_revenue"),
                     _sum("total_transactions").alias("total_transactions"),
                     exact_avg("avg_order_value").alias("avg_order_value"))


def kpi_cart_conversion(carts: DataFrame) -> DataFrame:
    return (carts.agg(F.sum("checkouts").alias("c"), F.sum("adds").alias("a"))
            .select(rounded_pct("c", "a", 1).alias("conversion_rate")))


def sales_series(sales: DataFrame) -> DataFrame:
    return series(sales, revenue=money_sum("total_revenue"), transactions=_sum("total_transactions"))


def top_countries(sales: DataFrame, n: int = 10) -> DataFrame:
    return top(sales, ["country"], n, "revenue", revenue=money_sum("total_revenue"))


def top_trending(trending: DataFrame, n: int = 10) -> DataFrame:
    return top(trending, ["product_id", "product_name", "category"], n, "view_count",
               view_count=_sum("view_count")).drop("product_id")


def cart_series(carts: DataFrame) -> DataFrame:
    return series(carts, cart_adds=_sum("adds"), checkouts=_sum("checkouts"))


def top_abandonment(abandoned: DataFrame, n: int = 10) -> DataFrame:
    return top(abandoned, ["country"], n, "lost_revenue", abandoned_sessions=F.count(F.lit(1)),
               lost_revenue=money_sum("abandoned_cart_value"))


def top_categories(categories: DataFrame, n: int = 10) -> DataFrame:
    return top(categories, ["category"], n, "total_views", total_views=_sum("total_views"))


def recent_anomalies(high_value: DataFrame, n: int = 20) -> DataFrame:
    return (high_value.select("transaction_id", "user_id", "timestamp", "total_amount", "country", "severity",
                              "anomaly_reason")
            .orderBy(F.col("timestamp").desc(), "transaction_id").limit(n))


# --- stream dashboard ---------------------------------------------------------------------

def latency() -> Column:
    """Seconds from window end to the moment the row was written."""
    return (F.unix_micros("created_at") - F.unix_micros("window_end")) / F.lit(1e6)


def latency_avg(table: DataFrame) -> DataFrame:
    return table.agg(exact_avg(latency()).alias("avg_latency"))


def latency_series(**tables: DataFrame) -> DataFrame:
    """Average latency per window end and job, one row per (time, job)."""
    return _stack(tables, lambda t: exact_avg(latency()), "latency")


def stream_kpis(sales: DataFrame, carts: DataFrame, anomalies: DataFrame) -> DataFrame:
    parts = [
        sales.agg(F.count(F.lit(1)).alias("value")).withColumn("metric", F.lit("total_windows")),
        carts.agg(_sum("checkouts").alias("value")).withColumn("metric", F.lit("total_checkouts")),
        anomalies.agg(_sum("total_anomalies").alias("value")).withColumn("metric", F.lit("anomaly_count"))]
    return reduce(DataFrame.unionByName, parts).select("metric", "value")


# fixed values: job label and the column that counts its events
EVENT_COUNTS = {
    "Sales Aggregator": "total_transactions",
    "Cart Analyzer": "total_cart_events",
    "Product View Analyzer": "total_views",
    "Anomaly Detector": "total_anomalies",
    "Inventory Tracker": "total_units_sold",
}


def events_per_job(tables: dict[str, DataFrame]) -> DataFrame:
    """``tables``: job label -> its output table."""
    parts = [df.agg(_sum(EVENT_COUNTS[job]).alias("events_processed"))
             .select(F.lit(job).alias("job"), "events_processed") for job, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def throughput_series(tables: dict[str, DataFrame]) -> DataFrame:
    return _stack(tables, lambda job: _sum(EVENT_COUNTS[job]), "events")


def severity_series(stats: DataFrame) -> DataFrame:
    return series(stats, critical=_sum("critical_count"), high=_sum("high_severity_count"),
                  medium=_sum("medium_severity_count"))


def _stack(tables: dict[str, DataFrame], measure, name: str) -> DataFrame:
    parts = [df.groupBy(F.col("window_end").alias("time")).agg(measure(job).alias(name))
             .select("time", F.lit(job).alias("job"), name) for job, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).orderBy("time", "job")


# --- warehouse reports -----------------------------------------------------------------------

def latest(table: DataFrame) -> DataFrame:
    """Rows of the newest analysis date; on a table partitioned by it only that partition is read.

    Meant for stored tables: the newest date is a query of its own. Rows computed for one date are given to
    the reports as they are, with ``one_date``.
    """
    return table.filter(F.col("analysis_date") == table.agg(F.max("analysis_date")).scalar())


def top_products(performance: DataFrame, n: int = 10, one_date: bool = False) -> DataFrame:
    return ((performance if one_date else latest(performance)).orderBy(F.col("total_revenue").desc(), "product_id").limit(n)
            .select("product_id", "category", "total_sales", "total_revenue", "conversion_rate"))


def top_products_view(performance: DataFrame, n: int = 100, one_date: bool = False) -> DataFrame:
    return ((performance if one_date else latest(performance)).orderBy(F.col("total_revenue").desc(), "product_id").limit(n)
            .select("product_id", "category", "total_sales", "total_revenue", "total_quantity",
                    "conversion_rate", "performance_tier", "analysis_date"))


def segment_share(segments: DataFrame) -> DataFrame:
    """At most one row per segment name reaches the unpartitioned window."""
    everyone = F.sum("customer_count").over(Window.partitionBy(F.lit(1)))
    return (segments.select("segment_name", "customer_count", "total_revenue", "avg_order_value",
                            rounded_pct(F.col("customer_count"), everyone, 2).alias("pct_customers"))
            .orderBy(F.col("total_revenue").desc(), "segment_name"))


def _orders_and_revenue() -> list[Column]:
    return [F.count_distinct("transaction_id").alias("num_orders"),
            money_sum("total_amount").alias("revenue"), money_avg("total_amount").alias("avg_order_value")]


def daily_trend(sales: DataFrame, dates: DataFrame, n: int = 30) -> DataFrame:
    return (sales.join(F.broadcast(dates.select("date_id", "date")), "date_id", "left").groupBy("date").agg(*_orders_and_revenue())
            .orderBy(F.col("date").desc()).limit(n))


def sales_by_geography(sales: DataFrame, geography: DataFrame) -> DataFrame:
    named = geography.filter("is_current").select("geography_id", "country")
    return (sales.join(F.broadcast(named), "geography_id").groupBy("country").agg(*_orders_and_revenue())
            .orderBy(F.col("revenue").desc(), "country"))


def category_conversion(products: DataFrame, views: DataFrame, sales: DataFrame) -> DataFrame:
    """Distinct views and orders per category.

    Joining both facts to a product at once would multiply their rows; each side is counted
    by category on its own and only the counts are joined.
    """
    versions = products.select("product_id_pk", "category", "is_current")
    viewed = (views.join(versions.filter("is_current"), "product_id_pk")
              .groupBy(F.col("category").alias("v_category")).agg(F.count_distinct("event_id").alias("v")))
    sold = (sales.join(versions, "product_id_pk")
            .groupBy(F.col("category").alias("s_category")).agg(F.count_distinct("transaction_id").alias("s")))
    every = versions.select("category").distinct()
    joined = (every.join(viewed, F.col("category").eqNullSafe(F.col("v_category")), "left")
              .join(sold, F.col("category").eqNullSafe(F.col("s_category")), "left"))
    zero = F.lit(0).cast("bigint")
    return (joined.select("category", F.coalesce("v", zero).alias("total_views"),
                          F.coalesce("s", zero).alias("total_sales"))
            .withColumn("conversion_rate", rounded_pct("total_sales", "total_views", 2))
            .orderBy(F.col("conversion_rate").desc_nulls_last(), "category"))


def top_customers(customers: DataFrame, n: int = 20) -> DataFrame:
    return (customers.filter("is_current").orderBy(F.col("total_spent").desc(), "user_id").limit(n)
            .select("user_id", "customer_segment", "total_transactions", "total_spent", "avg_order_value",
                    "first_transaction_date", "last_transaction_date"))


def champions(rfm: DataFrame, n: int = 50, one_date: bool = False) -> DataFrame:
    return ((rfm if one_date else latest(rfm)).filter(F.col("rfm_segment") == "Champions")
            .orderBy(F.col("monetary_value").desc(), "user_id").limit(n)
            .select("user_id", "recency_days", "frequency_count", "monetary_value", "rfm_segment"))


def hourly_revenue(sales: DataFrame) -> DataFrame:
    return (sales.groupBy(F.date_trunc("hour", "transaction_timestamp").alias("time"))
            .agg(money_sum("total_amount").alias("revenue")).orderBy("time"))


def customer_lifetime_value(customers: DataFrame) -> DataFrame:
    return (customers.filter(F.col("is_current") & (F.col("total_transactions") > 0))
            .select("user_id", "customer_segment", "total_transactions",
                    F.col("total_spent").alias("lifetime_value"), "avg_order_value",
                    F.datediff("last_transaction_date", "first_transaction_date").alias("customer_lifetime_days"),
                    "is_active")
            .orderBy(F.col("lifetime_value").desc(), "user_id"))
