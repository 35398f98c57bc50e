"""Customer scores, product performance, sales trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailflow.config import SCORING, SEGMENT_TEXT, SEGMENT_UNKNOWN, Scoring
from retailflow.functions.eventtime import month_label, quarter_label, week_label
from retailflow.functions.labels import at_least, at_most, first_match
from retailflow.functions.money import cents, from_cents, money_avg, money_sum
from retailflow.operators.ranking import dense_rank_desc
from retailflow.session import cut_lineage


# --- recency, frequency, monetary -------------------------------------------------------

def rfm_metrics(sales: DataFrame, analysis_date: Column) -> DataFrame:
    """Per user: days since the last sale, number of sale lines, spend."""
    return (sales.filter(F.col("transaction_timestamp").isNotNull() & F.col("user_id").isNotNull())
            .groupBy("user_id")
            .agg(F.datediff(analysis_date, F.max("transaction_timestamp").cast("date")).alias("recency_days"),
                 F.count("transaction_id").alias("frequency_count"),
                 money_sum("total_amount").alias("monetary_value"))
            .withColumn("analysis_date", analysis_date))


def rfm_scores(metrics: DataFrame, cfg: Scoring = SCORING) -> DataFrame:
    recency = at_most("recency_days", list(zip(cfg.recency_days, (5, 4, 3, 2))), 1)
    frequency = at_least("frequency_count", list(zip(cfg.frequency, (5, 4, 3, 2))), 1)
    monetary = at_least("monetary_value", list(zip(cfg.monetary, (5, 4, 3, 2))), 1)
    return (metrics
            .withColumns({"recency_score": recency, "frequency_score": frequency, "monetary_score": monetary})
            .withColumn("rfm_score", F.col("recency_score") * 100 + F.col("frequency_score") * 10
                        + F.col("monetary_score")))


def rfm_segments(scores: DataFrame) -> DataFrame:
    r, f, m = F.col("recency_score"), F.col("frequency_score"), F.col("monetary_score")
    return scores.withColumn("rfm_segment", first_match([
        ((r >= 4) & (f >= 4) & (m >= 4), "Champions"),
        ((r >= 3) & (f >= 3), "Loyal Customers"),
        ((r >= 4) & (f <= 2), "Promising"),
        ((r >= 3) & (m >= 4), "Big Spenders"),
        ((r <= 2) & (f >= 3), "At Risk"),
        ((r <= 2) & (f <= 2), "Lost")], "Regular"))


def distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), label)


def customer_segments(segmented: DataFrame) -> DataFrame:
    text = first_match([(F.col("segment_name") == name, text) for name, text in SEGMENT_TEXT], SEGMENT_UNKNOWN)
    return (segmented.groupBy(F.col("rfm_segment").alias("segment_name"))
            .agg(F.min("rfm_score").alias("min_rfm_score"), F.max("rfm_score").alias("max_rfm_score"),
                 F.count("user_id").alias("customer_count"),
                 money_sum("monetary_value").alias("total_revenue"),
                 money_avg("monetary_value").alias("avg_customer_value"),
                 F.sum("frequency_count").alias("transactions"))
            .withColumn("avg_order_value", F.try_divide("total_revenue", F.col("transactions").cast("double")))
            .withColumn("segment_description", text)
            .select("segment_name", "segment_description", "min_rfm_score", "max_rfm_score",
                    "customer_count", "total_revenue", "avg_customer_value", "avg_order_value"))


# --- products ------------------------------------------------------------------------------

def product_performance(sales: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """Sales, quantity, price, views and conversion per product.

    ``sales`` and ``views`` carry ``product_id``; each is aggregated before they meet.
    """
    metrics = (sales.filter(F.col("transaction_timestamp").isNotNull() & F.col("product_id").isNotNull())
               .groupBy("product_id", "category")
               .agg(F.count(F.lit(1)).alias("total_sales"),
                    money_sum("total_amount").alias("total_revenue"),
                    F.sum("quantity").alias("total_quantity"),
                    money_avg("unit_price").alias("avg_price")))
    if views is None:
        metrics = metrics.withColumn("total_views", F.lit(0).cast("bigint"))
    else:
        per_product = (views.filter(F.col("product_id").isNotNull())
                       .groupBy("product_id").agg(F.count(F.lit(1)).alias("view_rows")))
        metrics = (metrics.join(per_product, "product_id", "left")
                   .withColumn("total_views", F.coalesce("view_rows", F.lit(0).cast("bigint"))).drop("view_rows"))
    return metrics.withColumn(
        "conversion_rate", F.when(F.col("total_views") > 0, F.col("total_sales") / F.col("total_views") * 100.0))


def product_ranks(performance: DataFrame, cfg: Scoring = SCORING) -> DataFrame:
    """Dense ranks by revenue in the category and overall, score and tier."""
    # Both ranks and the final join read the metrics; compute the fact join behind them once.
    metrics = cut_lineage(performance)
    ranked = dense_rank_desc(metrics, "total_revenue", "category_rank", ("category",))
    ranked = dense_rank_desc(ranked, "total_revenue", "overall_rank")
    top, high, moderate = cfg.tier_ranks
    return (ranked
            .withColumn("performance_score", F.col("total_revenue") / 1000.0 + F.col("total_sales") / 10.0)
            .withColumn("performance_tier", at_most(
                "overall_rank", [(top, "Top Seller"), (high, "High Performer"), (moderate, "Moderate")],
                "Low Performer")))


def category_revenue(sales: DataFrame) -> DataFrame:
    return sales.groupBy("category").agg(
        money_sum("total_amount").alias("revenue"), F.avg("quantity").alias("avg_quantity"))


# --- trends ------------------------------------------------------------------------------

def sales_trends(sales: DataFrame, analysis_date: Column, legacy_periods: bool = False) -> DataFrame:
    """Monthly, weekly and quarterly sales per category with growth over the previous period.

    Sales are reduced to one row per day and category first, so a row is read once and only
    day totals fan out to the three grains. Week and quarter carry their year;
    ``legacy_periods`` gives the bare week and quarter numbers, merging years.
    """
    day = F.col("day")
    value = F.col("total_amount")
    daily = (sales.filter(F.col("transaction_timestamp").isNotNull())
             .groupBy(F.col("transaction_timestamp").cast("date").alias("day"), "category")
             .agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("amounts"),
                  F.sum(cents(value)).alias("cents"), F.sum("quantity").alias("quantity")))
    if legacy_periods:
        week, quarter = F.weekofyear(day), F.quarter(day)
        periods = [("monthly", month_label(day), F.lit(None).cast("int")),
                   ("weekly", week.cast("string"), week), ("quarterly", quarter.cast("string"), quarter)]
    else:
        none = F.lit(None).cast("int")
        periods = [("monthly", month_label(day), none), ("weekly", week_label(day), none),
                   ("quarterly", quarter_label(day), none)]
    grains = F.array(*[F.struct(F.lit(kind).alias("period_type"), label.alias("period_value"),
                                number.alias("period_number")) for kind, label, number in periods])
    totals = (daily.select(F.explode(grains).alias("p"), "category", "n", "amounts", "cents", "quantity")
              .groupBy("p.period_type", "p.period_value", "p.period_number", "category")
              .agg(F.sum("n").alias("total_sales"), F.sum("cents").alias("cents"),
                   F.sum("amounts").alias("amounts"), F.sum("quantity").alias("total_quantity")))
    # Periods per group are bounded by the calendar.
    previous = F.lag("total_revenue").over(
        Window.partitionBy("period_type", "category").orderBy("period_number", "period_value"))
    return (totals
            .withColumn("total_revenue", from_cents("cents"))
            .withColumn("avg_order_value", F.try_divide("total_revenue", F.col("amounts").cast("double")))
            .withColumn("previous", previous)
            .withColumn("growth_rate",
                        F.try_divide(F.col("total_revenue") - F.col("previous"), F.col("previous")) * 100)
            .withColumn("analysis_date", analysis_date)
            .select("period_type", "period_value", "category", "total_sales", "total_revenue",
                    "avg_order_value", "total_quantity", "growth_rate", "analysis_date"))


def top_trends(trends: DataFrame, n: int = 10) -> DataFrame:
    return trends.orderBy(F.col("total_revenue").desc(), "period_type", "period_value", "category").limit(n)
