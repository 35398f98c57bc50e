import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from retailflow.config import CATEGORIES
from retailflow.operators import analytics, catalog, serving
from retailflow.operators.ranking import dense_rank_desc
from retailflow.functions import money

def day():
    return F.lit("2024-07-01").cast("date")


def metrics(spark, *data):
    return spark.createDataFrame(
        [(f"u{i}", *row) for i, row in enumerate(data)],
        "user_id string, recency_days int, frequency_count bigint, monetary_value double")


@pytest.mark.parametrize("column,values,scores", [
    ("recency_score", [(d, 1, 1.0) for d in (30, 31, 60, 61, 90, 91, 180, 181)], [5, 4, 4, 3, 3, 2, 2, 1]),
    ("frequency_score", [(1, f, 1.0) for f in (1, 2, 3, 4, 6, 7, 9, 10)], [1, 2, 2, 3, 3, 4, 4, 5]),
    ("monetary_score", [(1, 1, m) for m in (99.99, 100.0, 249.99, 250.0, 499.99, 500.0, 999.99, 1000.0)],
     [1, 2, 2, 3, 3, 4, 4, 5]),
])
def test_score_cuts(spark, column, values, scores):
    out = analytics.rfm_scores(metrics(spark, *values)).orderBy("user_id")
    assert [r[column] for r in out.collect()] == scores


def test_segment_rules_in_order(spark, rows):
    cases = [((5, 10, 1000.0), "Champions"), ((80, 4, 100.0), "Loyal Customers"), ((30, 1, 50.0), "Promising"),
             ((90, 2, 500.0), "Big Spenders"), ((120, 7, 50.0), "At Risk"), ((200, 1, 50.0), "Lost"),
             ((90, 2, 100.0), "Regular")]
    out = analytics.rfm_segments(analytics.rfm_scores(metrics(spark, *[c[0] for c in cases]))).orderBy("user_id")
    assert [r.rfm_segment for r in out.collect()] == [c[1] for c in cases]
    (top,) = out.filter("rfm_segment = 'Champions'").collect()
    assert top.rfm_score == 555
    segments = analytics.customer_segments(out)
    assert rows(segments.filter("segment_name = 'Lost'"), "segment_description", "customer_count", "avg_order_value") == [
        ("Inactive customers with low recency and frequency", 1, 50.0)]
    unknown = analytics.customer_segments(out.withColumn("rfm_segment", F.lit("?")))
    assert rows(unknown, "segment_description") == [("Unknown segment",)]
    assert sum(r.pct_customers for r in serving.segment_share(segments).collect()) == pytest.approx(100, abs=0.05)


def sales(spark, *data):
    return spark.createDataFrame(
        list(data), "transaction_timestamp timestamp, product_id string, category string, quantity int, total_amount double"
    ).select("*", F.lit(2.0).alias("unit_price"), F.lit("t").alias("transaction_id"), F.lit("u").alias("user_id"))


def test_rfm_metrics_skip_nulls(spark, rows):
    df = sales(spark, (dt.datetime(2024, 6, 30, 23, 59), "p", "c", 1, 0.1), (dt.datetime(2024, 6, 1), "p", "c", 1, 0.2),
               (None, "p", "c", 1, 5.0))
    assert rows(analytics.rfm_metrics(df, day()), "user_id", "recency_days", "frequency_count", "monetary_value") == [
        ("u", 1, 2, 0.3)]


def test_product_without_views_has_no_rate(spark, rows):
    when = dt.datetime(2024, 1, 1)
    perf = analytics.product_performance(
        sales(spark, (when, "p", "c", 1, 5.0), (when, "q", "c", 2, 7.0)),
        spark.createDataFrame([("p",), ("p",), (None,)], "product_id string"))
    assert rows(perf, "product_id", "total_views", "conversion_rate") == [("p", 2, 50.0), ("q", 0, None)]
    assert rows(analytics.product_performance(sales(spark, (when, "p", "c", 1, 5.0))), "total_views",
                "conversion_rate") == [(0, None)]


def test_tier_edges_and_ties(spark, rows):
    perf = spark.createDataFrame(
        [(f"p{i:03d}", "c" if i % 2 else "d", float(1000 - i), 1) for i in range(1, 203)] + [("tie", "c", 999.0, 1)],
        "product_id string, category string, total_revenue double, total_sales bigint")
    out = {r.product_id: r for r in analytics.product_ranks(perf).collect()}
    assert out["p001"].overall_rank == out["tie"].overall_rank == 1 and out["tie"].category_rank == 1
    assert out["p001"].performance_score == 999.0 / 1000 + 0.1
    assert [out[f"p{i:03d}"].performance_tier for i in (10, 11, 50, 51, 200, 201)] == [
        "Top Seller", "High Performer", "High Performer", "Moderate", "Moderate", "Low Performer"]


@pytest.mark.parametrize("within", [(), ("g",), ("g", "h")])
def test_distributed_rank_equals_window_rank(spark, rows, within):
    """One group holds most rows; values repeat and some are NULL."""
    rng = random.Random(5)
    data = [(i, rng.choice(["hot"] * 8 + ["cold", None]), rng.randrange(2), rng.choice([None, *range(300)]))
            for i in range(6000)]
    df = spark.createDataFrame(data, "id int, g string, h int, v int").repartition(7)
    expected = df.withColumn("r", F.dense_rank().over(
        Window.partitionBy(*within).orderBy(F.col("v").desc_nulls_last())))
    assert rows(dense_rank_desc(df, "v", "r", within), "id", "r") == rows(expected, "id", "r")


def test_trends_growth(spark, rows):
    def on(y, m, d):
        return dt.datetime(y, m, d)
    df = sales(spark, (on(2023, 1, 5), "p", "c", 1, 0.0), (on(2023, 3, 5), "p", "c", 1, 10.0),
               (on(2024, 3, 5), "p", "c", 1, 15.0), (on(2024, 12, 30), "p", None, 1, 4.0), (None, "p", "c", 1, 9.0))
    trends = analytics.sales_trends(df, day())
    assert rows(trends.filter("period_type = 'monthly' and category = 'c'"), "period_value", "growth_rate") == [
        ("2023-01", None), ("2023-03", None), ("2024-03", 50.0)]
    assert rows(trends.filter("category is null"), "period_type", "period_value") == [
        ("monthly", "2024-12"), ("quarterly", "2024-Q4"), ("weekly", "2025-W01")]
    assert trends.groupBy("period_type", "period_value", "category").count().filter("count > 1").isEmpty()
    legacy = analytics.sales_trends(df, day(), legacy_periods=True).filter("period_type = 'quarterly' and category = 'c'")
    assert rows(legacy, "period_value", "total_sales", "total_revenue") == [("1", 3, 25.0)]
    assert analytics.top_trends(trends, 2).count() == 2


def test_search_hits_equal_brute_force(spark, rows):
    names = ["Red Shoe", "red shoes", "Blue", "a", "aaa", "Shoehorn", None]
    products = [(n, c) for n in names for c in ("Footwear", "A", None)] * 2
    queries = ["red", "SHOE", "shoe", "a", "aa", "aaaa", "oe", "footwear", "x", "d s", "", None, "blue", "shoehorn!"]
    found = dict(rows(catalog.search_hits(
        spark.createDataFrame([(q,) for q in queries], "search_query string"),
        spark.createDataFrame(products, "name string, category string"))))
    expected = {q: sum(q in (n or "").lower() or q in (c or "").lower() for n, c in products)
                for q in {x.lower() for x in queries if x}}
    assert found == expected


def test_filter_hits_count_shared_edges_twice(spark, rows):
    products = spark.createDataFrame([("c", 50.0), ("c", 10.0), ("d", 2500.0)], "category string, price double")
    assert rows(catalog.filter_hits(products)) == sorted([
        ("c", None, None, 2), ("d", None, None, 1), ("c", 0.0, 50.0, 2), ("c", 50.0, 100.0, 1),
        (None, 0.0, 50.0, 2), (None, 50.0, 100.0, 1)], key=repr)


def test_category_type_first_match(spark, rows):
    df = spark.createDataFrame([("Smart Watches",), ("Video Games",), ("Kids' Clothing",), ("Dolls",),
                                ("Gaming Consoles",)], "category string")
    assert dict(rows(catalog.category_types(df), "category", "category_type")) == {
        "Smart Watches": "electronics", "Video Games": "books", "Kids' Clothing": "clothing", "Dolls": "toys",
        "Gaming Consoles": "electronics"}
    assert len(CATEGORIES) == 100


def test_traffic_bands(spark, rows):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, h),) for h in range(24)], "timestamp timestamp")
    assert rows(catalog.traffic_bands(df)) == [("low", 9), ("normal", 7), ("peak", 8)]


def test_money(spark, rows):
    df = spark.createDataFrame([(0.1,), (0.2,), (None,), (12345678.91,)], "v double")
    assert rows(df.agg(money.money_sum("v"), money.money_avg("v"))) == [(12345679.21, 12345679.21 / 3)]
    assert rows(df.filter("v is null").agg(money.money_sum("v"), money.money_avg("v"))) == [(None, None)]
    counts = spark.createDataFrame([(1, 8, ), (1, 3), (5, 0)], "a bigint, b bigint")
    assert rows(counts.select(money.rounded_pct("a", "b", 1))) == [(12.5,), (33.3,), (None,)]


def test_conversion_counts_each_side_once(spark, rows):
    products = spark.createDataFrame([(1, "c", True), (2, "c", False), (3, "d", True)],
                                     "product_id_pk int, category string, is_current boolean")
    views = spark.createDataFrame([(f"v{i}", 1) for i in range(4)] + [("v9", 2)], "event_id string, product_id_pk int")
    sold = spark.createDataFrame([("t1", 1), ("t1", 1), ("t2", 2)], "transaction_id string, product_id_pk int")
    assert rows(serving.category_conversion(products, views, sold)) == [("c", 4, 2, 50.0), ("d", 0, 0, None)]


def test_latest_reads_one_date(spark, rows):
    table = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "id string, d string").select(
        "id", F.col("d").cast("date").alias("analysis_date"))
    assert rows(serving.latest(table), "id") == [("b",)]
