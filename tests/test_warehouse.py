import datetime as dt

import pytest
from pyspark.sql import functions as F

from retailflow.config import GEOGRAPHY_ROWS
from retailflow.operators import dimensions, facts, serving
from retailflow.plans import warehouse
from retailflow.sources import tables
from retailflow.streaming import sinks


def ts(text):
    return F.lit(text).cast("timestamp")


def customers(spark, *data):
    return spark.createDataFrame(list(data), "user_id string, city string, spent double")


T1, T2, T3 = "2024-01-01 00:00:00", "2024-02-01 00:00:00", "2024-03-01 00:00:00"
OPEN = dt.datetime(9999, 12, 31, 23, 59, 59)


def day(month):
    return dt.datetime(2024, month, 1)


def test_scd2_over_three_runs(spark, rows):
    first = customers(spark, ("same", "x", 1.0), ("changed", "x", 1.0), ("gone", "x", 1.0), ("to_null", "x", 1.0),
                      ("from_null", None, 1.0), ("null", None, None))
    one = dimensions.scd2_merge(dimensions.first_versions(first.limit(0), ts(T1)), first, "user_id", ts(T1))
    assert rows(one) == rows(dimensions.first_versions(first, ts(T1)))

    second = customers(spark, ("same", "x", 1.0), ("changed", "y", 1.0), ("to_null", None, 1.0),
                       ("from_null", "x", 1.0), ("null", None, None), ("new", "x", 1.0))
    assert rows(dimensions.new_keys(one, second, "user_id"), "user_id") == [("new",)]
    assert rows(dimensions.changed_rows(one, second, "user_id"), "user_id") == [
        ("changed",), ("from_null",), ("to_null",)]
    two = dimensions.scd2_merge(one, second, "user_id", ts(T2))
    assert rows(two, "user_id", "city", "effective_start_date", "effective_end_date", "is_current") == sorted([
        ("same", "x", day(1), OPEN, True), ("gone", "x", day(1), OPEN, True), ("null", None, day(1), OPEN, True),
        ("new", "x", day(2), OPEN, True),
        ("changed", "x", day(1), day(2), False), ("changed", "y", day(2), OPEN, True),
        ("to_null", "x", day(1), day(2), False), ("to_null", None, day(2), OPEN, True),
        ("from_null", None, day(1), day(2), False), ("from_null", "x", day(2), OPEN, True)], key=repr)
    # the same input again changes nothing
    assert rows(dimensions.scd2_merge(two, second, "user_id", ts(T3))) == rows(two)

    three = dimensions.scd2_merge(two, customers(spark, ("changed", "z", 1.0)), "user_id", ts(T3))
    assert rows(three.filter("user_id = 'changed'"), "city", "effective_start_date", "effective_end_date") == [
        ("x", day(1), day(2)), ("y", day(2), day(3)), ("z", day(3), OPEN)]
    assert three.filter("is_current").groupBy("user_id").count().filter("count > 1").isEmpty()


def test_ignored_columns_make_no_version(spark, rows):
    one = dimensions.first_versions(customers(spark, ("a", "x", 1.0)), ts(T1))
    again = customers(spark, ("a", "x", 2.0))
    assert rows(dimensions.scd2_merge(one, again, "user_id", ts(T2), ignore=("spent",))) == rows(one)


def test_customer_segments_edges(spark, rows):
    stats = spark.createDataFrame(
        [("a", 2, 1000.0), ("b", 1, 999.99), ("c", 1, 500.0), ("d", 1, 100.0), ("e", 1, 99.99), ("f", 0, 0.0)],
        "user_id string, total_transactions bigint, total_spent double").select(
        "*", F.lit(None).cast("date").alias("first_transaction_date"),
        F.lit(None).cast("date").alias("last_transaction_date"))
    assert rows(dimensions.customer_dimension(stats), "user_id", "customer_segment", "avg_order_value", "is_active") == [
        ("a", "High Value", 500.0, True), ("b", "Medium Value", 999.99, True), ("c", "Medium Value", 500.0, True),
        ("d", "Low Value", 100.0, True), ("e", "New", 99.99, True), ("f", "New", 0.0, False)]


def test_date_dimension(spark, rows):
    dates = dimensions.date_dimension(tables.fixed_date_range(spark))
    assert dates.count() == 1096
    assert rows(dates.filter("date = date'2024-12-30'"), "date_id", "week", "day_of_week", "day_name", "month_name",
                "quarter", "is_weekend", "is_holiday") == [
        (20241230, 1, 2, "Monday", "December", 4, False, False)]
    assert rows(dates.filter("date = date'2024-06-01'"), "is_weekend", "day_of_week") == [(True, 7)]


def star(spark, when=T1):
    def dim(df, natural, surrogate):
        return warehouse.versions(df, natural, surrogate, ts(when))
    return facts.Star(
        customers=dim(customers(spark, ("u1", "x", 1.0)), "user_id", "customer_id"),
        products=dim(spark.createDataFrame([("p1", "c1")], "product_id string, category string"),
                     "product_id", "product_id_pk"),
        geography=dim(tables.geography_rows(spark, GEOGRAPHY_ROWS), "country", "geography_id"),
        dates=dimensions.date_dimension(tables.fixed_date_range(spark, "2024-01-01", "2024-01-31")))


def sale_lines(spark, *data):
    return spark.createDataFrame(
        [(f"e{i}", *row) for i, row in enumerate(data)],
        "line_item_id string, user_id string, product_id string, country string, transaction_timestamp timestamp"
    ).select("*", F.lit("t").alias("transaction_id"), F.lit(1).alias("quantity"), F.lit(2.0).alias("unit_price"),
             F.lit(2.0).alias("total_amount"), F.lit(0.0).alias("discount_amount"), F.lit("PayPal").alias("payment_method"))


def test_unknown_keys_give_null_surrogates(spark, rows):
    january, june = dt.datetime(2024, 1, 5, 10), dt.datetime(2024, 6, 5)
    out = facts.fact_sales(sale_lines(
        spark, ("u1", "p1", "UK", january), ("u9", "p9", "Spain", june), (None, None, None, None)), star(spark))
    known = {r.event_id: (r.date_id, r.customer_id is None, r.product_id_pk is None, r.geography_id is None)
             for r in out.collect()}
    assert known == {"e0": (20240105, False, False, False), "e1": (None, True, True, True),
                     "e2": (None, True, True, True)}


def test_unseen_drops_loaded_and_repeated(spark, rows):
    incoming = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "event_id string")
    existing = spark.createDataFrame([("a",), ("a",)], "event_id string")
    assert rows(facts.unseen(incoming, existing)) == [("b",), ("c",)]


def test_facts_of_old_versions_keep_their_product(spark, rows):
    old = star(spark)
    fact = facts.fact_sales(sale_lines(spark, ("u1", "p1", "UK", dt.datetime(2024, 1, 5))), old)
    moved = dimensions.scd2_merge(
        old.products, spark.createDataFrame([("p1", "c2")], "product_id string, category string"),
        "product_id", ts(T2)).withColumn("product_id_pk", dimensions.surrogate("product_id"))
    assert moved.count() == 2 and dimensions.colliding_keys(moved, "product_id_pk").isEmpty()
    later = facts.Star(old.customers, moved, old.geography, old.dates)
    assert rows(warehouse.sold_products(fact, later), "product_id", "category") == [("p1", "c2")]


def test_versioned_dimension_table(spark, tmp_path, rows):
    path = str(tmp_path / "dim")
    warehouse.update_dimension(spark, path, customers(spark, ("a", "x", 1.0)), "user_id", "customer_id", ts(T1))
    warehouse.update_dimension(spark, path, customers(spark, ("a", "y", 1.0)), "user_id", "customer_id", ts(T2))
    (tmp_path / "dim" / "version=3").mkdir()   # a write that never committed
    assert sinks.newest_version(spark, path) == 2
    assert rows(sinks.read_version(spark, path), "city", "is_current") == [("x", False), ("y", True)]
    scan = sinks.read_version(spark, path).filter("is_current")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(is_current" in scan or "PartitionFilters: [cast(is_current" in scan


def test_run_batch_twice(spark, tmp_path, rows):
    root = str(tmp_path)
    sales = sale_lines(spark, ("u1", "p1", "UK", dt.datetime(2024, 1, 5)), ("u2", "p1", "UK", dt.datetime(2024, 1, 6)))
    views = spark.createDataFrame([("v1", "u1", "p1", dt.datetime(2024, 1, 5))],
                                  "event_id string, user_id string, product_id string, event_timestamp timestamp").select(
        "*", F.lit("UK").alias("country"), F.lit("s").alias("session_id"), F.lit("view").alias("event_type"),
        F.lit(5).alias("view_duration"), F.lit(None).cast("string").alias("search_query"))
    carts = views.select("event_id", "user_id", "product_id", "event_timestamp", "country", "session_id",
                         F.lit("checkout").alias("event_type"), F.lit(1).alias("quantity"), F.lit(2.0).alias("cart_value"))
    catalog = spark.createDataFrame([("p1", "shoe", "c1", 2.0)], "product_id string, name string, category string, price double")
    written = []
    for run, analysis in ((T2, "2024-02-01"), (T3, "2024-03-01"), (T3, "2024-03-01")):
        written.append(warehouse.run_batch(
            spark, root, sales, views, carts, catalog, tables.geography_rows(spark, GEOGRAPHY_ROWS),
            ts(run), F.lit(analysis).cast("date")))
    assert written[0] == {"fact_sales": 2, "fact_product_views": 1, "fact_cart_events": 1, "rfm_analysis": 2,
                          "product_performance": 1, "sales_trends": 3, "customer_segments": 1}
    assert [w["fact_sales"] for w in written] == [2, 0, 0] and written[2]["rfm_analysis"] == 2

    def read(name):
        return spark.read.parquet(f"{root}/{name}")
    assert [read(n).count() for n in ("fact_sales", "fact_product_views", "fact_cart_events")] == [2, 1, 1]
    assert rows(read("rfm_analysis"), "user_id", "analysis_date", "recency_days") == [
        ("u1", dt.date(2024, 2, 1), 27), ("u1", dt.date(2024, 3, 1), 56),
        ("u2", dt.date(2024, 2, 1), 26), ("u2", dt.date(2024, 3, 1), 55)]
    assert rows(read("product_performance").filter("analysis_date = '2024-03-01'"), "product_id", "total_sales",
                "total_views", "conversion_rate", "overall_rank", "performance_tier") == [
        ("p1", 2, 1, 200.0, 1, "Top Seller")]
    assert rows(read("sales_trends").filter("analysis_date = '2024-03-01'"), "period_type", "period_value") == [
        ("monthly", "2024-01"), ("quarterly", "2024-Q1"), ("weekly", "2024-W01")]
    assert read("customer_segments").count() == 1
    assert sinks.read_version(spark, f"{root}/dim_customers").count() == 2


def test_batch_runs_in_different_months(spark, tmp_path, rows):
    root = str(tmp_path)
    sales = sale_lines(spark, ("u1", "p1", "UK", dt.datetime(2023, 12, 31, 23)), ("u2", "p1", "UK", dt.datetime(2024, 1, 5)),
                       ("u1", "p1", "UK", dt.datetime(2025, 2, 3)))
    views = spark.createDataFrame([], "event_id string, user_id string, product_id string, event_timestamp timestamp, country string, "
                                  "session_id string, event_type string, view_duration int, search_query string")
    carts = spark.createDataFrame([], "event_id string, user_id string, product_id string, event_timestamp timestamp, country string, "
                                  "session_id string, event_type string, quantity int, cart_value double")
    catalog = spark.createDataFrame([("p1", "shoe", "c1", 2.0)], "product_id string, name string, category string, price double")

    def run(day, **options):
        return warehouse.run_batch(spark, root, sales, views, carts, catalog, tables.geography_rows(spark, GEOGRAPHY_ROWS),
                                   ts(f"{day} 00:00:00"), F.lit(day).cast("date"), **options)["fact_sales"]

    assert run("2024-01-06", today="2024-01-06", days=7) == 3  # from the look-back on, as the batch slice is open upwards
    assert run("2025-02-03", batch_date="2025-02-03") == 0
    fact, dates = spark.read.parquet(f"{root}/fact_sales"), spark.read.parquet(f"{root}/dim_date")
    assert fact.filter("date_id is null").isEmpty()
    assert dates.count() == dates.select("date_id").distinct().count() == 365 + 366 + 365
    assert rows(serving.daily_trend(fact, dates), "date", "num_orders") == [
        (dt.date(2023, 12, 31), 1), (dt.date(2024, 1, 5), 1), (dt.date(2025, 2, 3), 1)]
    scan = facts.of_dates(fact, [20240105])._jdf.queryExecution().executedPlan().toString()
    assert "date_id" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_failing_dimension_version_is_not_published(spark, tmp_path, rows):
    path = str(tmp_path / "dim")
    warehouse.update_dimension(spark, path, customers(spark, ("a", "x", 1.0)), "user_id", "customer_id", ts(T1))
    with pytest.raises(ValueError, match="repeats"):
        warehouse.update_dimension(spark, path, customers(spark, ("a", "y", 1.0), ("a", "z", 1.0)), "user_id", "customer_id", ts(T2))
    assert sinks.newest_version(spark, path) == 1 and rows(sinks.read_version(spark, path), "city") == [("x",)]


def test_missing_catalog_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.product_catalog(spark, str(tmp_path / "none.json")).count()


def test_catalog_file_is_a_json_array(spark, tmp_path, rows):
    path = tmp_path / "products.json"
    path.write_text('[{"product_id": "p1",\n "price": 2.5}, {"product_id": "p2", "inventory": 3}]')
    assert rows(tables.product_catalog(spark, str(path)), "product_id", "price", "inventory") == [
        ("p1", 2.5, None), ("p2", None, 3)]
