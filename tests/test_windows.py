import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from retailflow.config import Realtime, Windowing
from retailflow.operators import anomalies, ingest, windows


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 12, minute, second)


def transactions(spark, *data):
    return spark.createDataFrame(
        [(f"t{i}", *row) for i, row in enumerate(data)],
        "transaction_id string, user_id string, timestamp timestamp, total_amount double, country string"
    ).withColumn("payment_method", F.lit("PayPal"))


def carts(spark, *data):
    return spark.createDataFrame(list(data), "event_type string, timestamp timestamp, cart_value double").select(
        "*", F.lit("u").alias("user_id"), F.lit("s").alias("session_id"), F.lit("UK").alias("country"))


def lines(spark, *quantities):
    return spark.createDataFrame([(q, at(0)) for q in quantities], "quantity int, timestamp timestamp").select(
        "*", F.lit("t").alias("transaction_id"), F.lit("u").alias("user_id"), F.lit("UK").alias("country"),
        F.lit(10.0).alias("total_amount"), F.lit("PayPal").alias("payment_method"),
        F.concat(F.lit("p"), F.col("quantity").cast("string")).alias("product_id"), F.lit(0.1).alias("unit_price"))


def test_window_start_belongs_and_end_does_not(spark, rows):
    out = windows.sales_per_window(transactions(
        spark, ("u", at(0), 0.1, "UK"), ("u", at(0, 59), 0.2, "UK"), ("u", at(1), 5.0, "UK"), ("u", at(1), None, "UK")))
    assert rows(out, "window_start", "total_transactions", "total_revenue", "avg_order_value") == [
        (at(0), 2, 0.3, 0.15), (at(1), 2, 5.0, 5.0)]


def test_cart_sessions_counts(spark, rows):
    out = windows.cart_sessions(carts(
        spark, ("add_to_cart", at(0), 5.0), ("remove_from_cart", at(1), 2.0), ("update_quantity", at(2), 9.0),
        ("checkout", at(3), None), ("add_to_cart", at(6), 1.0)))
    assert rows(out, "window_start", "add_count", "remove_count", "update_count", "checkout_count", "max_cart_value",
                "last_activity", "total_events", "session_completed") == [
        (at(0), 1, 1, 1, 1, 9.0, at(3), 4, True), (at(5), 1, 0, 0, 0, 1.0, at(6), 1, False)]


def test_abandonment_needs_adds_and_no_checkout(spark, rows):
    only_add = windows.abandoned_carts(carts(spark, ("add_to_cart", at(25), 5.0)))
    assert rows(only_add, "window_start") == [(at(0),), (at(10),), (at(20),)]
    assert "checkouts" not in only_add.columns
    # the checkout at 32 is outside the window that starts at 0
    bought = windows.abandoned_carts(carts(spark, ("add_to_cart", at(25), 5.0), ("checkout", at(32), 5.0)))
    assert rows(bought, "window_start") == [(at(0),)]
    assert windows.abandoned_carts(carts(spark, ("remove_from_cart", at(25), 5.0))).isEmpty()


def test_abandonment_rate_edges(spark, rows):
    none = windows.cart_metrics(carts(spark, ("checkout", at(0), 1.0)))
    more = windows.cart_metrics(carts(spark, ("add_to_cart", at(0), 1.0), ("checkout", at(0), 1.0),
                                      ("checkout", at(0), 1.0)))
    assert rows(none, "abandonment_rate_pct") == [(0.0,)]
    assert rows(more, "abandonment_rate_pct") == [(-100.0,)]


@pytest.mark.parametrize("amount,severity", [
    (2999.99, None), (3000, "medium"), (6499.99, "medium"), (6500, "high"), (9999.99, "high"), (10000, "critical")])
def test_value_severity(spark, rows, amount, severity):
    found = rows(anomalies.high_value_anomalies(transactions(spark, ("u", at(0), float(amount), "UK"))), "severity")
    assert found == ([(severity,)] if severity else [])


def test_quantity_severity(spark, rows):
    out = anomalies.high_quantity_anomalies(lines(spark, 49, 50, 74, 75, 99, 100))
    assert rows(out, "quantity", "severity") == sorted(
        [(50, "medium"), (74, "medium"), (75, "high"), (99, "high"), (100, "critical")], key=repr)
    assert "Product quantity 50 exceeds threshold 50" in {r.anomaly_reason for r in out.collect()}


def test_reason_text_has_no_exponent(spark, rows):
    out = anomalies.high_value_anomalies(transactions(spark, ("u", at(0), 12345678.5, "UK")))
    assert rows(out, "anomaly_reason") == [("Transaction amount $12345678.50 exceeds threshold $3000",)]


def test_suspicious_pattern_needs_two_in_one_window(spark, rows):
    out = anomalies.suspicious_patterns(transactions(
        spark, ("a", at(0), 999.99, "UK"), ("a", at(0), 1000.0, "UK"), ("b", at(0), 1000.0, "UK"),
        ("b", at(0, 30), 1500.0, "UK"), ("c", at(0, 59), 1000.0, "UK"), ("c", at(1), 1000.0, "UK")))
    assert rows(out, "user_id", "transaction_count", "total_spent", "anomaly_reason", "severity") == [
        ("b", 2, 2500.0, "2 high-value transactions totaling $2500.00 in 1 minute", "high")]


def test_stats_of_nested_equal_union(spark, rows):
    product = F.array(F.struct(F.lit("p").alias("product_id"), F.lit(80).alias("quantity"), F.lit(1.0).alias("price")),
                      F.struct(F.lit("q").alias("product_id"), F.lit(1).alias("quantity"), F.lit(1.0).alias("price")))
    tx = transactions(spark, ("u", at(0), 20000.0, "UK"), ("u", at(0), 1.0, "UK")).withColumn("products", product)
    from retailflow.operators.ingest import explode_products
    union = anomalies.all_anomalies(anomalies.high_value_anomalies(tx),
                                    anomalies.high_quantity_anomalies(explode_products(tx)))
    nested = anomalies.anomalies_in_place(tx)
    assert rows(nested) == rows(union)
    assert rows(anomalies.anomaly_stats(nested), "total_anomalies", "high_value_count", "high_quantity_count",
                "critical_count", "high_severity_count", "medium_severity_count") == [(3, 1, 2, 1, 2, 0)]
    no_products = tx.withColumn("products", F.lit(None).cast(tx.schema["products"].dataType))
    assert rows(anomalies.anomalies_in_place(no_products), "anomaly_type") == [("high_value",)]


def test_alerts_of_lines_have_ids_of_their_own(spark):
    line = Row(product_id="p", quantity=200, price=5.0)
    tx = spark.createDataFrame(
        [("t1", "u", dt.datetime(2024, 1, 1), [line, line, Row(product_id="p", quantity=200, price=7.0)], 9.0, "card", "UK")],
        "transaction_id string, user_id string, timestamp timestamp, products array<struct<product_id:string,quantity:int,price:double>>, "
        "total_amount double, payment_method string, country string")
    alerts = anomalies.critical_alerts(anomalies.high_quantity_anomalies(ingest.explode_products(tx)))
    assert alerts.count() == alerts.select("alert_id").distinct().count() == 3


def test_alert_ids_repeat_on_replay(spark, rows):
    tx = transactions(spark, ("u", at(0), 20000.0, "UK"), ("u", at(0), 5000.0, "UK"))
    alerts = anomalies.critical_alerts(anomalies.high_value_anomalies(tx))
    assert alerts.count() == 1
    assert rows(anomalies.alert_messages(alerts)) == rows(
        anomalies.alert_messages(anomalies.critical_alerts(anomalies.high_value_anomalies(tx))))


def test_demand_levels(spark, rows):
    out = windows.high_demand_alerts(lines(spark, 19, 20, 29, 30, 49, 50))
    assert rows(out, "units_sold", "demand_level") == sorted(
        [(20, "medium"), (29, "medium"), (30, "high"), (49, "high"), (50, "critical")], key=repr)


def test_restock_rate_follows_window(spark, rows):
    out = windows.restock_alerts(lines(spark, 4, 5, 9, 10, 14, 15))
    assert rows(out, "units_sold", "sales_rate_per_min", "urgency") == sorted(
        [(5, 1.0, "low"), (9, 1.8, "low"), (10, 2.0, "medium"), (14, 2.8, "medium"), (15, 3.0, "high")], key=repr)
    wide = windows.restock_alerts(lines(spark, 10), Realtime(restock=Windowing("10 minutes")))
    assert rows(wide, "sales_rate_per_min", "urgency") == [(1.0, "low")]


def test_inventory_metrics(spark, rows):
    out = windows.inventory_metrics(lines(spark, 9, 10, 11))
    assert rows(out, "total_units_sold", "unique_products_sold", "total_revenue", "fast_moving_products") == [
        (30, 3, 3.0, 2)]


def views(spark, *data):
    return spark.createDataFrame(
        list(data), "event_type string, timestamp timestamp, user_id string, product_id string, view_duration int, "
        "search_query string, results_count int").select(
        "*", F.lit("s").alias("session_id"), F.lit("UK").alias("country"), F.lit("n").alias("product_name"),
        F.lit("c").alias("category"), F.lit(2.5).alias("price"))


def test_view_operators(spark, rows):
    seen = [("view", at(0), f"u{i % 2}", "p", 10, None, None) for i in range(5)]
    few = [("view", at(0), "u", "q", 10, None, None)] * 4
    asked = [("search", at(1), f"u{i}", None, None, "shoes", i) for i in range(3)] + [
        ("search", at(1), "u", None, None, "hats", 1)] * 2
    events = views(spark, *seen, *few, *asked)
    assert rows(windows.trending_products(events), "product_id", "view_count", "unique_viewers", "avg_view_duration",
                "product_price") == [("p", 5, 2, 10.0, 2.5)]
    assert rows(windows.search_behavior(events), "search_query", "search_count", "unique_searchers", "avg_results") == [
        ("shoes", 3, 3, 1.0)]
    assert rows(windows.category_performance(events, exact=True), "total_views", "unique_users", "unique_products",
                "avg_product_price") == [(9, 3, 2, 2.5)]


def test_browsing_session_duration(spark, rows):
    out = windows.browsing_sessions(views(
        spark, ("view", at(0), "u", "p", 5, None, None), ("filter", at(9, 59), "u", None, None, None, 1)))
    assert rows(out, "views", "searches", "filters", "compares", "unique_products_viewed", "session_duration_sec") == [
        (1, 0, 1, 0, 1, 599)]
