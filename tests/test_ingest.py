import datetime as dt
import json

from pyspark.sql import functions as F

from retailflow import schemas
from retailflow.operators import ingest


def messages(spark, *bodies):
    return spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b),) for b in bodies], "value string")


def test_decode_keeps_bad_json_apart(spark, rows):
    decoded = ingest.decode(messages(
        spark,
        {"event_id": "a", "timestamp": "2024-01-01T00:00:01.123456"},
        {"event_id": "b", "timestamp": "2024-01-01T00:00:01Z", "user_id": None},
        {"event_id": "c", "timestamp": "soon"},
        '{"event_id": "d"'), schemas.CART_EVENT)
    good = ingest.readable(decoded)
    assert rows(good, "event_id", "timestamp") == [
        ("a", dt.datetime(2024, 1, 1, 0, 0, 1, 123456)), ("b", dt.datetime(2024, 1, 1, 0, 0, 1)), ("c", None)]
    assert rows(ingest.corrupt(decoded)) == [('{"event_id": "d"',)]


def test_decode_keeps_events_with_a_mistyped_field(spark, rows):
    decoded = ingest.decode(messages(
        spark, {"transaction_id": "a", "total_amount": "12.5", "country": "UK"},
        {"transaction_id": "b", "products": [{"product_id": "p", "quantity": 1.5, "price": 2.0}]},
        "nonsense", {"transaction_id": "c", "total_amount": 1.0}), schemas.TRANSACTION)
    assert rows(ingest.readable(decoded), "transaction_id", "total_amount", "country") == [
        ("a", None, "UK"), ("b", None, None), ("c", 1.0, None)]
    assert rows(ingest.corrupt(decoded)) == [("nonsense",)]


def test_decode_reads_boolean_into_text_field(spark, rows):
    decoded = ingest.decode(messages(spark, {"event_id": "a", "from_search": True}), schemas.PRODUCT_VIEW)
    assert rows(decoded, "from_search") == [("true",)]


def test_decode_accepts_binary_values(spark, rows):
    binary = messages(spark, {"transaction_id": "t"}).withColumn("value", F.col("value").cast("binary"))
    assert rows(ingest.decode(binary, schemas.TRANSACTION), "transaction_id") == [("t",)]


def test_reconcile_folds_both_spellings(spark, rows):
    views = ingest.reconcile_views(ingest.decode(messages(
        spark, {"event_id": "a", "event_type": "compare", "product_ids": ["p", "q"]},
        {"event_id": "b", "event_type": "filter", "results_count": 4}), schemas.PRODUCT_VIEW))
    assert rows(views, "event_id", "compared_product_ids", "filtered_results_count") == [
        ("a", ["p", "q"], None), ("b", None, 4)]
    carts = ingest.reconcile_carts(ingest.decode(messages(
        spark, {"event_id": "a", "total_value": 9.0}, {"event_id": "b", "new_quantity": 3}), schemas.CART_EVENT))
    assert rows(carts, "event_id", "cart_value", "quantity") == [("a", 9.0, None), ("b", None, 3)]


def test_line_items_drop_empty_and_repeat_ids(spark, rows):
    product = {"product_id": "p", "quantity": 2, "price": 1.1}
    tx = ingest.decode(messages(
        spark, {"transaction_id": "t1", "products": [product, product]},
        {"transaction_id": "t2", "products": []}, {"transaction_id": "t3"}), schemas.TRANSACTION)
    items = ingest.line_items(tx)
    found = rows(items, "transaction_id", "total_amount", "line_item_id")
    assert [r[:2] for r in found] == [("t1", 2.2), ("t1", 2.2)]
    assert len({r[2] for r in found}) == 2
    assert rows(ingest.line_items(tx), "line_item_id") == rows(items, "line_item_id")
    assert ingest.explode_products(tx).count() == 2


def test_batch_slice_is_half_open(spark, rows):
    events = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 23:59:59.999"),
                                    ("c", "2024-01-02 00:00:00"), ("d", "2023-12-26 00:00:00")], "id string, t string")
    events = events.withColumn("t", F.col("t").cast("timestamp"))
    assert rows(ingest.batch_slice(events, "t", "2024-01-01"), "id") == [("a",), ("b",)]
    assert rows(ingest.batch_slice(events, "t", today="2024-01-02"), "id") == [("a",), ("b",), ("c",), ("d",)]
    assert rows(ingest.batch_slice(events, "t", today="2024-01-03"), "id") == [("a",), ("b",), ("c",)]


def test_time_range_includes_both_ends(spark, rows):
    table = spark.createDataFrame([(1,), (2,), (3,)], "d int").select(
        F.make_timestamp(F.lit(2024), F.lit(1), "d", F.lit(0), F.lit(0), F.lit(0)).alias("window_end"))
    assert ingest.time_range(table, "window_end", "2024-01-01", "2024-01-02").count() == 2


def test_duplicates(spark, rows):
    events = spark.createDataFrame([("a",), ("a",), ("b",)], "event_id string")
    assert rows(ingest.duplicates(events)) == [("a", 2)]
