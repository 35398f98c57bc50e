"""Declared event and table schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType, BinaryType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampType)

CORRUPT = "_corrupt_record"

_STRING, _INT, _LONG, _DOUBLE = StringType(), IntegerType(), LongType(), DoubleType()


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


PRODUCT_LINE = _struct(product_id=_STRING, quantity=_INT, price=_DOUBLE)

TRANSACTION = _struct(
    transaction_id=_STRING, user_id=_STRING, timestamp=_STRING, products=ArrayType(PRODUCT_LINE),
    total_amount=_DOUBLE, payment_method=_STRING, country=_STRING)

PRODUCT_VIEW = _struct(
    event_id=_STRING, event_type=_STRING, timestamp=_STRING, user_id=_STRING, session_id=_STRING,
    product_id=_STRING, product_name=_STRING, category=_STRING, price=_DOUBLE,
    view_duration=_INT, from_search=_STRING, previously_viewed_count=_INT,
    search_query=_STRING, results_count=_INT,
    filter_category=_STRING, min_price=_DOUBLE, max_price=_DOUBLE, filtered_results_count=_INT,
    product_ids=ArrayType(_STRING), compared_product_ids=ArrayType(_STRING), comparison_count=_INT,
    country=_STRING)

CART_EVENT = _struct(
    event_id=_STRING, event_type=_STRING, timestamp=_STRING, user_id=_STRING, session_id=_STRING,
    product_id=_STRING, product_name=_STRING, category=_STRING, price=_DOUBLE,
    quantity=_INT, old_quantity=_INT, new_quantity=_INT, cart_size=_INT, cart_value=_DOUBLE,
    total_items=_INT, total_value=_DOUBLE, country=_STRING)

PRODUCT_CATALOG = _struct(
    product_id=_STRING, name=_STRING, category=_STRING, price=_DOUBLE, inventory=_INT, ratings=_DOUBLE)

GEOGRAPHY = _struct(country=_STRING, region=_STRING, continent=_STRING, currency=_STRING, timezone=_STRING)

KAFKA = _struct(
    key=BinaryType(), value=BinaryType(), topic=_STRING, partition=_INT, offset=_LONG,
    timestamp=TimestampType(), timestampType=_INT)

TEXT = _struct(value=_STRING)

TOPICS = {"transactions": TRANSACTION, "product_views": PRODUCT_VIEW, "cart_events": CART_EVENT}
