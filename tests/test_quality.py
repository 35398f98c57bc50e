import copy
import json
import uuid

import pytest
from pyspark.errors import PySparkException

from retailflow.operators import quality

TX = {"transaction_id": str(uuid.UUID(int=1)), "user_id": "USER_1", "timestamp": "2024-01-01T00:00:00",
      "products": [{"product_id": "PROD_1", "quantity": 2, "price": 1.5}], "total_amount": 3.0,
      "payment_method": "PayPal", "country": "UK"}
HEAD = {"event_id": str(uuid.UUID(int=1)), "timestamp": "2024-01-01T00:00:00", "user_id": "USER_1",
        "session_id": str(uuid.UUID(int=2)), "country": "UK"}


def errors(spark, rules, *events):
    df = spark.createDataFrame([(e if isinstance(e, str) else json.dumps(e),) for e in events], "value string")
    return [r.errors for r in quality.validate(df, rules).collect()]


def changed(event, **fields):
    event = copy.deepcopy(event)
    for name, value in fields.items():
        if value is KeyError:
            del event[name]
        else:
            event[name] = value
    return event


def test_transaction_rules(spark):
    item = TX["products"][0]
    cases = [
        (TX, []),
        (changed(TX, total_amount=3.01), []),
        (changed(TX, total_amount=3.02), ["rule:total_mismatch"]),
        (changed(TX, country=KeyError), ["required:country"]),
        (changed(TX, country=None), ["type:country", "enum:country"]),
        (changed(TX, country="Spain"), ["enum:country"]),
        (changed(TX, user_id=5), ["type:user_id"]),
        (changed(TX, user_id="user_1"), ["pattern:user_id"]),
        (changed(TX, timestamp="soon"), ["format:timestamp"]),
        (changed(TX, timestamp="2024-01-01T00:00:00.123456Z"), []),
        (changed(TX, total_amount="3.0"), ["type:total_amount"]),
        (changed(TX, total_amount=60000.0), ["maximum:total_amount", "rule:total_mismatch"]),
        (changed(TX, products=[]), ["min_items:products"]),
        (changed(TX, products=[item] * 6, total_amount=18.0), ["max_items:products"]),
        (changed(TX, products=["x", item]), ["type:products[]"]),
        (changed(TX, products="x"), ["type:products"]),
        (changed(TX, products=[changed(item, quantity=0)], total_amount=0), ["item:products[].quantity"]),
        (changed(TX, products=[changed(item, quantity=2.5)], total_amount=3.75), ["item:products[].quantity"]),
        (changed(TX, products=[changed(item, price=KeyError)], total_amount=0), ["item:products[].price"]),
        (changed(TX, products=[changed(item, product_id="P")]), ["item:products[].product_id"]),
        (changed(TX, user_id="x", country="y"), ["pattern:user_id", "enum:country"]),
        ('{"a":', ["malformed"]), ("[1]", ["malformed"]), ("", ["malformed"]),
    ]
    found = errors(spark, quality.transaction_rules(), *[c[0] for c in cases])
    assert found == [c[1] for c in cases]


def test_cart_rules(spark):
    checkout = {**HEAD, "event_type": "checkout", "items": [{"quantity": 2, "price": 1.5}], "total_items": 2,
                "total_value": 3.0}
    update = {**HEAD, "event_type": "update_quantity", "old_quantity": 1, "new_quantity": 2}
    cases = [
        (checkout, []),
        (changed(checkout, items=[]), ["rule:checkout_without_items"]),
        (changed(checkout, items=KeyError), ["rule:checkout_without_items"]),
        (changed(checkout, total_items=0), ["rule:checkout_without_items"]),
        (changed(checkout, total_value=4.0), ["rule:checkout_total_mismatch"]),
        (update, []),
        (changed(update, new_quantity=1), ["rule:quantity_unchanged"]),
        (changed(update, old_quantity=-1), ["minimum:old_quantity"]),
        (changed(update, product_name=""), ["min_length:product_name"]),
        (changed(update, category="Smartphones"), []),
        (changed(update, category="Cars"), ["enum:category"]),
        (changed(update, event_type="wish"), ["enum:event_type"]),
    ]
    assert errors(spark, quality.cart_rules(), *[c[0] for c in cases]) == [c[1] for c in cases]


def test_view_rules(spark):
    search = {**HEAD, "event_type": "search", "search_query": "x"}
    compare = {**HEAD, "event_type": "compare", "product_ids": ["PROD_1", "PROD_2"]}
    cases = [
        (search, []),
        (changed(search, search_query=""), ["rule:search_without_query"]),
        (changed(search, search_query=None), ["rule:search_without_query"]),
        (changed(search, category=None), []),
        (changed(search, from_search="yes"), ["type:from_search"]),
        (compare, []),
        (changed(compare, product_ids=["PROD_1"]), ["rule:compare_too_few"]),
        (changed(compare, product_ids=KeyError), ["rule:compare_too_few"]),
        (changed(compare, product_ids=["PROD_1", "x"]), ["pattern:product_ids[]"]),
        (changed(compare, product_ids=["PROD_1", 2]), ["type:product_ids[]"]),
        (changed(compare, prices=[1, -1]), ["minimum:prices[]"]),
        (changed(search, min_price=5, max_price=4), ["rule:price_range_inverted"]),
        (changed(search, min_price=5, max_price=5), []),
        (changed(search, view_duration=3601), ["maximum:view_duration"]),
    ]
    assert errors(spark, quality.view_rules(), *[c[0] for c in cases]) == [c[1] for c in cases]


def test_split_stats_and_strict(spark, rows):
    df = spark.createDataFrame([("t", json.dumps(TX)), ("t", json.dumps(changed(TX, user_id="x"))), ("t", "{")],
                               "kind string, value string")
    checked = quality.validate(df, quality.transaction_rules())
    assert quality.valid(checked).count() == 1 and quality.quarantine(checked).count() == 2
    assert rows(quality.first_errors(checked, "kind"), "error", "events") == [
        ("malformed", 1), ("pattern:user_id", 1), (None, 1)]
    (stats,) = quality.pass_rates(checked, "kind").collect()
    assert (stats.total_validated, stats.total_passed, stats.total_failed) == (3, 1, 2)
    assert quality.require_valid(quality.validate(df.limit(1), quality.transaction_rules())).count() == 1
    with pytest.raises(PySparkException, match="failed validation"):
        quality.require_valid(checked).collect()
