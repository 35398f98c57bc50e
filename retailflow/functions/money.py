"""Exact money arithmetic.

Amounts arrive as doubles with two decimals. They are summed as whole cents in a
bigint: primitive, order-independent (so retries and different partitionings give
the same bits), and an overflow raises instead of wrapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(amount: Column | str) -> Column:
    return F.rint(_col(amount) * 100.0).cast("bigint")


def from_cents(value: Column | str) -> Column:
    return _col(value).cast("double") / 100.0


def line_cents(quantity: Column | str, price: Column | str) -> Column:
    return _col(quantity).cast("bigint") * cents(price)


def money_sum(amount: Column | str) -> Column:
    return from_cents(F.sum(cents(amount)))


def money_avg(amount: Column | str) -> Column:
    value = cents(amount)
    return F.try_divide(from_cents(F.sum(value)), F.count(value).cast("double"))


def line_total(quantity: Column | str, price: Column | str) -> Column:
    """sum(quantity * price) over a group."""
    return from_cents(F.sum(line_cents(quantity, price)))


def money_text(amount: Column | str) -> Column:
    """Plain two-decimal text; doubles from 1e7 up would print in scientific form."""
    return _col(amount).cast("decimal(18,2)").cast("string")


def exact_avg(value: Column | str, scale: int = 6) -> Column:
    """Mean of already derived ratios, independent of the order rows arrive in."""
    v = _col(value).cast(f"decimal(24,{scale})")
    return F.try_divide(F.sum(v).cast("double"), F.count(v).cast("double"))


def rounded_pct(part: Column | str, whole: Column | str, digits: int) -> Column:
    """round(100 * part / whole, digits), half up, from whole numbers; NULL when whole is 0."""
    unit = 10 ** digits
    p, w = _col(part).cast("bigint"), F.nullif(_col(whole).cast("bigint"), F.lit(0).cast("bigint"))
    return F.call_function("div", p * (200 * unit) + w, w * 2).cast("double") / float(unit)
