"""Fact tables: dimension lookups and deduplicated incremental loads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailflow.operators.dimensions import current


@dataclass(frozen=True)
class Star:
    """The four dimensions facts look up: surrogate-keyed versions and the calendar."""
    customers: DataFrame    # customer_id, user_id, ...
    products: DataFrame     # product_id_pk, product_id, ...
    geography: DataFrame    # geography_id, country, ...
    dates: DataFrame        # date_id, date, ...


def lookup(facts: DataFrame, dim: DataFrame, natural: str, surrogate: str, others: tuple[str, ...] = ()) -> DataFrame:
    """Left lookup of a surrogate by natural key; an unknown key gives NULL.

    Facts without a key match nothing; a second key spreads them, as they all would meet in one task. The facts are read once.
    """
    none = F.col(natural).isNull()
    spread = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in facts.columns)), F.lit(1024)) + 1
    keyed = facts.withColumn("_spread", F.when(none, spread).otherwise(F.lit(0)))
    members = dim.select(natural, surrogate, *others, F.when(none, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("_spread"))
    return keyed.join(members, [natural, "_spread"], "left").drop("_spread")


def stands_for(dim: DataFrame, natural: str, surrogate: str, alias: str) -> DataFrame:
    """Current versions of a dimension with the natural key that their surrogate stands for among all versions.

    The join of facts with a dimension by surrogate, made on the dimension: facts then need one lookup for both.
    """
    named = dim.select(F.col(surrogate).alias("_surrogate"), F.col(natural).alias(alias))
    return current(dim).join(named, F.col(surrogate) == F.col("_surrogate"), "left").drop("_surrogate")


#: Names of the natural keys that :func:`with_keys` adds for the surrogates on request.
STANDS_FOR = ("customer_of", "product_of", "country_of")


def _members(dim: DataFrame, natural: str, surrogate: str, other: str | None) -> DataFrame:
    return (stands_for(dim, natural, surrogate, other) if other else current(dim)).select(natural, surrogate, *filter(None, [other]))


def with_product(events: DataFrame, star: Star, resolve: bool = False) -> DataFrame:
    """Attach ``product_id_pk``. Products are left out often (all checkouts, most view events), so such events are spread."""
    others = STANDS_FOR[1:2] if resolve else ()
    return lookup(events, _members(star.products, "product_id", "product_id_pk", *others or [None]),
                  "product_id", "product_id_pk", others)


def with_customer(events: DataFrame, star: Star, resolve: bool = False) -> DataFrame:
    return events.join(_members(star.customers, "user_id", "customer_id", STANDS_FOR[0] if resolve else None), "user_id", "left")


def with_country(events: DataFrame, star: Star, resolve: bool = False) -> DataFrame:
    """Attach ``geography_id``. Countries are few by nature and so broadcast always: dealt by country, all facts would meet in
    as many tasks as there are countries."""
    members = _members(star.geography, "country", "geography_id", STANDS_FOR[2] if resolve else None)
    return events.join(F.broadcast(members), "country", "left")


def with_date(events: DataFrame, star: Star, ts: str) -> DataFrame:
    """Attach ``date_id``; days are few and broadcast as countries are."""
    return events.withColumn("date", F.col(ts).cast("date")).join(F.broadcast(star.dates.select("date", "date_id")), "date", "left")


def with_keys(events: DataFrame, star: Star, ts: str, resolve: bool = False) -> DataFrame:
    """Attach the four surrogates. Catalyst broadcasts the sides it measures as small.

    With ``resolve``, the natural keys that the surrogates stand for come along as ``STANDS_FOR``.
    """
    keyed = with_country(with_customer(with_product(events, star, resolve), star, resolve), star, resolve)
    return with_date(keyed, star, ts)


def fact_sales(lines: DataFrame, star: Star) -> DataFrame:
    return sale_facts(with_keys(lines, star, "transaction_timestamp"))


def sale_facts(keyed: DataFrame, *others: str) -> DataFrame:
    """The fact columns of sale lines that have their surrogates, and ``others``."""
    return keyed.select(
        F.col("line_item_id").alias("event_id"), "transaction_id",
        "date_id", "customer_id", "product_id_pk", "geography_id",
        "transaction_timestamp", "quantity", "unit_price", "total_amount", "discount_amount", "payment_method", *others)


def fact_product_views(views: DataFrame, star: Star) -> DataFrame:
    return with_keys(views, star, "event_timestamp").select(
        "event_id", "date_id", "customer_id", "product_id_pk", "geography_id",
        "session_id", "event_type", "event_timestamp", "view_duration", "search_query")


def fact_cart_events(carts: DataFrame, star: Star) -> DataFrame:
    return with_keys(carts, star, "event_timestamp").select(
        "event_id", "date_id", "customer_id", "product_id_pk", "geography_id",
        "session_id", "event_type", "event_timestamp", "quantity", "cart_value")


def unseen(incoming: DataFrame, existing: DataFrame, key: str = "event_id") -> DataFrame:
    """Incoming facts whose id is neither loaded yet nor repeated within the batch."""
    return incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def of_dates(existing: DataFrame, dates: list[int | None]) -> DataFrame:
    """Stored facts of some ``date_id`` values; on a table partitioned by it only those are read."""
    known = [d for d in dates if d is not None]
    return existing.filter(F.col("date_id").isin(known) | F.col("date_id").isNull())


def natural_keys(facts: DataFrame, dim: DataFrame, surrogate: str, natural: str) -> DataFrame:
    """Natural key of each fact over all versions.

    Facts keep the surrogate that was current when they were loaded; history must not
    split or vanish when a key gets a new version.
    """
    return facts.join(dim.select(surrogate, natural), surrogate)
