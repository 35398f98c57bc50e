"""Decode messages and project them to the raw event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

from retailflow.functions.eventtime import in_range, parse_iso
from retailflow.functions.labels import content_id
from retailflow.functions.money import from_cents, line_cents
from retailflow.schemas import CORRUPT


def decode(messages: DataFrame, schema: StructType, value: str = "value") -> DataFrame:
    """JSON message bytes or text to typed columns.

    A field of the wrong type is NULL, the other fields of the message stay. Text from which no
    field can be read keeps its form in ``_corrupt_record``, which is NULL otherwise;
    ``timestamp`` becomes event time (NULL if unparsable).
    """
    full = StructType([*schema.fields, StructField(CORRUPT, StringType())])
    parsed = F.from_json(F.col(value).cast("string"), full,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    known = F.coalesce(*[F.col(f.name).cast("string") for f in schema.fields])
    # A generator's columns keep filters above it; pushed below a plain field, each would parse the message again.
    return (messages.select(F.inline(F.array(parsed)))
            .withColumn(CORRUPT, F.when(known.isNull(), F.col(CORRUPT)))
            .withColumn("timestamp", parse_iso("timestamp")))


def readable(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def corrupt(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("value"))


def reconcile_views(views: DataFrame) -> DataFrame:
    """Fold the two spellings producers use for compared products and filter hits."""
    return (views
            .withColumn("compared_product_ids", F.coalesce("compared_product_ids", "product_ids"))
            .withColumn("filtered_results_count",
                        F.when(F.col("event_type") == "filter",
                               F.coalesce("filtered_results_count", "results_count")))
            .drop("product_ids"))


def reconcile_carts(carts: DataFrame) -> DataFrame:
    """Fill value and quantity from the checkout and update fields."""
    return (carts.withColumn("cart_value", F.coalesce("cart_value", "total_value"))
            .withColumn("quantity", F.coalesce("quantity", "new_quantity")))


#: What folds the spellings of a topic's producers, applied right after decoding.
RECONCILE = {"product_views": reconcile_views, "cart_events": reconcile_carts}


def events_of(topic: str, decoded: DataFrame) -> DataFrame:
    """Readable events of a topic with one spelling per field."""
    return RECONCILE.get(topic, lambda df: df)(readable(decoded))


def explode_products(transactions: DataFrame) -> DataFrame:
    """One row per purchased product with its place; transactions without products give no row."""
    return (transactions
            .select("transaction_id", "user_id", "timestamp", "total_amount", "payment_method", "country",
                    F.posexplode("products").alias("line_no", "p"))
            .select("transaction_id", "user_id", "timestamp", "total_amount", "payment_method", "country",
                    "p.product_id", "p.quantity", F.col("p.price").alias("unit_price"), "line_no"))


def line_items(transactions: DataFrame) -> DataFrame:
    """Sale lines with ids that a replay reproduces."""
    return (transactions
            .select("transaction_id", "user_id", "timestamp", "payment_method", "country",
                    F.posexplode("products").alias("pos", "p"))
            .select("transaction_id",
                    content_id("transaction_id", "pos").alias("line_item_id"),
                    "user_id", "p.product_id", "p.quantity", F.col("p.price").alias("unit_price"),
                    from_cents(line_cents("p.quantity", "p.price")).alias("total_amount"),
                    F.lit(0.0).alias("discount_amount"),
                    "payment_method", "country", F.col("timestamp").alias("transaction_timestamp")))


def view_events(views: DataFrame) -> DataFrame:
    return views.select("event_id", "event_type", "user_id", "session_id", "product_id",
                        F.col("timestamp").alias("event_timestamp"),
                        "view_duration", "search_query", "country")


def cart_events(carts: DataFrame) -> DataFrame:
    return carts.select("event_id", "event_type", "user_id", "session_id", "product_id",
                        F.col("timestamp").alias("event_timestamp"),
                        "quantity", "cart_value", "country")


def stamped(df: DataFrame, *names: str, at: Column | None = None) -> DataFrame:
    """Add processing-time columns; kept out of the operators so those stay deterministic."""
    now = F.current_timestamp() if at is None else at
    return df.withColumns({name: now for name in names})


def batch_slice(events: DataFrame, ts: str, batch_date=None, today=None, days: int = 7) -> DataFrame:
    """Rows of one day, or of the last ``days`` days up to ``today``."""
    if batch_date is not None:
        start = F.lit(batch_date).cast("date")
        return events.filter(in_range(ts, start.cast("timestamp"), F.date_add(start, 1).cast("timestamp")))
    end = F.current_date() if today is None else F.lit(today).cast("date")
    return events.filter(in_range(ts, F.date_sub(end, days).cast("timestamp"), None))


def time_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Report range, both ends included."""
    c = F.col(column)
    if start is not None:
        df = df.filter(c >= F.lit(start).cast("timestamp"))
    if end is not None:
        df = df.filter(c <= F.lit(end).cast("timestamp"))
    return df


def ingest_rate(messages: DataFrame, width: str = "1 minute", seconds: int = 60) -> DataFrame:
    """Messages, rate per second and newest offset per topic, partition and window."""
    return (messages
            .groupBy(F.window("timestamp", width), "topic", "partition")
            .agg(F.count(F.lit(1)).alias("messages"), F.max("offset").alias("latest_offset"))
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    "topic", "partition", "messages",
                    (F.col("messages") / F.lit(float(seconds))).alias("per_second"), "latest_offset"))


def duplicates(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def first_occurrences(events: DataFrame, key: str, within_watermark: bool | None = None) -> DataFrame:
    """Each event once, by its id.

    In a stream an id is remembered as long as the watermark needs, so the state stays bounded; the source must
    have declared event time, and events behind the watermark go, as the windows after it would drop
    them. In batch all rows are compared. Events without an id are told apart by all their fields.
    """
    fields = [c for c in events.columns if c != key]
    told = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("?"), F.sha2(F.to_json(F.struct(*fields)), 256)))
    marked = events.withColumn("_told", told)
    streams = events.isStreaming if within_watermark is None else within_watermark
    once = marked.dropDuplicatesWithinWatermark(["_told"]) if streams else marked.dropDuplicates(["_told"])
    return once.drop("_told")
