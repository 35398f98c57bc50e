"""The streaming jobs: which operator runs on which topic, with its lateness and clock columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from retailflow import schemas
from retailflow.config import REALTIME, Realtime
from retailflow.operators import anomalies, ingest, windows
from retailflow.sources.streams import with_event_time
from retailflow.streaming import sinks


@dataclass(frozen=True)
class Job:
    """``build`` turns decoded events of ``topic`` into rows of ``table``."""
    table: str
    topic: str
    build: Callable[[DataFrame], DataFrame]
    lateness: str | None
    clock: tuple[str, ...] = ("created_at",)
    every: str | None = None
    alerts: bool = False
    #: Whether the job keeps each event of its topic; undecodable text goes to its quarantine.
    raw: bool = False
    #: Whether repeated events may be dropped on request. Rows behind the watermark go with them, so jobs that keep
    #: late rows don't do it; their ids make repeats harmless.
    once: bool = True


#: The id that tells events of a topic apart.
EVENT_IDS = {"transactions": "transaction_id", "product_views": "event_id", "cart_events": "event_id"}


def _lines(op: Callable[..., DataFrame], cfg: Realtime) -> Callable[[DataFrame], DataFrame]:
    return lambda transactions: op(ingest.explode_products(transactions), cfg)


def jobs(cfg: Realtime = REALTIME) -> dict[str, Job]:
    """All 21 outputs by table name: 3 raw event tables and 18 derived ones."""
    found, alert = ("detected_at", "created_at"), ("alert_generated_at", "created_at")
    tx, views, carts = "transactions", "product_views", "cart_events"
    table = [
        Job("transactions", tx, ingest.line_items, None, every="10 seconds", raw=True),
        Job("product_view_events", views, ingest.view_events, None, every="10 seconds", raw=True),
        Job("cart_events", carts, ingest.cart_events, None, every="10 seconds", raw=True),
        Job("sales_per_minute", tx, lambda d: windows.sales_per_window(d, cfg), cfg.sales.lateness),
        Job("sales_by_country", tx, lambda d: windows.sales_by_country(d, cfg), cfg.sales.lateness),
        Job("cart_sessions", carts, lambda d: windows.cart_sessions(d, cfg), cfg.cart_sessions.lateness),
        Job("abandoned_carts", carts, lambda d: windows.abandoned_carts(d, cfg), cfg.abandonment.lateness,
            ("abandonment_detected_at", "created_at")),
        Job("cart_metrics", carts, lambda d: windows.cart_metrics(d, cfg), cfg.cart_metrics.lateness),
        Job("trending_products", views, lambda d: windows.trending_products(d, cfg), cfg.trending.lateness,
            ("analyzed_at", "created_at")),
        Job("category_performance", views, lambda d: windows.category_performance(d, cfg), cfg.categories.lateness),
        Job("search_behavior", views, lambda d: windows.search_behavior(d, cfg), cfg.searches.lateness),
        Job("browsing_sessions", views, lambda d: windows.browsing_sessions(d, cfg), cfg.browsing.lateness),
        Job("high_value_anomalies", tx, lambda d: anomalies.high_value_anomalies(d, cfg),
            cfg.anomalies.lateness, found, alerts=True, once=False),
        Job("high_quantity_anomalies", tx, _lines(anomalies.high_quantity_anomalies, cfg),
            cfg.anomalies.lateness, found, alerts=True, once=False),
        Job("suspicious_patterns", tx, lambda d: anomalies.suspicious_patterns(d, cfg),
            cfg.suspicious.lateness, found),
        Job("anomaly_stats", tx,
            lambda d: anomalies.anomaly_stats(anomalies.anomalies_in_place(d, cfg), cfg), cfg.anomalies.lateness),
        Job("product_sales_velocity", tx, _lines(windows.product_sales_velocity, cfg), cfg.velocity.lateness),
        Job("inventory_by_country", tx, _lines(windows.inventory_by_country, cfg), cfg.velocity.lateness),
        Job("high_demand_alerts", tx, _lines(windows.high_demand_alerts, cfg), cfg.demand.lateness, alert),
        Job("restock_alerts", tx, _lines(windows.restock_alerts, cfg), cfg.restock.lateness, alert),
        Job("inventory_metrics", tx, _lines(windows.inventory_metrics, cfg), cfg.inventory.lateness),
    ]
    return {job.table: job for job in table}


def output(messages: DataFrame, job: Job, drop_repeats: bool = False) -> DataFrame:
    """Messages of the job's topic to its output rows, event time declared once."""
    return built(ingest.decode(messages, schemas.TOPICS[job.topic]), job, drop_repeats)


def built(decoded: DataFrame, job: Job, drop_repeats: bool = False) -> DataFrame:
    """Output rows of decoded events; with ``drop_repeats`` an event that comes again counts once."""
    events = ingest.events_of(job.topic, decoded)
    if job.lateness:
        events = with_event_time(events, "timestamp", job.lateness)
        if drop_repeats and job.once:
            events = ingest.first_occurrences(events, EVENT_IDS[job.topic])
    return ingest.stamped(job.build(events), *job.clock)


#: Makes the writer of a table from its name.
TableWriter = Callable[[str], sinks.BatchWriter]


def run(spark: SparkSession, source: Callable[[str], DataFrame], root: str,
        tables: list[str] | None = None, cfg: Realtime = REALTIME, available_now: bool = False,
        alert_writer: sinks.BatchWriter | None = None,
        table_writer: TableWriter | None = None, drop_repeats: bool = False) -> dict[str, StreamingQuery]:
    """Start the selected jobs in one session; Spark runs each as its own query.

    ``source(topic)`` gives the message stream, ``root`` holds tables and checkpoints.
    ``table_writer(name)`` chooses another sink, such as ``sinks.jdbc_batches`` of a database
    or ``sinks.console_batches``. The job of a raw table also writes the text it can't decode,
    in the same micro-batch, so its table and quarantine together hold the whole topic. ``drop_repeats`` costs
    the windowed jobs a second state, of the ids within the watermark.
    """
    chosen = jobs(cfg)
    to_table = table_writer or (lambda table: sinks.parquet_batches(f"{root}/tables/{table}"))
    started = {}
    for name in tables or list(chosen):
        job = chosen[name]
        if job.raw:
            stream = ingest.decode(source(job.topic), schemas.TOPICS[job.topic])
            writer = sinks.each_batch(
                sinks.transformed(lambda df, job=job: built(df, job), to_table(name)),
                sinks.transformed(ingest.corrupt, sinks.parquet_batches(f"{root}/quarantine/{name}")))
        elif job.alerts:
            stream = output(source(job.topic), job)
            writer = sinks.with_alerts(to_table(name), alert_writer or sinks.file_alerts(f"{root}/tables/alerts/{name}"))
        else:
            stream, writer = output(source(job.topic), job, drop_repeats), sinks.each_batch(to_table(name))
        started[name] = sinks.start(stream, writer, f"{root}/checkpoints/{name}",
                                    name=name, every=job.every, available_now=available_now)
    return started
