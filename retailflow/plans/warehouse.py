"""Star schema and analytics assembled from the operators, for one batch run."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.config import SCORING, Scoring
from retailflow.operators import analytics, dimensions, facts, ingest, totals
from retailflow.plans.history import History
from retailflow.sources.tables import date_range, path_exists
from retailflow.streaming import sinks
from retailflow.streaming.managed import ManagedTable


def versions(attributes: DataFrame, natural: str, surrogate: str, now: Column) -> DataFrame:
    """First load of a dimension with its surrogate key."""
    return (dimensions.first_versions(attributes, now)
            .withColumn(surrogate, dimensions.surrogate(natural)))


def calendar(events: DataFrame, ts: str) -> DataFrame:
    """Date dimension over the whole years the events touch."""
    years = events.agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    bounds = years.select(F.trunc("first", "year").alias("start"),
                          F.date_sub(F.add_months(F.trunc("last", "year"), 12), 1).alias("end"))
    return dimensions.date_dimension(date_range(bounds))


def geography(countries: DataFrame, attributes: DataFrame) -> DataFrame:
    """A geography row for every country in use; unknown ones have NULL attributes."""
    return dimensions.geography_dimension(
        countries.select("country").distinct().join(attributes, "country", "left"))


def update_dimension(spark: SparkSession, path: str, incoming: DataFrame, natural: str, surrogate: str,
                     now: Column, ignore: tuple[str, ...] = ("rfm_score",)) -> int:
    """Merge incoming rows into a versioned snapshot table and publish the next version.

    The rows are materialised, as they are merged and tested: what they are made of (all sale lines, for customers) is read once.
    """
    incoming = sinks.cut(incoming)
    if sinks.newest_version(spark, path) is None:
        merged = dimensions.first_versions(incoming, now)
    else:
        merged = dimensions.scd2_merge(sinks.read_version(spark, path), incoming, natural, now, ignore)
    keyed = merged.withColumn(surrogate, dimensions.surrogate(natural))
    # Both tests precede the version's commit marker, so readers never see a version that fails.
    if not dimensions.colliding_keys(incoming, natural).isEmpty():
        raise ValueError(f"{natural} repeats in the rows for {path}")
    if not dimensions.colliding_keys(keyed, surrogate).isEmpty():
        raise ValueError(f"surrogate {surrogate} would repeat in {path}")
    return sinks.publish_version(keyed, path)


def extend_calendar(spark: SparkSession, path: str, *times: DataFrame) -> int:
    """Append the days of the years that the given times (one-column frames) touch and the calendar lacks."""
    bounds = [df.select(F.min(df.columns[0]).alias("first"), F.max(df.columns[0]).alias("last")) for df in times]
    span = reduce(DataFrame.unionAll, bounds)
    if path_exists(spark, path):
        known = spark.read.parquet(path)
        # Years between the calendar and the new days are filled as well.
        span = span.unionAll(known.select(F.min("date").cast("timestamp"), F.max("date").cast("timestamp")))
    days = calendar(span.select(F.explode(F.array("first", "last")).alias("ts")).filter("ts is not null"), "ts")
    if path_exists(spark, path):
        days = days.join(known.select("date_id"), "date_id", "left_anti")
    days = days.select("date_id", *[c for c in days.columns if c != "date_id"])
    return sinks.counted(days, lambda df: sinks.append(df, path))


def load_facts(spark: SparkSession, path: str, incoming: DataFrame, key: str = "event_id") -> int:
    """Append facts that are not in the table yet; returns how many.

    The table is partitioned by ``date_id``. An id stands for one event and so for one day: only the days
    of the incoming facts, and those without a day, are searched for their ids.
    """
    fresh = incoming.dropDuplicates([key])
    if path_exists(spark, path):
        incoming = sinks.cut(incoming)
        dates = [r.date_id for r in incoming.select("date_id").distinct().collect()]  # days of one batch
        stored = spark.read.schema(incoming.schema).parquet(path)
        fresh = facts.unseen(incoming, facts.of_dates(stored, dates), key)
    return sinks.counted(fresh, lambda df: sinks.append(df, path, "date_id"))


def run_batch(spark: SparkSession, root: str, lines: DataFrame, views: DataFrame, carts: DataFrame,
              catalog: DataFrame, countries: DataFrame, now: Column, analysis_date: Column,
              scoring: Scoring = SCORING, batch_date=None, days: int | None = None, today=None) -> dict[str, int]:
    """One batch pass in dependency order: dimensions, facts, then the scores that read them.

    Facts are loaded from one ``batch_date``, from the last ``days`` up to ``today``, or, with neither, from all
    rows given. Returns the rows each fact and score table received.
    """
    def batch(events: DataFrame, ts: str) -> DataFrame:
        if batch_date is None and days is None:
            return events
        return sinks.cut(ingest.batch_slice(events, ts, batch_date, today, days or 7))  # the calendar and the facts read them

    new_lines = batch(lines, "transaction_timestamp")
    new_views, new_carts = batch(views, "event_timestamp"), batch(carts, "event_timestamp")
    extend_calendar(spark, f"{root}/dim_date", new_lines.select("transaction_timestamp"),
                    new_views.select("event_timestamp"), new_carts.select("event_timestamp"))
    customers = dimensions.customer_dimension(dimensions.customer_stats(lines), scoring)
    update_dimension(spark, f"{root}/dim_geography", countries, "country", "geography_id", now)
    update_dimension(spark, f"{root}/dim_customers", customers, "user_id", "customer_id", now)
    update_dimension(spark, f"{root}/dim_products", dimensions.product_dimension(catalog),
                     "product_id", "product_id_pk", now)

    star = facts.Star(
        customers=sinks.read_version(spark, f"{root}/dim_customers"),
        products=sinks.read_version(spark, f"{root}/dim_products"),
        geography=sinks.read_version(spark, f"{root}/dim_geography"),
        dates=spark.read.parquet(f"{root}/dim_date"))
    incoming = {"fact_sales": facts.fact_sales(new_lines, star),
                "fact_product_views": facts.fact_product_views(new_views, star),
                "fact_cart_events": facts.fact_cart_events(new_carts, star)}
    written = {name: load_facts(spark, f"{root}/{name}", rows) for name, rows in incoming.items()}
    # A batch without rows of a kind leaves a folder without files, whose schema can't be read from it.
    sales, views_table = (spark.read.schema(incoming[name].schema).parquet(f"{root}/{name}")
                          for name in ("fact_sales", "fact_product_views"))
    for name, build in scores(spark, root, star, sales, views_table, analysis_date, scoring).items():
        written[name] = build(f"{root}/{name}")
    return written


def run_increment(spark: SparkSession, root: str, lines: DataFrame, views: DataFrame, carts: DataFrame, catalog: DataFrame,
                  countries: DataFrame, batch: str, now: Column, scoring: Scoring = SCORING, fold_every: int = 7) -> dict[str, int]:
    """One batch pass that reads the batch's events only, never those before it.

    Customers come from the stored totals that the batch adds to; dimensions are histories that gain the versions that
    change; facts are appended to their days. ``batch`` names the pass, and running it again changes nothing. The sales
    and views of products add to totals as well. Returns the rows that each fact table received. Read dimensions with
    :func:`increment_star`; customers as they were when their facts came keep those surrogates.
    """
    extend_calendar(spark, f"{root}/dim_date", lines.select("transaction_timestamp"),
                    views.select("event_timestamp"), carts.select("event_timestamp"))
    bought = stored_totals(spark, root, "customers", totals.customer_totals())
    bought.add(batch, lines)
    seen = lines.select("user_id").filter(F.col("user_id").isNotNull()).distinct()
    # Totals of the customers in the batch: a customer without new sales can't have a new version.
    stats = totals.customer_stats(bought.totals.merged(bought.table.read().join(seen, "user_id", "left_semi")))
    histories = dimension_histories(spark, root)
    histories["customers"].merge(dimensions.customer_dimension(stats, scoring), now, batch)
    histories["products"].merge(dimensions.product_dimension(catalog), now, batch)
    histories["geography"].merge(countries, now, batch)
    star = increment_star(spark, root)
    incoming = {"fact_sales": facts.fact_sales(lines, star), "fact_product_views": facts.fact_product_views(views, star),
                "fact_cart_events": facts.fact_cart_events(carts, star)}
    written = {name: load_facts(spark, f"{root}/{name}", rows) for name, rows in incoming.items()}
    stored_totals(spark, root, "viewed", totals.view_totals()).add(batch, views.filter(F.col("product_id").isNotNull()))
    for table in (bought, stored_totals(spark, root, "viewed", totals.view_totals())):
        if len(table.table.log.snapshot().live) >= fold_every:
            table.fold()
    for history in histories.values():
        history.compact()
    return written


def stored_totals(spark: SparkSession, root: str, name: str, made: totals.Totals) -> totals.TotalsTable:
    return totals.TotalsTable(ManagedTable(spark, f"{root}/totals/{name}"), made)


def dimension_histories(spark: SparkSession, root: str) -> dict[str, History]:
    keys = {"customers": ("user_id", "customer_id"), "products": ("product_id", "product_id_pk"), "geography": ("country", "geography_id")}
    return {name: History(spark, f"{root}/history/{name}", *key) for name, key in keys.items()}


def increment_star(spark: SparkSession, root: str) -> facts.Star:
    """The dimensions of :func:`run_increment`, all versions."""
    return facts.Star(**{name: h.read() for name, h in dimension_histories(spark, root).items()},
                      dates=spark.read.parquet(f"{root}/dim_date"))


def scores(spark: SparkSession, root: str, star: facts.Star, sales: DataFrame, views: DataFrame,
           analysis_date: Column, scoring: Scoring = SCORING) -> dict[str, Callable[[str], int]]:
    """Writers of the four analytics tables, in the order they must run, from the stored facts."""

    def rfm(path: str) -> int:
        by_user = facts.natural_keys(sales, star.customers, "customer_id", "user_id")
        scored = analytics.rfm_scores(analytics.rfm_metrics(by_user, analysis_date), scoring)
        return sinks.counted(analytics.rfm_segments(scored), lambda df: sinks.replace_partitions(df, path))

    def performance(path: str) -> int:
        table = analytics.product_performance(
            sold_products(sales, star), facts.natural_keys(views, star.products, "product_id_pk", "product_id"))
        ranked = analytics.product_ranks(table, scoring).withColumn("analysis_date", analysis_date)
        return sinks.counted(ranked, lambda df: sinks.replace_partitions(df, path))

    def trends(path: str) -> int:
        table = analytics.sales_trends(sold_products(sales, star, "left"), analysis_date)
        return sinks.counted(table, lambda df: sinks.replace_partitions(df, path))

    def segments(path: str) -> int:
        rfm_table = spark.read.parquet(f"{root}/rfm_analysis").filter(F.col("analysis_date") == analysis_date)
        return sinks.counted(analytics.customer_segments(rfm_table), lambda df: sinks.replace_all(df, path))

    return {"rfm_analysis": rfm, "product_performance": performance, "sales_trends": trends,
            "customer_segments": segments}


def sold_products(sales: DataFrame, star: facts.Star, how: str = "inner") -> DataFrame:
    """Sales with the product's natural key and its current category.

    The surrogate is resolved over all versions first, so sales made under an older version
    keep counting for the product.
    """
    now = dimensions.current(star.products).select("product_id", "category")
    key_of = star.products.select("product_id_pk", "product_id").join(now, "product_id")
    return sales.join(key_of, "product_id_pk", how)
