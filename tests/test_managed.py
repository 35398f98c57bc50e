"""Managed tables, totals by batches, history by deltas, repeated events, sketches, fact repair."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from retailflow.config import Windowing
from retailflow.operators import dimensions, ingest, sketches, totals
from retailflow.plans import warehouse
from retailflow.plans.history import History
from retailflow.plans.repair import Lookup, repair_facts, valid_or_first
from retailflow.session import freed_shuffles
from retailflow.sources.streams import file_stream, with_event_time
from retailflow.streaming import sinks
from retailflow.streaming.managed import WHOLE_EVERY, Conflict, ManagedTable, managed_batches, managed_tables


def hours(spark, start, stop):
    time = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))
    return spark.range(start, stop, 1, 1).withColumn("ts", time)


def by_day(spark, path, **options):
    return ManagedTable(spark, str(path), ("event_day", F.to_date("ts")), ["ts"], **options)


def files_below(path):
    return [p for p in path.rglob("*.parquet")]


# --- managed tables ------------------------------------------------------------------------

def test_replays_change_nothing_and_folders_stay_few(spark, tmp_path):
    table = by_day(spark, tmp_path / "t", fan_in=4)
    write = managed_batches(table)
    most = 0
    for batch in range(24):
        write(hours(spark, batch * 3, batch * 3 + 3), batch)
        write(hours(spark, batch * 3, batch * 3 + 3), batch)  # the batch once more, as after a failure
        most = max(most, len(table.log.snapshot().live))
    assert sorted(r.id for r in table.read().collect()) == list(range(72))
    assert most <= 10
    assert table.vacuum(1) > 0
    assert sorted(r.id for r in table.read().collect()) == list(range(72))
    live = len(table.log.snapshot().live)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("commit=")]) == live


def test_readers_keep_their_snapshot_during_compaction(spark, tmp_path):
    table = by_day(spark, tmp_path / "t", fan_in=2)
    for batch in range(4):
        table.append(hours(spark, batch, batch + 1), batch)
    before = table.read()
    seen = table.log.snapshot().version
    assert table.compact() >= 2
    assert before.count() == 4 and table.read().count() == 4 and table.read(seen).count() == 4
    assert table.read(2).count() == 2
    assert table.compact() == 0


def test_a_lost_race_leaves_the_table_whole(spark, tmp_path):
    table = by_day(spark, tmp_path / "t", fan_in=2)
    for batch in range(2):
        table.append(hours(spark, batch, batch + 1), batch)
    old = sorted(table.log.snapshot().live)
    staged = table.stage(hours(spark, 0, 2))
    table.compact()
    with pytest.raises(Conflict):
        table.commit([staged], old)
    assert table.read().count() == 2
    version = table.log.snapshot().version
    assert not table.log.put(version, {"version": version, "add": {}, "remove": []})  # the number is taken


def test_whole_entries_make_old_ones_unneeded(spark, tmp_path):
    table = ManagedTable(spark, str(tmp_path / "t"))
    for batch in range(WHOLE_EVERY + 3):
        table.append(spark.range(batch, batch + 1, 1, 1), batch)
    for n in range(1, WHOLE_EVERY):
        (tmp_path / "t" / "_log" / f"{n:012d}.json").unlink()
    assert table.read().count() == WHOLE_EVERY + 3
    assert not table.append(spark.range(1), 5)


def test_day_filters_prune_folders(spark, tmp_path):
    table = by_day(spark, tmp_path / "t")
    table.append(hours(spark, 0, 96), 0)
    found = table.between("ts", "2024-01-02", "2024-01-03 06:00:00")
    assert sorted(r.id for r in found.collect()) == list(range(24, 55))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_day" in plan and "PushedFilters: [IsNotNull(ts)" in plan


def test_empty_and_unwritten_tables(spark, tmp_path):
    table = by_day(spark, tmp_path / "t")
    table.append(hours(spark, 0, 0), 0)
    assert table.read().count() == 0 and set(table.read().columns) == {"id", "ts"}
    named = ManagedTable(spark, str(tmp_path / "n"))
    assert named.append(spark.range(1), "day one") and not named.append(spark.range(1), "day one")
    assert named.append(spark.range(1), "day two") and named.read().count() == 2


def test_a_stream_writes_managed_tables(spark, tmp_path):
    hours(spark, 0, 5).write.parquet(str(tmp_path / "in"))
    writer = managed_tables(spark, str(tmp_path / "tables"), {"events": "ts"})("events")
    for folder in ("a", "a", "b"):  # the same checkpoint goes on; a new one replays from the start
        stream = file_stream(spark, str(tmp_path / "in"), hours(spark, 0, 1).schema)
        sinks.start(stream, sinks.each_batch(writer), str(tmp_path / folder), available_now=True).awaitTermination()
    table = by_day(spark, tmp_path / "tables" / "events")
    assert sorted(r.id for r in table.read().collect()) == list(range(5))


# --- repeated events --------------------------------------------------------------------------

def test_first_occurrences_in_batch_keep_events_without_an_id(spark, rows):
    events = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 2), (None, 2)], "id string, v int")
    once = ingest.first_occurrences(events, "id")
    assert sorted(r.id or "" for r in once.collect()) == ["", "", "a"]


def test_streamed_repeats_count_once(spark, tmp_path, rows):
    day = dt.datetime(2024, 1, 1)
    sent = [(str(i % 50), day + dt.timedelta(seconds=i % 50)) for i in range(150)] + [("late", day + dt.timedelta(days=1))]
    spark.createDataFrame(sent, "transaction_id string, timestamp timestamp").write.parquet(str(tmp_path / "in"))
    stream = with_event_time(file_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), "timestamp", "1 minute")
    counted = (ingest.first_occurrences(stream, "transaction_id").groupBy(F.window("timestamp", "1 hour"))
               .agg(F.count(F.lit(1)).alias("n")).select("window.start", "n"))
    from retailflow.streaming.replay import replay
    assert [n for _, n in rows(replay(counted))] == [50]


# --- totals ---------------------------------------------------------------------------------------

def sales_rows(spark, values):
    return spark.createDataFrame(values, "user_id string, transaction_id string, transaction_timestamp timestamp, total_amount double")


def test_totals_of_batches_equal_those_of_all_events(spark, tmp_path, rows):
    day = dt.datetime(2024, 1, 1)
    values = [(f"u{i % 7}" if i % 11 else None, f"t{i}" if i % 5 else None, day + dt.timedelta(days=i) if i % 6 else None, i / 10)
              for i in range(60)]
    table = totals.TotalsTable(ManagedTable(spark, str(tmp_path / "t")), totals.customer_totals())
    for batch in range(4):
        part = sales_rows(spark, values[batch::4])
        assert table.add(f"day {batch}", part)
        assert not table.add(f"day {batch}", part)
        if batch == 2:
            assert table.fold() and len(table.table.log.snapshot().live) == 1
    everything = sales_rows(spark, values)
    assert rows(totals.customer_stats(table.read())) == rows(dimensions.customer_stats(everything))
    from retailflow.operators import analytics
    date = F.lit("2024-06-01").cast("date")
    assert rows(totals.rfm_metrics(table.read(), date)) == rows(analytics.rfm_metrics(everything, date))
    assert not table.fold() or len(table.table.log.snapshot().live) == 1


# --- history ----------------------------------------------------------------------------------------

def customers(spark, *values):
    return spark.createDataFrame(list(values), "k string, city string, rfm_score int")


def at(day):
    return F.lit(f"2024-01-{day:02d}").cast("timestamp")


def test_history_by_deltas_equals_snapshots(spark, tmp_path, rows):
    runs = [[("a", "x", 1), ("b", "x", 1), ("c", None, 1)], [("a", "y", 1), ("b", "x", 2)], [("c", "z", 1), ("d", "w", 1)],
            [("a", None, 1), ("d", "w", 1)], []]
    history, snapshot = History(spark, str(tmp_path / "h"), "k", "s", buckets=4), None
    for day, values in enumerate(runs, 1):
        incoming = customers(spark, *values)
        assert history.merge(incoming, at(day), day) == (day < 5)
        assert not history.merge(incoming, at(day), day)
        snapshot = (dimensions.first_versions(incoming, at(day)) if snapshot is None
                    else dimensions.scd2_merge(snapshot, incoming, "k", at(day), ("rfm_score",)))
        shown = ("k", "city", "effective_start_date", "effective_end_date", "is_current")
        assert rows(history.read(), *shown) == rows(snapshot, *shown)
        if day == 3:
            assert history.compact(2) > 0
            assert rows(history.read(), *shown) == rows(snapshot, *shown)
    with pytest.raises(ValueError):
        history.merge(customers(spark, ("a", "1", 1), ("a", "2", 1)), at(9), 9)


def test_a_run_writes_only_the_buckets_that_change(spark, tmp_path):
    history = History(spark, str(tmp_path / "h"), "k", "s", buckets=16)
    history.merge(customers(spark, *[(f"k{i}", "x", 1) for i in range(400)]), at(1), 1)
    before = {p: p.stat().st_mtime_ns for p in files_below(tmp_path / "h")}
    history.merge(customers(spark, *[(f"k{i}", "y" if i == 7 else "x", 1) for i in range(400)]), at(2), 2)
    after = {p: p.stat().st_mtime_ns for p in files_below(tmp_path / "h")}
    added = set(after) - set(before)
    assert {p: t for p, t in after.items() if p in before} == before
    assert len({p.parent.name for p in added}) == 1  # one bucket
    assert sum(spark.read.parquet(str(p)).count() for p in added) == 2  # the version that ends and the new one
    assert history.compact(2) == 1 and history.read().count() == 401


# --- batch passes that read their own events only -----------------------------------------------------

def test_increments_equal_one_pass_over_all_events(spark, tmp_path, rows):
    line = ("line_item_id string, transaction_id string, user_id string, product_id string, quantity int, unit_price double, "
            "total_amount double, discount_amount double, payment_method string, country string, transaction_timestamp timestamp")
    days = [dt.datetime(2024, 1, d, 12) for d in (1, 2, 3)]
    lines = [(f"l{d.day}-{i}", f"t{d.day}-{i}", f"u{i % (2 + d.day)}", "p1", 1, 5.0, 5.0 * (i + 1), 0.0, "card", "UK", d)
             for d in days for i in range(6)]
    view = ("event_id string, event_type string, user_id string, session_id string, product_id string, view_duration int, "
            "search_query string, country string, event_timestamp timestamp")
    views = [(f"v{d.day}", "view", "u0", "s", "p1", 3, None, "UK", d) for d in days]
    cart = ("event_id string, event_type string, user_id string, session_id string, product_id string, quantity int, "
            "cart_value double, country string, event_timestamp timestamp")
    catalog = spark.createDataFrame([("p1", "one", "c", 5.0)], "product_id string, name string, category string, price double")
    countries = spark.createDataFrame([("UK", "r", "c", "GBP", "z")], "country string, region string, continent string, currency string, timezone string")
    root = str(tmp_path / "w")

    def run(day, again=False):
        own = [x for x in lines if x[-1].day == day]
        return warehouse.run_increment(
            spark, root, spark.createDataFrame(own, line), spark.createDataFrame([v for v in views if v[-1].day == day], view),
            spark.createDataFrame([], cart), catalog, countries, f"day {day}", at(day + 10))

    assert [run(d)["fact_sales"] for d in (1, 2, 2, 3)] == [6, 6, 0, 6]
    star = warehouse.increment_star(spark, root)
    everything = spark.createDataFrame(lines, line)
    stats = dimensions.customer_dimension(dimensions.customer_stats(everything))
    shown = ("user_id", "total_transactions", "total_spent", "first_transaction_date", "last_transaction_date")
    assert rows(dimensions.current(star.customers), *shown) == rows(stats, *shown)
    sales = spark.read.parquet(f"{root}/fact_sales")
    assert sales.filter("customer_id is null or product_id_pk is null or geography_id is null or date_id is null").isEmpty()
    assert sorted(r.event_id for r in sales.collect()) == sorted(x[0] for x in lines)
    seen = warehouse.stored_totals(spark, root, "viewed", totals.view_totals()).read()
    assert rows(seen) == [("p1", 3)]


# --- sketches ------------------------------------------------------------------------------------------

def test_distinct_counts_of_merged_windows(spark):
    views = spark.range(0, 60000, 1, 4).select(
        F.lit("view").alias("event_type"), F.concat(F.lit("u"), (F.col("id") % 20000).cast("string")).alias("user_id"),
        F.concat(F.lit("p"), (F.col("id") % 90).cast("string")).alias("product_id"), F.lit(2.5).alias("price"),
        F.lit("c").alias("category"), F.lit("UK").alias("country"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") % 2880).cast("int"))).alias("timestamp"))
    minutes = sketches.view_sketches(views, Windowing("1 hour"))
    month = sketches.estimated(sketches.rolled_up(sketches.rolled_up(minutes, "day", ("category", "country")), "month")).collect()
    assert len(month) == 1 and month[0].total_views == 60000 and month[0].unique_products == 90
    assert abs(month[0].unique_users - 20000) <= sketches.error_bound() * 20000
    assert month[0].avg_product_price == 2.5



def test_rolled_up_members_are_counted_exactly(spark):
    n = 20000
    views = spark.range(2 * n).select(
        F.lit("view").alias("event_type"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") % 600).cast("int"))).alias("timestamp"),
        F.when(F.col("id") > 0, F.lit("A")).alias("category"), F.lit("UK").alias("country"), F.col("id").cast("string").alias("nr"),
        F.when(F.col("id") != 5, F.concat(F.lit("u"), F.col("id") % n)).alias("user_id"), F.lit("p").alias("product_id"),
        F.when(F.col("id") % 2 == 0, F.lit(1.5)).alias("price"))
    days = sketches.rolled_up_members(sketches.view_members(views, Windowing("1 hour")), "day", ("category", "country"))
    out = {r.category: r for r in sketches.counted_members(sketches.rolled_up_members(days, "month")).collect()}
    assert (out["A"].total_views, out["A"].unique_users, out["A"].unique_products, out["A"].avg_product_price) == (2 * n - 1, n, 1, 1.5)
    assert (out[None].total_views, out[None].unique_users) == (1, 1)


# --- replacing whole tables, repair -------------------------------------------------------------------

def test_a_failed_replacement_leaves_the_old_rows(spark, tmp_path, rows):
    path = str(tmp_path / "t")
    sinks.replace_all(spark.range(3).toDF("v"), path)
    with pytest.raises(Exception):
        sinks.replace_all(spark.range(5).select(F.assert_true(F.col("id") < 4).alias("v")), path)
    assert rows(spark.read.parquet(path)) == [(0,), (1,), (2,)]
    sinks.replace_all(spark.read.parquet(path).filter("v > 0"), path)  # may read what it replaces
    assert rows(spark.read.parquet(path)) == [(1,), (2,)]
    (tmp_path / "t").rename(tmp_path / "t.replaced")  # a job that ended between the renames
    sinks.replace_all(spark.range(1).toDF("v"), path)
    assert rows(spark.read.parquet(path)) == [(0,)]


def test_late_members_get_their_facts(spark, tmp_path, rows):
    versions = spark.createDataFrame(
        [("a", 1, dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9)), ("a", 2, dt.datetime(2024, 1, 9), dt.datetime(9999, 12, 31)),
         ("b", 3, dt.datetime(2024, 1, 2), dt.datetime(9999, 12, 31))],
        "user_id string, customer_id long, effective_start_date timestamp, effective_end_date timestamp")
    events = spark.createDataFrame(
        [("e1", "a", dt.datetime(2024, 1, 1), 20240101), ("e2", "a", dt.datetime(2024, 1, 6), 20240106),
         ("e3", "a", dt.datetime(2024, 1, 9), 20240109), ("e4", None, dt.datetime(2024, 1, 9), 20240109),
         ("e5", "b", dt.datetime(2024, 1, 3), 20240103), ("e6", "z", dt.datetime(2024, 1, 7), 20240107), ("e7", "b", None, None)],
        "event_id string, user_id string, ts timestamp, date_id int")
    by = Lookup(versions, "user_id", "customer_id")
    assert rows(valid_or_first(events, by, "ts"), "event_id", "customer_id") == [
        ("e1", 1), ("e2", 1), ("e3", 2), ("e4", None), ("e5", 3), ("e6", None), ("e7", None)]
    path = str(tmp_path / "f")
    known = F.when(F.col("event_id") == "e5", F.lit(99)).cast("long")
    sinks.append(events.select("event_id", "date_id", "ts", known.alias("customer_id")), path, "date_id")
    before = {p: p.stat().st_mtime_ns for p in files_below(tmp_path / "f")}
    assert repair_facts(spark, path, events, [by], "ts") == 3
    assert rows(spark.read.parquet(path), "event_id", "customer_id") == [
        ("e1", 1), ("e2", 1), ("e3", 2), ("e4", None), ("e5", 99), ("e6", None), ("e7", None)]
    kept = {p for p in files_below(tmp_path / "f") if before.get(p) == p.stat().st_mtime_ns}
    assert {p.parent.name for p in kept} == {"date_id=20240103", "date_id=20240107", "date_id=__HIVE_DEFAULT_PARTITION__"}
    assert repair_facts(spark, path, events, [by], "ts") == 0


def test_repair_doubles_no_fact(spark, tmp_path, rows):
    versions = spark.createDataFrame([("a", 1, dt.datetime(2024, 1, 1), dt.datetime(9999, 12, 31))],
                                     "user_id string, customer_id long, effective_start_date timestamp, effective_end_date timestamp")
    events = spark.createDataFrame([("t1", "a"), ("t1", "a"), ("t2", None)], "transaction_id string, user_id string")
    facts = spark.createDataFrame([("e1", "t1", 20240105), ("e1", "t1", 20240105), ("e2", "t1", 20240105), ("e3", "t2", 20240105)],
                                  "event_id string, transaction_id string, date_id int").withColumns(
        {"ts": F.lit(dt.datetime(2024, 1, 5)), "customer_id": F.lit(None).cast("long")})
    path = str(tmp_path / "f")
    sinks.append(facts, path, "date_id")
    assert repair_facts(spark, path, events, [Lookup(versions, "user_id", "customer_id")], "ts", key="transaction_id") == 1
    assert rows(spark.read.parquet(path), "event_id", "customer_id") == [("e1", 1), ("e1", 1), ("e2", 1), ("e3", None)]


def test_shuffles_of_a_load_are_removed(spark, tmp_path):
    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {str(f) for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle" in str(f)}
    before, key = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with freed_shuffles(spark):
        sinks.append(spark.range(1000).repartition(3, "id"), str(tmp_path / "t"))
        assert not files() - before
    assert spark.conf.get(key) == "false" and spark.read.parquet(str(tmp_path / "t")).count() == 1000
