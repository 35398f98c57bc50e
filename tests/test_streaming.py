import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from retailflow import schemas
from retailflow.config import Realtime
from retailflow.operators import ingest, windows
from retailflow.session import STATE_BYTES
from retailflow.sources.streams import file_stream, kafka_options, with_event_time
from retailflow.sources.tables import Jdbc
from retailflow.streaming import jobs, sinks
from retailflow.streaming.replay import replay

START = dt.datetime(2024, 1, 1)


def stamp(minutes):
    return (START + dt.timedelta(minutes=minutes)).isoformat()


def transaction(i, minute, amount=12000.0, quantity=60):
    return {"transaction_id": f"t{i}", "user_id": f"u{i % 2}", "timestamp": stamp(minute), "total_amount": amount,
            "products": [{"product_id": "p1", "quantity": quantity, "price": 2.5}], "payment_method": "PayPal",
            "country": "UK"}


def view(i, minute):
    kind = ("view", "view", "view", "search")[i % 4]
    return {"event_id": f"v{i}", "event_type": kind, "timestamp": stamp(minute), "user_id": "u", "session_id": "s",
            "product_id": "p1" if kind == "view" else None, "product_name": "shoe", "category": "c", "price": 2.5,
            "view_duration": 5, "search_query": "shoes" if kind == "search" else None, "results_count": 3,
            "country": "UK"}


def cart(i, minute):
    return {"event_id": f"c{i}", "event_type": ("add_to_cart", "remove_from_cart")[i % 2], "timestamp": stamp(minute),
            "user_id": "u", "session_id": "s", "cart_value": 10.0, "quantity": 1, "country": "UK"}


def write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.txt").write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events) + "\n")


@pytest.fixture
def topics(tmp_path):
    """Messages of an hour per topic, and late-future sentinels that close every window.

    Filters move below the watermark, so each filtered event type needs its own sentinel.
    """
    far = 60 * 48
    write(tmp_path / "transactions", "a", [transaction(i, i // 3) for i in range(60)] + ['{"broken'])
    write(tmp_path / "product_views", "a", [view(i, i // 10) for i in range(400)])
    write(tmp_path / "cart_events", "a", [cart(i, i) for i in range(60)])
    write(tmp_path / "transactions", "z", [transaction(999, far)])
    write(tmp_path / "product_views", "z", [view(0, far), view(3, far)])
    write(tmp_path / "cart_events", "z", [cart(1, far)])
    return tmp_path


def text_source(spark, root):
    from pyspark.sql.types import StringType, StructField, StructType
    schema = StructType([StructField("value", StringType())])
    return lambda topic: file_stream(spark, str(root / topic), schema, fmt="text")


def test_every_job_equals_its_batch_result(spark, topics, rows):
    out = topics / "out"
    running = jobs.run(spark, text_source(spark, topics), str(out), available_now=True)
    for query in running.values():
        query.awaitTermination()
    clocks = {"created_at", "analyzed_at", "detected_at", "abandonment_detected_at", "alert_generated_at"}
    for name, job in jobs.jobs().items():
        batch = jobs.output(spark.read.text(str(topics / job.topic)), job)
        compared = [c for c in batch.columns if c not in clocks]
        streamed = spark.read.parquet(f"{out}/tables/{name}/batch_id=*")
        if "window_end" in batch.columns:
            batch = batch.filter(F.col("window_end") < F.lit(START + dt.timedelta(days=1)))
        assert set(batch.columns) == set(streamed.columns), name
        assert not batch.isEmpty(), name
        assert rows(streamed, *compared) == rows(batch, *compared), name
    alerts = spark.read.parquet(f"{out}/tables/alerts/high_value_anomalies/batch_id=*")
    body = json.loads(alerts.first().value)
    assert alerts.count() == 61 and body["severity"] == "critical" and body["metadata"]["country"] == "UK"


def test_raw_tables_and_quarantine_hold_every_message(spark, tmp_path):
    write(tmp_path / "cart_events", "1", [cart(i, i) for i in range(5)])
    with open(tmp_path / "cart_events" / "2.json", "w") as f:
        f.write('{"event_id": "cut\n{"event_id": "x", "event_type": "checkout", "total_value": 99.0, "quantity": "two"}\n')
        f.write('{"event_id": "y", "event_type": "update_quantity", "new_quantity": 3}\n')
    jobs.run(spark, text_source(spark, tmp_path), str(tmp_path / "out"), ["cart_events"],
             available_now=True)["cart_events"].awaitTermination()
    table = spark.read.parquet(str(tmp_path / "out/tables/cart_events"))
    found = {r.event_id: (r.quantity, r.cart_value) for r in table.collect()}
    assert table.count() == 7 and found["x"] == (None, 99.0) and found["y"] == (3, None)
    assert spark.read.parquet(str(tmp_path / "out/quarantine/cart_events")).first().value == '{"event_id": "cut'


def test_a_job_writes_to_the_sink_it_is_given(spark, tmp_path):
    write(tmp_path / "transactions", "1", [transaction(i, i) for i in range(4)])
    seen = {}
    for query in jobs.run(spark, text_source(spark, tmp_path), str(tmp_path / "out"), ["transactions", "high_value_anomalies"],
                          available_now=True, alert_writer=lambda df, n: seen.update(alerts=df.columns),
                          table_writer=lambda name: lambda df, n: seen.update({name: df.count()})).values():
        query.awaitTermination()
    assert seen["transactions"] == 4 and seen["high_value_anomalies"] == 4 and "created_at" in seen["alerts"]


def sales_stream(spark, folder):
    tx = ingest.readable(ingest.decode(text_source(spark, folder.parent)(folder.name), schemas.TRANSACTION))
    return windows.sales_by_country(with_event_time(tx, "timestamp", "1 minute"))


def test_late_rows_inside_and_beyond_the_watermark(spark, tmp_path, rows):
    folder = tmp_path / "transactions"
    out, checkpoint = str(tmp_path / "rows"), str(tmp_path / "ckpt")

    def advance(name, *events):
        write(folder, name, events)
        sinks.start(sales_stream(spark, folder), sinks.each_batch(sinks.parquet_batches(out)), checkpoint,
                    available_now=True).awaitTermination()

    advance("1", transaction(1, 0), transaction(2, 1.5))       # watermark 0:30
    advance("2", transaction(3, 0.5))                          # late, its window is still open
    advance("3", transaction(4, 10))                           # closes both windows
    advance("4", transaction(5, 0.9), transaction(6, 60))      # beyond the watermark: dropped
    found = spark.read.parquet(f"{out}/batch_id=*")
    assert rows(found, "window_start", "total_transactions") == [
        (START, 2), (START + dt.timedelta(minutes=1), 1), (START + dt.timedelta(minutes=10), 1)]


def test_replayed_batch_overwrites_itself(spark, tmp_path, rows):
    write_batch = sinks.each_batch(sinks.parquet_batches(str(tmp_path / "rows")))
    batch = spark.createDataFrame([("a",), ("b",)], "id string")
    for _ in range(2):
        write_batch(batch, 7)
    write_batch(batch.limit(0), 8)
    assert rows(spark.read.parquet(str(tmp_path / "rows")), "id", "batch_id") == [("a", 7), ("b", 7)]


def test_restart_continues_from_checkpoint(spark, tmp_path):
    folder = tmp_path / "events"
    seen = []
    for name in ("1", "2"):
        write(folder, name, [cart(i, i) for i in range(3)])
        stream = ingest.cart_events(ingest.decode(text_source(spark, tmp_path)("events"), schemas.CART_EVENT))
        sinks.start(stream, lambda df, n: seen.append((n, df.count())), str(tmp_path / "ckpt"),
                    available_now=True).awaitTermination()
    assert seen == [(0, 3), (1, 3)]


def test_replay_of_empty_output_keeps_the_schema(spark, tmp_path):
    write(tmp_path / "transactions", "1", [transaction(1, 0)])
    out = replay(sales_stream(spark, tmp_path / "transactions"))
    assert out.count() == 0 and "total_revenue" in out.columns


def test_console_sink_starts(spark, tmp_path):
    write(tmp_path / "transactions", "1", [transaction(1, 0)])
    query = sinks.start_console(sales_stream(spark, tmp_path / "transactions"), "shown")
    query.processAllAvailable()
    query.stop()
    assert query.exception() is None


def test_batch_sinks(spark, tmp_path, rows):
    path = str(tmp_path / "scores")

    def scores(day, *values):
        return spark.createDataFrame([(v,) for v in values], "v int").withColumn(
            "analysis_date", F.lit(day).cast("date"))
    sinks.replace_partitions(scores("2024-01-01", 1, 2), path)
    sinks.replace_partitions(scores("2024-01-02", 3), path)
    sinks.replace_partitions(scores("2024-01-02", 4), path)
    assert rows(spark.read.parquet(path), "v") == [(1,), (2,), (4,)]

    all_path = str(tmp_path / "all")
    sinks.replace_all(scores("2024-01-01", 1), all_path)
    sinks.replace_all(scores("2024-01-01", 2), all_path)
    sinks.append(scores("2024-01-01", 3), all_path)
    assert rows(spark.read.parquet(all_path), "v") == [(2,), (3,)]

    once = str(tmp_path / "once")
    assert sinks.load_once(scores("2024-01-01", 1), once)
    assert not sinks.load_once(scores("2024-01-01", 2), once)
    assert rows(spark.read.parquet(once), "v") == [(1,)]


def test_connector_options():
    options = kafka_options("host:1", "topic", max_offsets_per_trigger=10000)
    assert options["subscribe"] == "topic" and options["startingOffsets"] == "latest"
    assert options["failOnDataLoss"] == "false" and options["maxOffsetsPerTrigger"] == "10000"
    db = Jdbc("jdbc:postgresql://host/db", "u", "p")
    assert db.options(table="t")["dbtable"] == "t"
    assert db.options(query="select 1")["query"] == "select 1"
    split = db.options(query="select 1", split=("id", 0, 100, 8))
    assert split["dbtable"] == "(select 1) q" and split["numPartitions"] == "8" and "query" not in split
    with pytest.raises(ValueError):
        db.options()


def test_job_list_covers_the_tables():
    listed = jobs.jobs(Realtime())
    assert len(listed) == 21 and all(name == job.table for name, job in listed.items())
    assert {j.every for n, j in listed.items() if n in ("transactions", "product_view_events", "cart_events")} == {
        "10 seconds"}


def test_a_message_is_parsed_once(spark):
    messages = spark.createDataFrame([(None,), ("{",), ('{"transaction_id": "t", "products": [{"product_id": "p", "quantity": 2}]}',)], "value string")
    events = ingest.events_of("transactions", ingest.decode(messages, schemas.TRANSACTION))
    plan = events._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"from_json\(", plan)) == 1
    assert [r.transaction_id for r in events.orderBy("transaction_id").collect()] == [None, "t"]


def test_a_replay_keeps_state_on_disk_in_partitions_that_grow(spark, tmp_path):
    folder, key = str(tmp_path / "in"), "spark.sql.streaming.stateStore.providerClass"
    spark.range(20).select((F.col("id") % 3).alias("k")).write.parquet(folder)
    own, provider = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(key)
    spark.conf.unset(key)
    try:
        stream = file_stream(spark, folder, spark.read.parquet(folder).schema).groupBy("k").count()
        out = replay(stream, "complete", str(tmp_path / "out"), input_bytes=6 * STATE_BYTES)
        assert sorted(map(tuple, out.collect())) == [(0, 7), (1, 7), (2, 6)]
        assert len(list((tmp_path / "out" / "checkpoint" / "state" / "0").iterdir())) == 1 + max(6, int(own))
        assert list((tmp_path / "out" / "checkpoint" / "state").rglob("*.zip")) or list((tmp_path / "out" / "checkpoint" / "state").rglob("*.changelog"))
        assert spark.conf.get("spark.sql.shuffle.partitions") == own
    finally:
        spark.conf.set(key, provider)
