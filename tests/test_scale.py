"""Steps whose share per task must not grow with the input."""

import datetime as dt
import re

from pyspark.sql import functions as F

from retailflow.operators import facts
from retailflow.plans import registry, warehouse
from retailflow.session import PARTITION_BYTES, configure
from retailflow.streaming import managed
from retailflow.streaming.managed import ManagedTable

PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
ADVISED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def restored(spark, *keys):
    for key in keys:
        spark.conf.unset(key)


def test_shuffle_partitions_grow_with_the_input(spark):
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    try:
        for size, wanted in ((0, own), (100 * PARTITION_BYTES + 1, 101)):
            configure(spark, size)
            assert int(spark.conf.get(PARTITIONS)) == wanted
        spark.conf.set(ADVISED, "8m")
        configure(spark, 1)
        assert spark.conf.get(ADVISED) == "8m"
    finally:
        restored(spark, PARTITIONS, ADVISED, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold")


def star(spark):
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-01", "9999-12-31"))

    def dim(natural, surrogate, *rows):
        return spark.createDataFrame(list(rows), f"{natural} string, {surrogate} long, is_current boolean").withColumns(
            {"effective_start_date": start, "effective_end_date": end})
    return facts.Star(dim("user_id", "customer_id", ("u1", 1, False), ("u1", 2, True)), dim("product_id", "product_id_pk", ("p1", 3, True)),
                      dim("country", "geography_id", ("UK", 4, True)),
                      spark.sql("select 20240105 as date_id, date '2024-01-05' as date"))


def test_facts_are_read_once_and_their_keys_resolved_on_the_dimension(spark, rows):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(product):
        reads.add(1)
        return product
    events = spark.createDataFrame(
        [("a", "u1", "p1", "UK"), ("b", "u9", None, "UK"), ("c", None, "p9", None), ("d", "u1", None, "XX")],
        "id string, user_id string, product string, country string").withColumn("ts", F.lit(dt.datetime(2024, 1, 5)))
    events = events.withColumn("product_id", seen.asNondeterministic()("product")).drop("product")
    out = facts.with_keys(events, star(spark), "ts", resolve=True)
    assert rows(out, "id", "customer_id", "product_id_pk", "geography_id", "date_id", *facts.STANDS_FOR) == [
        ("a", 2, 3, 4, 20240105, "u1", "p1", "UK"), ("b", None, None, 4, 20240105, None, None, "UK"),
        ("c", None, None, None, 20240105, None, None, None), ("d", 2, None, None, 20240105, "u1", None, None)]
    assert reads.value == 4


def test_facts_without_a_key_are_spread(spark):
    events = spark.range(4000).select(F.col("id"), F.lit(None).cast("string").alias("product_id"))
    many = spark.range(2000).select(F.concat(F.lit("p"), F.col("id")).alias("product_id"), F.col("id").alias("product_id_pk"))
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        per_task = facts.lookup(events, many, "product_id", "product_id_pk").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in per_task) == 4000 and max(r["count"] for r in per_task) < 2500


def test_a_dimension_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        made.add(1)
        return str(i)
    rows = spark.range(10).select(text.asNondeterministic()("id").alias("k"), F.lit(1).alias("v"))
    now = F.lit("2024-01-01").cast("timestamp")
    warehouse.update_dimension(spark, str(tmp_path / "d"), rows, "k", "s", now)
    assert made.value == 10


def test_merged_folders_have_files_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(managed, "FILE_BYTES", 2000)
    table = ManagedTable(spark, str(tmp_path / "t"), ("day", F.to_date("ts")), ["ts"], fan_in=2)
    rows = spark.range(3000).select(F.col("id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("ts"))
    for batch in range(2):
        table.append(rows.filter(F.col("id") % 2 == batch), batch)
    assert table.compact() == 2
    assert len(list(tmp_path.rglob("*.parquet"))) > 3 and table.read().count() == 3000


def test_messages_of_streams_are_stored_compressed(spark, tmp_path):
    work = registry.Workload(spark, "/root/testdata/sf0.001")
    before = set(_text_files(spark))
    assert registry.QUERIES["stream_product_velocity"](work).count() > 0
    assert all(str(f).endswith(".gz") for f in set(_text_files(spark)) - before)
    assert set(_text_files(spark)) - before
    restored(spark, PARTITIONS, ADVISED, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold")


def _text_files(spark):
    from pathlib import Path

    from retailflow.session import shared_folder
    return [f for f in Path(shared_folder(spark).removeprefix("file:")).glob("messages-*/part-*")]


def exchanged(spark, df):
    """Columns of each shuffle in the plan of ``df``."""
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    inputs = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]$", text, re.M)
    return [{re.sub(r"#\w+$", "", c.strip()) for c in columns.split(",")} for columns in inputs]


def test_lines_are_shuffled_by_number_only(spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        work = registry.Workload(spark, "/root/testdata/sf0.001")
        for query in ("fact_sales", "product_sales_velocity"):
            lines = [c for c in exchanged(spark, registry.QUERIES[query](work)) if "l_partkey" in c or "p_partkey" in c and "quantity" in c]
            assert len(lines) == 2 and not set.union(*lines) & {"user_id", "transaction_id", "product_id", "payment_method", "timestamp"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        restored(spark, PARTITIONS, ADVISED, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold")


def test_columns_added_to_users_and_parts_reach_their_lines(spark, rows):
    tables = registry.Workload(spark, "/root/testdata/sf0.001").data
    twice = tables.order_lines(lambda users: users.withColumn("of_user", F.concat("user_id", F.lit("/"), "country")),
                               lambda parts: parts.filter("p_partkey % 2 = 0").withColumn("of_part", F.col("product_id")))
    plain = tables.order_lines()
    assert twice.columns == [*plain.columns, "of_user", "of_part"]
    assert twice.filter("of_user != concat(user_id, '/', country) or of_part != product_id").count() == 0
    assert rows(twice, *plain.columns) == rows(plain.filter("cast(substr(product_id, 6) as int) % 2 = 0"))
    restored(spark, PARTITIONS, ADVISED, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold")
