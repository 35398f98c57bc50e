"""Threshold anomalies on transactions and sale lines, their statistics and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailflow.config import REALTIME, Realtime
from retailflow.functions.labels import at_least, content_id, count_where
from retailflow.functions.money import money_avg, money_sum, money_text
from retailflow.operators.windows import windowed


def _severity(value: Column | str, low: float, high: float) -> Column:
    return at_least(value, [(high, "critical"), ((low + high) / 2, "high")], "medium")


def high_value_anomalies(transactions: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    low, high = cfg.high_value
    return transactions.filter(F.col("total_amount") >= low).select(
        "transaction_id", "user_id", "timestamp", "total_amount", "payment_method", "country",
        F.lit("high_value").alias("anomaly_type"),
        F.concat(F.lit("Transaction amount $"), money_text("total_amount"),
                 F.lit(f" exceeds threshold ${low}")).alias("anomaly_reason"),
        _severity("total_amount", low, high).alias("severity"))


def high_quantity_anomalies(lines: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    """One row per offending product of a transaction; ``line_no`` is kept where there is one."""
    low, high = cfg.high_quantity
    return lines.filter(F.col("quantity") >= low).select(
        "transaction_id", "user_id", "timestamp", "total_amount", "payment_method", "country",
        "product_id", "quantity", *([c for c in ("line_no",) if c in lines.columns]),
        F.lit("high_quantity").alias("anomaly_type"),
        F.concat(F.lit("Product quantity "), F.col("quantity").cast("string"),
                 F.lit(f" exceeds threshold {low}")).alias("anomaly_reason"),
        _severity("quantity", low, high).alias("severity"))


def suspicious_patterns(transactions: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    """Users with several large transactions inside one window."""
    return (windowed(
        transactions.filter(F.col("total_amount") >= cfg.suspicious_min_amount),
        cfg.suspicious, ["user_id", "country"],
        F.count("transaction_id").alias("transaction_count"),
        money_sum("total_amount").alias("total_spent"),
        money_avg("total_amount").alias("avg_transaction"),
        F.max("total_amount").alias("max_transaction"),
        F.min("timestamp").alias("first_transaction"),
        F.max("timestamp").alias("last_transaction"))
        .filter(F.col("transaction_count") >= cfg.suspicious_min_count)
        .withColumn("anomaly_type", F.lit("suspicious_pattern"))
        .withColumn("anomaly_reason", F.concat(
            F.col("transaction_count").cast("string"), F.lit(" high-value transactions totaling $"),
            money_text("total_spent"), F.lit(f" in {cfg.suspicious.width}")))
        .withColumn("severity", F.lit("high")))


_STATS_INPUT = ("timestamp", "country", "anomaly_type", "severity")


def anomaly_stats(anomalies: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    kind, severity = F.col("anomaly_type"), F.col("severity")
    return windowed(anomalies, cfg.anomalies, ["country"],
                    F.count(F.lit(1)).alias("total_anomalies"),
                    count_where(kind == "high_value").alias("high_value_count"),
                    count_where(kind == "high_quantity").alias("high_quantity_count"),
                    count_where(severity == "critical").alias("critical_count"),
                    count_where(severity == "high").alias("high_severity_count"),
                    count_where(severity == "medium").alias("medium_severity_count"))


def all_anomalies(high_value: DataFrame, high_quantity: DataFrame) -> DataFrame:
    return high_value.select(*_STATS_INPUT).unionByName(high_quantity.select(*_STATS_INPUT))


def anomalies_in_place(transactions: DataFrame, cfg: Realtime = REALTIME) -> DataFrame:
    """Both anomaly kinds of nested transactions from one read of the source.

    A union of two branches would scan the stream twice.
    """
    value_low, value_high = cfg.high_value
    low, high = cfg.high_quantity
    by_value = F.when(F.col("total_amount") >= value_low, F.array(F.struct(
        F.lit("high_value").alias("anomaly_type"),
        _severity("total_amount", value_low, value_high).alias("severity"))))
    by_quantity = F.transform(
        F.filter("products", lambda p: p["quantity"] >= low),
        lambda p: F.struct(F.lit("high_quantity").alias("anomaly_type"),
                           _severity(p["quantity"], low, high).alias("severity")))
    none = F.array().cast("array<struct<anomaly_type:string,severity:string>>")
    found = F.concat(F.coalesce(by_value, none), F.coalesce(by_quantity, none))
    return (transactions.select("timestamp", "country", F.explode(found).alias("a"))
            .select("timestamp", "country", "a.anomaly_type", "a.severity"))


def critical_alerts(anomalies: DataFrame, source: str = "AnomalyDetector") -> DataFrame:
    """Alert records of the critical rows; the id repeats when a batch is replayed."""
    identity = [c for c in ("transaction_id", "anomaly_type", "product_id", "quantity", "line_no") if c in anomalies.columns]
    return anomalies.filter(F.col("severity") == "critical").select(
        content_id(*identity).alias("alert_id"),
        F.lit("anomaly").alias("alert_type"), "severity",
        F.concat(F.lit("Critical anomaly detected: "), F.col("anomaly_reason")).alias("title"),
        F.col("anomaly_reason").alias("message"),
        F.lit(source).alias("source"),
        F.lit(False).alias("resolved"),
        F.struct("transaction_id", "user_id", "total_amount", "country", "anomaly_type").alias("metadata"))


def alert_messages(alerts: DataFrame) -> DataFrame:
    """Key/value form for the alerts topic."""
    return alerts.select(F.col("alert_id").alias("key"), F.to_json(F.struct("*")).alias("value"))


def recent_critical(high_value: DataFrame, high_quantity: DataFrame, order_by: str = "detected_at") -> DataFrame:
    """Both anomaly tables as one report of critical rows, newest first."""
    def part(df: DataFrame, source: str, metric: str) -> DataFrame:
        return df.filter(F.col("severity") == "critical").select(
            F.lit(source).alias("anomaly_source"), "transaction_id", "user_id", "timestamp",
            F.col(metric).cast("double").alias("metric_value"), "severity",
            *([] if order_by == "timestamp" else [order_by]))
    return (part(high_value, "high_value", "total_amount")
            .unionByName(part(high_quantity, "high_quantity", "quantity"))
            .orderBy(F.col(order_by).desc(), "transaction_id", "metric_value"))
