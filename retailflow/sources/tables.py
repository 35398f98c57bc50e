"""Batch sources: tables, pushed queries, catalog files, calendars."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow import schemas


@dataclass(frozen=True)
class Jdbc:
    """One database; ``split`` spreads a table read over ranges of a numeric or time column."""
    url: str
    user: str
    password: str
    driver: str = "org.postgresql.Driver"
    batch_size: int = 1000

    def options(self, table: str | None = None, query: str | None = None,
                split: tuple[str, str, str, int] | None = None) -> dict[str, str]:
        opts = {"url": self.url, "user": self.user, "password": self.password,
                "driver": self.driver, "batchsize": str(self.batch_size)}
        if query and split:
            # ``query`` excludes partitioned reads, a derived table does not.
            opts["dbtable"] = f"({query}) q"
        elif query:
            opts["query"] = query
        elif table:
            opts["dbtable"] = table
        else:
            raise ValueError("a table or a query is needed")
        if split:
            column, lower, upper, pieces = split
            opts |= {"partitionColumn": column, "lowerBound": str(lower),
                     "upperBound": str(upper), "numPartitions": str(pieces)}
        return opts

    def read(self, spark: SparkSession, table: str | None = None, query: str | None = None,
             split: tuple[str, str, str, int] | None = None) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options(table, query, split)).load()


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _file_system(spark, path)
    return fs.exists(hadoop)


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _file_system(spark, path)
    return fs.exists(hadoop) and fs.getFileStatus(hadoop).isDirectory()


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder; 0 if there is none."""
    hadoop, fs = _file_system(spark, path)
    return fs.getContentSummary(hadoop).getLength() if fs.exists(hadoop) else 0


def rename(spark: SparkSession, path: str, target: str) -> None:
    hadoop, fs = _file_system(spark, path)
    if not fs.rename(hadoop, _file_system(spark, target)[0]):
        raise OSError(f"{path} could not be renamed to {target}")


def remove(spark: SparkSession, path: str) -> None:
    hadoop, fs = _file_system(spark, path)
    fs.delete(hadoop, True)


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    hadoop, fs = _file_system(spark, pattern)
    return [str(s.getPath().toString()) for s in (fs.globStatus(hadoop) or [])]


def table_path(spark: SparkSession, root: str, name: str) -> str:
    """``<root>/<name>`` or ``<root>/<name>.parquet``, whichever the table folder holds."""
    return f"{root}/{name}" if path_exists(spark, f"{root}/{name}") else f"{root}/{name}.parquet"


def query(spark: SparkSession, sql: str, tables: Mapping[str, DataFrame],
          args: Mapping[str, object] | None = None) -> DataFrame:
    """Run SQL over DataFrames, which it names as ``{name}``; ``args`` fill ``:name`` markers."""
    return spark.sql(sql, args=dict(args or {}), **tables)


def product_catalog(spark: SparkSession, path: str) -> DataFrame:
    """JSON array file. A missing file is an error: no sample rows are substituted."""
    return spark.read.option("multiLine", True).schema(schemas.PRODUCT_CATALOG).json(path)


def geography_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), schemas.GEOGRAPHY)


def date_range(bounds: DataFrame, start: Column | str = "start", end: Column | str = "end") -> DataFrame:
    """One row per day from ``start`` to ``end`` inclusive of a one-row frame of bounds."""
    return bounds.select(F.explode(F.sequence(start, end, F.expr("interval 1 day"))).alias("date"))


def fixed_date_range(spark: SparkSession, start: str = "2024-01-01", end: str = "2026-12-31") -> DataFrame:
    bounds = spark.range(1).select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))
    return date_range(bounds)
