"""Helpers shared by the operators: text access, salted group totals, shared folders, byte-range reads."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.session import shared_folder

#: Words of a text: runs of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(column: str = "text") -> Column:
    """The text with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop input columns that an operator's own results replace (names compare without case)."""
    return df.drop(*names)


def columns(df: DataFrame, *others: str) -> list[Column]:
    """The columns of ``df``, whatever characters their names have, then those named in ``others``."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in (*df.columns, *others)]


def release() -> None:
    """Give the memory that a task has freed back to the system: its worker lives on beside those of the next stages,
    and allocators keep what they were given."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function on batches that releases memory when its task's input has ended."""
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()
    return tidied


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that an operator adds for itself: none that ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        own, i = f"__{name}", 0
        while own in taken:
            i += 1
            own = f"__{name}{i}"
        taken.add(own)
        out.append(own)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by number: Spark looks those that go to workers up by name, which fails for dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name under the shared folder; Spark's committing writers create it."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    folder = new_folder(spark, kind)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`written` that no later step reads; what was made of them has been written."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def salts(rows: int) -> int:
    """Cells per key: about the root of the rows, so neither a cell nor a key's cells are many."""
    return max(16, math.isqrt(max(0, rows)))


def salted_totals(df: DataFrame, key: str, member: str, salt: str, *totals: tuple[str, Column, Column]) -> DataFrame:
    """Totals per ``key``, one row per (key, salt) cell, without gathering a hot key in one task.

    Each of ``totals`` is (name, aggregate over rows of a cell, aggregate over the cells of a
    key; the latter refers to the former by name). A key's rows reach the second step as one
    row per cell, so a join on (key, salt) brings the totals back to rows evenly.
    """
    cells = df.groupBy(key, salt).agg(*(first.alias(name) for name, first, _ in totals))
    keys = cells.groupBy(F.col(key).alias("__key")).agg(*(second.alias(name) for name, _, second in totals))
    return cells.select(F.col(key), F.col(salt)).join(keys, F.col(key) == F.col("__key")).drop("__key")


def file_system(uri: str):
    """(pyarrow file system, path) of a folder or file that Spark has written."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def data_files(uri: str) -> list[tuple[str, int]]:
    """(path, bytes) of the part files below ``uri``, by name."""
    from pyarrow import fs
    system, path = file_system(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File
                  and not f.path.rsplit("/", 1)[-1].startswith(("_", ".")))
