"""Parquet tables with a log of committed folders: replay-safe batches, snapshots, compaction, pruning by day.

A table is a folder of ``commit=<name>`` folders and a ``_log`` of numbered entries, each naming the folders
that a commit adds and removes. Readers list the log, never the data, so they see whole commits only, and
keep reading the snapshot that they began with while small folders are merged into larger ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retailflow.sources.tables import matching_paths
from retailflow.streaming.sinks import BatchWriter

#: Log entries after which one lists the whole snapshot, so a reader opens at most that many.
WHOLE_EVERY = 16
#: Bytes from which a folder is left alone, and folders of a size class that are merged to one.
TARGET_BYTES, FAN_IN = 512 << 20, 8
#: Bytes of a file of a merged folder: a task reads and sorts one.
FILE_BYTES = 16 << 20
#: Attempts of a commit against other writers of the table.
ATTEMPTS = 50


class Conflict(RuntimeError):
    """Another commit has removed a folder that this one replaces."""


@dataclass
class Snapshot:
    """What a table holds at one version: bytes of each live folder, schema, batches that are in it."""
    version: int = 0
    live: dict[str, int] = field(default_factory=dict)
    schema: str | None = None
    last_batch: int = -1
    named: list[str] = field(default_factory=list)

    def has(self, batch: int | str | None) -> bool:
        return batch in self.named if isinstance(batch, str) else batch is not None and batch <= self.last_batch

    def applied(self, entry: dict) -> Snapshot:
        if "live" in entry:
            return Snapshot(**entry)
        live = {k: v for k, v in self.live.items() if k not in set(entry["remove"])} | entry["add"]
        batch = entry.get("batch")
        return Snapshot(entry["version"], live, entry.get("schema") or self.schema,
                        max(self.last_batch, batch) if isinstance(batch, int) else self.last_batch,
                        [*self.named, batch] if isinstance(batch, str) else self.named)


class Log:
    """The numbered entries below ``<table>/_log``; an entry exists wholly or not at all."""

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.folder = spark, f"{table}/_log"
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _name(self, version: int, whole: bool) -> str:
        return f"{self.folder}/{version:012d}{'.all' if whole else ''}.json"

    def versions(self) -> list[tuple[int, bool]]:
        names = (p.rsplit("/", 1)[1] for p in matching_paths(self.spark, f"{self.folder}/*.json"))
        return sorted((int(n.split(".")[0]), ".all." in n) for n in names)

    def _load(self, version: int, whole: bool) -> dict:
        path = self._jvm.org.apache.hadoop.fs.Path(self._name(version, whole))
        stream = path.getFileSystem(self._conf).open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest snapshot, or that of a version whose log is still there."""
        known = [(n, whole) for n, whole in self.versions() if version is None or n <= version]
        first = max((n for n, whole in known if whole), default=0)
        state = Snapshot()
        for n, whole in known:
            if n > first or (n == first and whole):
                state = state.applied(self._load(n, whole))
        if version is not None and state.version != version:
            raise FileNotFoundError(f"{self.folder} has no version {version}")
        return state

    def put(self, version: int, entry: dict, whole: bool = False) -> bool:
        """Write an entry if its number is free: a rename that doesn't replace makes it visible."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._jvm.java.net.URI(
            self._jvm.org.apache.hadoop.fs.Path(self.folder).makeQualified(
                self._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self._conf).getUri(),
                self._jvm.org.apache.hadoop.fs.Path("/")).toString()), self._conf)
        target = self._jvm.org.apache.hadoop.fs.Path(self._name(version, whole))
        draft = self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/.draft-{uuid.uuid4().hex}")
        files = draft.getFileSystem(self._conf)
        stream = files.create(draft, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        options = self.spark._sc._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, target, options)
            return True
        except Exception as error:  # the exception's class is only known to the JVM
            files.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                return False
            raise


class ManagedTable:
    """A Parquet table with a commit log.

    ``layout`` names a partition column that every folder is split by, and what it is made of, such as
    the day of an event; ``order`` the columns that merged folders are range-partitioned and sorted by, so that
    row groups can be skipped.
    """

    def __init__(self, spark: SparkSession, path: str, layout: tuple[str, Column] | None = None, order: Iterable[str] = (),
                 target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN):
        self.spark, self.path, self.layout, self.order = spark, path, layout, tuple(order)
        self.target_bytes, self.fan_in, self.log = target_bytes, fan_in, Log(spark, path)

    # --- writing

    def _bytes(self, folder: str) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(self.log._conf).getContentSummary(path).getLength()

    def stage(self, df: DataFrame) -> str:
        """Write a folder that no snapshot has yet."""
        name = f"commit={uuid.uuid4().hex}"
        if self.layout:
            df.withColumn(*self.layout).write.partitionBy(self.layout[0]).parquet(f"{self.path}/{name}")
        else:
            df.write.parquet(f"{self.path}/{name}")
        return name

    def parts(self, folder: str) -> list[str]:
        """The partition folders of a staged folder, relative to the table."""
        found = matching_paths(self.spark, f"{self.path}/{folder}/{self.layout[0]}=*")
        return sorted(f"{folder}/{p.rsplit('/', 1)[1]}" for p in found)

    def commit(self, add: Iterable[str], remove: Iterable[str] = (), schema: T.StructType | None = None,
               batch: int | str | None = None) -> int | None:
        """Make folders live and others not, as one step; the version, or None if the batch is in already.

        Raises :class:`Conflict` if a folder to remove is no longer live.
        """
        entry = {"add": {name: self._bytes(name) for name in add}, "remove": sorted(remove), "batch": batch,
                 "schema": schema.json() if schema is not None else None}
        for _ in range(ATTEMPTS):
            now = self.log.snapshot()
            if now.has(batch):
                return None
            if any(name not in now.live for name in entry["remove"]):
                raise Conflict(f"{self.path}: a folder to replace is gone")
            version = now.version + 1
            if self.log.put(version, entry | {"version": version}):
                if version % WHOLE_EVERY == 0:
                    self.log.put(version, vars(now.applied(entry | {"version": version})), whole=True)
                return version
        raise Conflict(f"{self.path}: no free version in {ATTEMPTS} attempts")

    def append(self, df: DataFrame, batch: int | str | None = None) -> bool:
        """Add rows as one commit. A batch that is in the table already is not written again.

        Numbers of batches rise, as those of a stream do: one at most as large as the last is a replay.
        Names of batches are remembered one by one. Tells whether rows were added.
        """
        if self.log.snapshot().has(batch):
            return False
        if self.layout:  # tasks sort what they write by the layout: large shares are split, and a day gets few files
            df = df.withColumn(*self.layout).hint("rebalance", self.layout[0]).drop(self.layout[0])
        return self.commit([self.stage(df)], schema=df.schema, batch=batch) is not None

    # --- reading

    def rows(self, folders: Iterable[str], schema: str | None) -> DataFrame:
        fields = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType()
        folders = list(folders)
        if not folders:
            return self.spark.createDataFrame([], fields)
        read = self.spark.read.option("basePath", self.path).schema(self._file_schema(fields))
        return read.parquet(*(f"{self.path}/{name}" for name in folders)).drop("commit")

    def _file_schema(self, fields: T.StructType) -> T.StructType:
        all_fields = T.StructType(fields.fields).add("commit", "string")
        if self.layout:
            probe = self.spark.createDataFrame([], fields).select(self.layout[1].alias(self.layout[0]))
            all_fields = all_fields.add(self.layout[0], probe.schema[0].dataType)
        return all_fields

    def read(self, version: int | None = None, keep_layout: bool = False) -> DataFrame:
        """The rows of the newest snapshot, or of an earlier one. A filter on the layout column prunes folders."""
        now = self.log.snapshot(version)
        found = self.rows(sorted(now.live), now.schema)
        return found if keep_layout or not self.layout else found.drop(self.layout[0])

    def between(self, column: str, start=None, end=None) -> DataFrame:
        """Rows whose ``column`` lies in a range, both ends included; the table is laid out by the column's day."""
        found = self.read(keep_layout=True)
        name = self.layout[0] if self.layout else None
        for bound, keep in ((start, "ge"), (end, "le")):
            if bound is None:
                continue
            time = F.lit(bound).cast("timestamp")
            compare = (lambda a, b: a >= b) if keep == "ge" else (lambda a, b: a <= b)
            found = found.filter(compare(F.col(column), time))
            if name and name in found.columns:
                found = found.filter(compare(F.col(name), time.cast("date")))
        return found.drop(name) if name else found

    # --- upkeep

    def small(self, live: dict[str, int]) -> list[list[str]]:
        """Size classes with enough folders to merge; a row is rewritten once per class, about log(size) times."""
        classes: dict[int, list[str]] = {}
        for name, size in sorted(live.items()):
            if size < self.target_bytes:
                level = 0
                while size >= (4096 * self.fan_in ** (level + 1)):
                    level += 1
                classes.setdefault(level, []).append(name)
        return [names for names in classes.values() if len(names) >= self.fan_in]

    def compact(self) -> int:
        """Merge small folders until no size class is full; how many folders went.

        Readers of earlier snapshots are not disturbed. If another commit takes a folder away meanwhile, the
        merged folder is dropped and the rest is left to the next call.
        """
        gone = 0
        while groups := self.small((now := self.log.snapshot()).live):
            for names in groups:
                size = sum(now.live[n] for n in names)
                merged = self.rows(names, now.schema)
                merged = merged.drop(self.layout[0]) if self.layout else merged
                files = max(1, -(-size // min(self.target_bytes, FILE_BYTES)))
                merged = merged.repartitionByRange(files, *self.order) if self.order else merged.coalesce(files)
                staged = self.stage(merged.sortWithinPartitions(*self.order) if self.order else merged)
                try:
                    self.commit([staged], names)
                except Conflict:
                    self._delete(staged)
                    return gone
                gone += len(names)
        return gone

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        path.getFileSystem(self.log._conf).delete(path, True)

    def vacuum(self, keep_versions: int = 16) -> int:
        """Delete folders that none of the last ``keep_versions`` snapshots has; how many went.

        Run it when no writer is at work on the table: a folder that is written but not yet committed counts as
        left over, such as those of failed attempts.
        """
        newest = self.log.snapshot().version
        live: set[str] = set()
        for version in range(max(1, newest - keep_versions + 1), newest + 1):
            live |= set(self.log.snapshot(version).live)
        tops = {name.split("/")[0] for name in live}
        gone = 0
        for path in matching_paths(self.spark, f"{self.path}/commit=*"):
            name = path.rsplit("/", 1)[1]
            if name not in tops:
                self._delete(name)
                gone += 1
        return gone


def managed_batches(table: ManagedTable, compact_every: int | None = FAN_IN) -> BatchWriter:
    """Append micro-batches to a managed table; a replayed batch changes nothing. Small folders are merged every so
    many batches, in the batch itself."""
    def write(df: DataFrame, batch_id: int) -> None:
        table.append(df, batch_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            table.compact()
    return write


def managed_tables(spark: SparkSession, root: str, times: dict[str, str] | None = None, **options) -> Callable[[str], BatchWriter]:
    """A ``table_writer`` of ``jobs.run``: each output as a managed table, laid out by the day of its time column.

    ``times`` names the time column of a table; ``window_end`` and ``timestamp`` are found by themselves.
    """
    def writer(name: str) -> BatchWriter:
        made: dict[str, BatchWriter] = {}

        def write(df: DataFrame, batch_id: int) -> None:
            if name not in made:
                time = (times or {}).get(name) or next((c for c in ("window_end", "timestamp") if c in df.columns), None)
                layout = ("event_day", F.to_date(time)) if time else None
                table = ManagedTable(spark, f"{root}/{name}", layout, [time] if time else (), **options)
                made[name] = managed_batches(table)
            made[name](df, batch_id)
        return write
    return writer
