"""Type 2 history as deltas: a run writes the versions that it closes and those that it opens, nothing else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailflow.operators import dimensions
from retailflow.streaming.managed import Conflict, ManagedTable

BUCKETS = 64


class History:
    """A dimension in buckets of its natural key.

    A version is written when it opens and once more, with its end, when it closes; a reader drops the open row of
    a version that is closed. Runs read only the buckets that their rows touch, and :meth:`compact` rewrites only
    buckets that have gathered several deltas.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, surrogate: str | None = None, buckets: int = BUCKETS,
                 ignore: Sequence[str] = ("rfm_score",)):
        self.spark, self.key, self.surrogate, self.ignore = spark, key, surrogate, tuple(ignore)
        self.bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        self.table = ManagedTable(spark, path, ("bucket", self.bucket))

    def _merged(self, rows: DataFrame) -> DataFrame:
        version = [self.key, "effective_start_date"]
        closed = rows.filter(~F.col("is_current"))
        opened = rows.filter("is_current").join(closed.select(*version), version, "left_anti")
        return opened.select(*rows.columns).unionByName(closed)

    def _folders(self, live, buckets: set[int] | None = None) -> list[str]:
        return sorted(n for n in live if buckets is None or int(n.rsplit("=", 1)[1]) in buckets)

    def read(self, version: int | None = None) -> DataFrame:
        """All versions of all keys."""
        now = self.table.log.snapshot(version)
        return self._merged(self.table.rows(self._folders(now.live), now.schema)).drop("bucket")

    def merge(self, incoming: DataFrame, now: Column, batch: int | str | None = None) -> bool:
        """Bring the history up to date with ``incoming``, one row a key; tells whether anything changed.

        Keys that don't come in stay as they are. The same ``batch`` once more changes nothing, and rows equal to the
        current versions don't either. Raises if a key comes twice or a new version's surrogate is taken.
        """
        snapshot = self.table.log.snapshot()
        if snapshot.has(batch):
            return False
        if not dimensions.colliding_keys(incoming, self.key).isEmpty():
            raise ValueError(f"{self.key} repeats in the rows for {self.table.path}")
        touched = {r[0] for r in incoming.select(self.bucket).distinct().collect()}  # one number a bucket
        if snapshot.live:
            stored = self._merged(self.table.rows(self._folders(snapshot.live, touched), snapshot.schema)).drop("bucket")
            delta = dimensions.scd2_delta(stored, incoming, self.key, now, self.ignore)
        else:
            stored, delta = None, dimensions.first_versions(incoming, now)
        if self.surrogate:
            delta = delta.withColumn(self.surrogate, dimensions.surrogate(self.key))
        staged = self.table.stage(delta)
        parts = self.table.parts(staged)
        if not parts:  # nothing changed: the log still notes the schema and the batch
            self.table._delete(staged)
            if snapshot.schema is None or batch is not None:
                self.table.commit([], schema=delta.schema, batch=batch)
            return False
        if self.surrogate:
            self._check(stored, parts, delta)
        self.table.commit(parts, schema=delta.schema, batch=batch)
        return True

    def _check(self, stored: DataFrame | None, parts: list[str], delta: DataFrame) -> None:
        """Before the commit: no new version has the surrogate of another one. Only buckets of the run are compared,
        as a collision of two keys' versions elsewhere is one of 64 bits as well; compaction sees each bucket whole."""
        opened = self.table.rows(parts, delta.schema.json()).filter("is_current").select(self.surrogate)
        taken = opened if stored is None else opened.unionAll(stored.select(self.surrogate))
        if not dimensions.colliding_keys(taken, self.surrogate).isEmpty():
            for part in {p.split("/")[0] for p in parts}:
                self.table._delete(part)
            raise ValueError(f"surrogate {self.surrogate} would repeat in {self.table.path}")

    def compact(self, deltas: int = 8) -> int:
        """Rewrite the buckets that have ``deltas`` folders or more; how many there were."""
        now = self.table.log.snapshot()
        held: dict[int, list[str]] = {}
        for name in now.live:
            held.setdefault(int(name.rsplit("=", 1)[1]), []).append(name)
        full = {bucket for bucket, names in held.items() if len(names) >= deltas}
        if not full:
            return 0
        old = self._folders(now.live, full)
        staged = self.table.stage(self._merged(self.table.rows(old, now.schema)).drop("bucket").repartition(self.bucket))
        try:
            self.table.commit(self.table.parts(staged), old)
        except Conflict:
            self.table._delete(staged)
            return 0
        return len(full)
