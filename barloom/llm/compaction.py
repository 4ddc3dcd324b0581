"""Sharding by size-tiered compaction, with DataFrame functions only.

Arrivals become small immutable shards. Shards of a similar size form a tier; when a
tier holds ``fanout`` of them they are merged into files of the target size and leave
the tier. What is live is listed in a manifest, of which every commit writes a new
version under a name of its own and publishes it by one atomic rename, so that readers
see the old list or the new one and a second writer of the same version fails.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import free_name

SMALLEST = 1 << 18
TARGET_FILE = 1 << 26
FANOUT = 4


@dataclass(frozen=True)
class Shard:
    name: str
    bytes: int
    files: int
    tier: int


@dataclass(frozen=True)
class Manifest:
    version: int
    shards: tuple[Shard, ...]


class ConcurrentCommit(RuntimeError):
    """Another writer has published the version first."""


class ShardStore:
    """A versioned set of Parquet shards under a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, target_file: int = TARGET_FILE, smallest: int = SMALLEST) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.fanout, self.target_file, self.smallest = fanout, target_file, smallest
        hadoop = spark._jvm.org.apache.hadoop
        self._path = hadoop.fs.Path
        self._fs = hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._context = hadoop.fs.FileContext.getFileContext(hadoop.fs.Path(self.root).toUri(), spark._jsc.hadoopConfiguration()) if hadoop.fs.Path(self.root).toUri().getScheme() else hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())

    # manifests

    def _at(self, version: int) -> str:
        return f"{self.root}/manifest/{version:012d}.json"

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest manifest, or that of an older version; version 0 is empty."""
        known = self.versions()
        version = (known[-1] if known else 0) if version is None else version
        if version == 0:
            return Manifest(0, ())
        stream = self._fs.open(self._path(self._at(version)))
        try:
            text = self.spark._jvm.java.lang.String(stream.readAllBytes(), "UTF-8")
        finally:
            stream.close()
        found = json.loads(str(text))
        return Manifest(found["version"], tuple(Shard(**s) for s in found["shards"]))

    def commit(self, before: Manifest, shards: tuple[Shard, ...]) -> Manifest:
        """Publish the successor of ``before``; fails if another writer has done so."""
        after = Manifest(before.version + 1, tuple(sorted(shards, key=lambda s: s.name)))
        hidden = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, False)
        try:
            stream.write(bytearray(json.dumps({"version": after.version, "shards": [asdict(s) for s in after.shards]}).encode()))
        finally:
            stream.close()
        none = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        target = self._path(self._at(after.version))
        try:
            self._context.rename(hidden, target, options)
        except Exception as error:
            self._fs.delete(hidden, False)
            if self._fs.exists(target):
                raise ConcurrentCommit(f"version {after.version} is there already") from error
            raise
        return after

    def _add(self, shard: Shard) -> Manifest:
        """Commit a shard on top of whatever is the latest version."""
        while True:
            now = self.manifest()
            try:
                return self.commit(now, (*now.shards, shard))
            except ConcurrentCommit:  # another writer was first: on top of what it has published
                continue

    # shards

    def _folder(self, name: str) -> str:
        return f"{self.root}/shards/{name}"

    def tier_of(self, size: int) -> int:
        """Shards whose sizes lie within a factor of the fanout share a tier."""
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fanout))) if size > self.smallest else 0

    def _measured(self, name: str) -> Shard:
        files = [s for s in self._fs.listStatus(self._path(self._folder(name))) if s.getPath().getName().startswith("part-")]
        size = sum(s.getLen() for s in files)
        return Shard(name, size, len(files), self.tier_of(size))

    def append(self, arrivals: DataFrame, batch: str | None = None) -> Manifest:
        """Write rows as new immutable shards, one for each value of the column
        ``batch`` (one in all if None), each committed as a version of its own.

        All shards of a call come from one pass over ``arrivals``.
        """
        call = uuid.uuid4().hex
        if batch is None:
            names = [f"{call}-0"]
            arrivals.write.parquet(self._folder(names[0]))
        else:
            arrivals.write.partitionBy(batch).parquet(self._folder(call))
            found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self._folder(call))) if s.isDirectory() and "=" in s.getPath().getName()]
            names = [f"{call}/{n}" for n in sorted(found)]
        now = self.manifest()
        for name in names:
            now = self._add(self._measured(name))
        return now

    def read(self, schema: T.StructType, version: int | None = None) -> DataFrame:
        """The rows of all live shards."""
        paths = [self._folder(s.name) for s in self.manifest(version).shards]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _full_tier(self, manifest: Manifest) -> list[Shard]:
        tiers: dict[int, list[Shard]] = {}
        for s in manifest.shards:
            tiers.setdefault(s.tier, []).append(s)
        for tier in sorted(tiers):
            runs = sorted(tiers[tier], key=lambda s: (s.bytes, s.name))
            if len(runs) >= self.fanout:
                return runs[: self.fanout]
        return []

    def compact(self, schema: T.StructType, keep_versions: int = 16) -> Manifest:
        """Merge full tiers, lowest first, until none is full.

        A merge reads its runs and packs them into files of about the target size
        without a shuffle. Runs that no manifest of the last ``keep_versions`` names
        are deleted after the commit, so a reader may hold a list for so many commits.
        A run that is merged moves at least one tier up, so a row is written as often as
        there are tiers. If another writer commits during a merge, the merge is
        published on top of it, unless it has taken one of the runs.
        """
        now = self.manifest()
        while runs := self._full_tier(now):
            size = sum(s.bytes for s in runs)
            name = uuid.uuid4().hex
            merged = self.spark.read.schema(schema).parquet(*[self._folder(s.name) for s in runs])
            merged.coalesce(max(1, round(size / self.target_file))).write.parquet(self._folder(name))
            made = self._measured(name)
            made = replace(made, tier=max(made.tier, runs[0].tier + 1))
            now = self._replace(runs, made)
            self.vacuum(keep_versions)
        return now

    def _replace(self, runs: list[Shard], made: Shard) -> Manifest:
        """Commit ``made`` in place of ``runs``; where one of them is gone, drop ``made``."""
        gone = {s.name for s in runs}
        while True:
            now = self.manifest()
            if not gone <= {s.name for s in now.shards}:
                self._fs.delete(self._path(self._folder(made.name)), True)
                return now
            try:
                return self.commit(now, (*(s for s in now.shards if s.name not in gone), made))
            except ConcurrentCommit:
                continue

    def vacuum(self, keep_versions: int = 1) -> None:
        """Delete manifests but the last few, and the shards that only they name."""
        known = self.versions()
        old, kept = known[:-keep_versions], known[-keep_versions:]
        live = {s.name for v in kept for s in self.manifest(v).shards}
        dead = {s.name for v in old for s in self.manifest(v).shards} - live
        for name in dead:
            self._fs.delete(self._path(self._folder(name)), True)
        for v in old:
            self._fs.delete(self._path(self._at(v)), False)


def compacted(docs: DataFrame, root: str, arrivals: int = 16, fanout: int = FANOUT, target_file: int = TARGET_FILE) -> DataFrame:
    """Append a table in arrivals and compact after; the rows as read through the last manifest.

    Rows are dealt to arrivals in turn, so no hot source, id or group of copies makes one
    arrival large. All columns are kept as they are, whatever their names; nulls, empty,
    very long and repeated rows are stored like any other; an empty table gives no rows.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root, fanout, target_file)
    name = free_name(docs.columns, "_arrival")
    store.append(docs.withColumn(name, F.pmod(F.monotonically_increasing_id(), F.lit(arrivals))), name)
    store.compact(docs.schema, keep_versions=1)  # nobody else reads this store
    return store.read(docs.schema)
