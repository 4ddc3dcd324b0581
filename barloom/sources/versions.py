"""A table of bars in versions: snapshots for readers, and merges that write only the periods they touch.

A version is a manifest, a small file that names the folder of each period of time. A merge
reads the periods that its rows fall into, writes them anew to a folder of its own and
publishes a manifest in which these periods point there; all other periods keep their
folders. A reader takes one manifest and sees that version alone, whatever is merged meanwhile. Folders that
no kept version names are removed.

The rename that publishes is atomic and never replaces a file on HDFS; on object stores
that give no such promise, one writer at a time must be ensured otherwise.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bars import merge_latest


class Conflict(RuntimeError):
    """Another writer published the version first."""


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    periods: dict[int, str] = field(default_factory=dict)  # folder of each period
    batch: int | None = None  # the last batch of a stream that is in it

    def text(self) -> str:
        return json.dumps({"version": self.version, "batch": self.batch, "periods": {str(k): v for k, v in sorted(self.periods.items())}})

    @staticmethod
    def parsed(text: str) -> Manifest:
        d = json.loads(text)
        return Manifest(d["version"], {int(k): v for k, v in d["periods"].items()}, d["batch"])


def newest_wins(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return merge_latest([stored, fresh])


class VersionedTable:
    """Rows with a time ``ts`` in seconds, in periods of ``period`` seconds under ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, period: int = 86400) -> None:
        self.spark, self.path, self.period = spark, path.rstrip("/"), period
        self.schema = T.StructType.fromDDL(schema)
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda p: self._hadoop.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _name(self, version: int) -> str:
        return f"{self.path}/manifests/{version:010d}.json"

    def versions(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest manifest, or that of a version; before the first merge an empty one."""
        found = self.versions()
        if version is None and not found:
            return Manifest()
        stream = self._fs.open(self._at(self._name(found[-1] if version is None else version)))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest.parsed(text)

    def _publish(self, manifest: Manifest) -> None:
        """Give a manifest its name, which no file may have yet."""
        hidden = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(hidden, False)
        try:
            out.write(manifest.text().encode())
        finally:
            out.close()
        target = self._at(self._name(manifest.version))
        context = self._hadoop.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            context.rename(hidden, target, none)
        except Exception as error:
            self._fs.delete(hidden, False)
            if self._fs.exists(target):
                raise Conflict(f"version {manifest.version} is there already") from error
            raise

    # rows

    def _period(self):
        return F.floor(F.col("ts") / self.period)

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, start: int | None = None, stop: int | None = None, version: int | None = None) -> DataFrame:
        """Rows of one version; only folders of periods within the bounds (inclusive) are opened."""
        lo = start // self.period if start is not None else None
        hi = stop // self.period if stop is not None else None
        folders = [f for p, f in sorted(self.manifest(version).periods.items()) if (lo is None or p >= lo) and (hi is None or p <= hi)]
        df = self._rows(folders)
        df = df.where(F.col("ts") >= start) if start is not None else df
        return df.where(F.col("ts") <= stop) if stop is not None else df

    def merge(self, fresh: DataFrame, batch: int | None = None, combine: Callable[[DataFrame, DataFrame], DataFrame] = newest_wins, keep: int = 2) -> Manifest:
        """Merge rows into the periods they fall into, as one version.

        ``combine`` makes the new rows of these periods from what is stored of them and the fresh rows (by
        default newer bars win). A ``batch`` that the table has already is left out. Where
        another writer publishes first, the merge is done again on top of it. The last
        ``keep`` versions stay readable.
        """
        fresh = fresh.select(*self.schema.names)
        while True:
            now = self.manifest()
            if batch is not None and now.batch is not None and batch <= now.batch:
                return now
            touched = [r[0] for r in fresh.select(self._period().alias("p")).distinct().collect()]  # periods, not rows
            if not touched:
                return now
            stored = self._rows([now.periods[p] for p in touched if p in now.periods])
            name = f"data/{uuid.uuid4().hex}"
            made = combine(stored, fresh).select(*self.schema.names)
            made.withColumn("_period", self._period()).repartition("_period").write.partitionBy("_period").parquet(f"{self.path}/{name}")
            written = {int(n.partition("=")[2]): f"{name}/{n}" for n in (s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/{name}"))) if n.startswith("_period=")}
            emptied = {p for p in touched if p not in written}
            periods = {p: f for p, f in now.periods.items() if p not in emptied} | written
            after = Manifest(now.version + 1, periods, batch if batch is not None else now.batch)
            try:
                self._publish(after)
            except Conflict:
                self._fs.delete(self._at(f"{self.path}/{name}"), True)
                continue
            self.vacuum(keep)
            return after

    def vacuum(self, keep: int = 2) -> None:
        """Remove manifests older than the last ``keep`` versions, and folders that only they name."""
        found = self.versions()
        old, kept = found[:-keep], found[-keep:]
        if not old:
            return
        named = {f for v in kept for f in self.manifest(v).periods.values()}
        gone = {f for v in old for f in self.manifest(v).periods.values()} - named
        for f in gone:
            self._fs.delete(self._at(f"{self.path}/{f}"), True)
        for v in old:
            self._fs.delete(self._at(self._name(v)), False)
        for parent in {f.rpartition("/")[0] for f in gone} - {f.rpartition("/")[0] for f in named}:
            self._fs.delete(self._at(f"{self.path}/{parent}"), True)
