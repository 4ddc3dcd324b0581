"""The ledger of runs: what was asked, in which state, with which result.

One Parquet dataset; every change appends a row, and the latest row of a run is its
state. Inputs are canonical JSON, so equal requests are equal strings.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "run_id string, kind string, strategy string, symbols array<string>, inputs string, status string, statistics string, at double"


def canonical(symbols: list[str], inputs: dict) -> tuple[list[str], str]:
    return sorted(symbols), json.dumps(inputs, sort_keys=True, separators=(",", ":"))


class Ledger:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _append(self, *row) -> None:
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def start(self, kind: str, strategy: str, symbols: list[str], inputs: dict) -> str:
        names, text = canonical(symbols, inputs)
        run = uuid.uuid4().hex
        self._append(run, kind, strategy, names, text, "running", None, time.time())
        return run

    def finish(self, run: str, status: str = "completed", statistics: dict | None = None) -> None:
        now = self.latest().where(F.col("run_id") == run).first()
        self._append(run, now["kind"], now["strategy"], now["symbols"], now["inputs"], status, json.dumps(statistics) if statistics is not None else None, time.time())

    def latest(self) -> DataFrame:
        """The present state of every run."""
        values = [c.split()[0] for c in SCHEMA.split(", ")][1:]
        df = self.spark.read.schema(SCHEMA).parquet(self.path)
        return df.groupBy("run_id").agg(F.max_by(F.struct(*values), "at").alias("r")).select("run_id", "r.*")

    def listed(self, strategy: str | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
        """The newest runs, by strategy and status."""
        df = self.latest()
        df = df.where(F.col("strategy") == strategy) if strategy else df
        df = df.where(F.col("status") == status) if status else df
        return df.orderBy(F.desc("at")).limit(limit)

    def same(self, kind: str, strategy: str, symbols: list[str], inputs: dict) -> DataFrame:
        """Completed runs of the same request, whatever the order of its symbols and inputs."""
        names, text = canonical(symbols, inputs)
        wanted = F.array(*[F.lit(s) for s in names])
        return self.latest().where((F.col("kind") == kind) & (F.col("strategy") == strategy) & (F.col("status") == "completed") & F.col("symbols").eqNullSafe(wanted) & F.col("inputs").eqNullSafe(F.lit(text)))
