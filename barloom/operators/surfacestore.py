"""The open-cross surface kept up to date: stored counts of blocks, of which changed ones are counted anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import bucket
from ..sources.versions import Manifest, VersionedTable
from .opencross import SurfaceConfig, confidence, observations

COUNTS = "symbol string, ts long, bucket long, minutes_remaining long, samples long, crosses long"


class SurfaceStore:
    """Counts of each symbol, block, bucket and remaining time; a surface is their sum.

    A block's observations follow from its own bars alone, so new or changed bars touch only
    their blocks. Surfaces in units of volatility look further back and are not kept this way.
    """

    def __init__(self, spark: SparkSession, path: str, config: SurfaceConfig = SurfaceConfig(), period: int = 86400) -> None:
        if config.volatility_lookback is not None:
            raise ValueError("a surface in units of volatility does not follow from blocks alone")
        if period % (60 * config.block_minutes):
            raise ValueError("a period holds whole blocks")
        self.config, self.table = config, VersionedTable(spark, path, COUNTS, period)

    def update(self, bars: DataFrame, changed: DataFrame) -> Manifest:
        """Count the blocks anew that bars of ``changed`` (``symbol, ts``) fall into, from ``bars``, which has all bars of them.

        Removed bars are named like new ones. Only the time from the first to the last touched block is read.
        """
        start = bucket(F.col("ts"), 60 * self.config.block_minutes)
        touched = changed.select("symbol", start.alias("block")).distinct()
        span = touched.agg(F.min("block").alias("lo"), F.max("block").alias("hi")).first()
        if span["lo"] is None:
            return self.table.manifest()
        near = bars.where(F.col("ts").between(span["lo"], span["hi"] + 60 * self.config.block_minutes - 1))
        own = near.withColumn("block", start).join(touched, ["symbol", "block"], "left_semi").drop("block")
        seen = observations(own, self.config).groupBy("symbol", F.col("block").alias("ts"), F.col("bucket").cast("long").alias("bucket"), F.col("minutes_remaining").cast("long").alias("minutes_remaining"))
        fresh = seen.agg(F.count("*").alias("samples"), F.sum(F.col("crossed").cast("long")).alias("crosses"))
        marks = touched.select("symbol", F.col("block").alias("ts"), *[F.lit(None).cast("long").alias(c) for c in ("bucket", "minutes_remaining")], *[F.lit(0).cast("long").alias(c) for c in ("samples", "crosses")])
        return self.table.merge(fresh.unionByName(marks), combine=_replaced)

    def surface(self, start: int | None = None, stop: int | None = None) -> DataFrame:
        """The surface over all blocks, or those that begin within the bounds."""
        counted = self.table.read(start, stop).groupBy("bucket", "minutes_remaining").agg(F.sum("samples").alias("samples"), F.sum("crosses").alias("crosses"))
        return counted.withColumn("probability", F.col("crosses") / F.col("samples")).withColumn("confidence", confidence(F.col("samples"), self.config.min_samples))


def _replaced(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Blocks of ``fresh`` in place of the stored ones; rows without samples only name a block."""
    return stored.join(fresh.select("symbol", "ts").distinct(), ["symbol", "ts"], "left_anti").unionByName(fresh.where("samples > 0"))
