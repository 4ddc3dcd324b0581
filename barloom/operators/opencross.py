"""The open-cross probability surface.

For a bar of a block: how often, from its distance to the block's open and with so many
bars remaining, does a later bar of the block cross the open?
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import bucket


@dataclass(frozen=True)
class SurfaceConfig:
    block_minutes: int = 15
    bucket_size: float = 0.001
    min_samples: int = 100
    symmetric: bool = False
    volatility_lookback: int | None = None  # None: relative distance; else in units of volatility

    def __post_init__(self) -> None:
        if self.block_minutes < 2 or self.bucket_size <= 0:
            raise ValueError("a block has two minutes at least, a bucket a positive size")


def blocks(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars with the block's open, the bars remaining and the extremes of later bars.

    The extremes run over the reversed order with a growing frame, which is linear.
    """
    b = bars.withColumn("block", bucket(F.col("ts"), 60 * minutes))
    forward = Window.partitionBy("symbol", "block").orderBy("ts")
    later = Window.partitionBy("symbol", "block").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, -1)
    whole = forward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return b.select(
        "*",
        F.first("open").over(whole).alias("block_open"),
        (F.count("*").over(whole) - F.row_number().over(forward)).alias("minutes_remaining"),
        F.min("low").over(later).alias("future_low"),
        F.max("high").over(later).alias("future_high"),
    )


def bucket_index(distance: Column, size: float, symmetric: bool) -> Column:
    """Bucket as a whole number, so that no key is a float; symmetric buckets fold by absolute value."""
    index = F.floor(distance / size)
    return F.abs(index) if symmetric else index


def observations(bars: DataFrame, config: SurfaceConfig) -> DataFrame:
    """``symbol, ts, block, bucket, minutes_remaining, crossed`` of every bar but a block's last."""
    b = blocks(bars, config.block_minutes).where("minutes_remaining > 0 and block_open <> 0")
    raw = F.col("close") - F.col("block_open")
    if config.volatility_lookback is None:
        distance = raw / F.col("block_open")
    else:
        scale = F.greatest(F.col("volatility") * F.sqrt(F.greatest("minutes_remaining", F.lit(1))), F.lit(0.001))
        b = b.where("close > 0 and block_open > 0")
        distance = F.log(F.col("close") / F.col("block_open")) / scale
    crossed = F.when(F.abs(raw) < 1e-7, False).when(raw > 0, F.col("future_low") < F.col("block_open")).otherwise(F.col("future_high") > F.col("block_open"))
    return b.select("symbol", "ts", "block", "close", "block_open", "minutes_remaining", distance.alias("distance"), crossed.alias("crossed")).withColumn("bucket", bucket_index(F.col("distance"), config.bucket_size, config.symmetric))


def confidence(samples: Column, min_samples: int) -> Column:
    return F.when(samples >= min_samples, "high").when(samples >= 30, "medium").otherwise("low")


def surface_of(seen: DataFrame, min_samples: int = 100, keys: tuple[str, ...] = ()) -> DataFrame:
    """Samples, crosses, probability and confidence of each bucket and remaining time."""
    counted = seen.groupBy(*keys, "bucket", "minutes_remaining").agg(F.count("*").alias("samples"), F.sum(F.col("crossed").cast("long")).alias("crosses"))
    return counted.withColumn("probability", F.col("crosses") / F.col("samples")).withColumn("confidence", confidence(F.col("samples"), min_samples))


def surface(bars: DataFrame, config: SurfaceConfig = SurfaceConfig()) -> DataFrame:
    return surface_of(observations(bars, config), config.min_samples)


def ordered(points: DataFrame) -> DataFrame:
    """Nearest bucket first, most time first."""
    return points.orderBy(F.asc("bucket"), F.desc("minutes_remaining"))


def overall(points: DataFrame) -> DataFrame:
    total, crosses = F.sum("samples"), F.sum("crosses")
    return points.agg(total.alias("samples"), crosses.alias("crosses"), (crosses / total).alias("cross_rate"), F.count_distinct("bucket").alias("buckets"), F.count("*").alias("cells"))


def extremes(points: DataFrame) -> DataFrame:
    """The most and the least probable cell; the first in surface order among equals."""
    cell = F.struct("bucket", "minutes_remaining", "probability", "samples")
    rank = F.struct("probability", -F.col("bucket"), F.col("minutes_remaining"))
    least = F.struct("probability", F.col("bucket"), -F.col("minutes_remaining"))
    picked = points.agg(F.max_by(cell, rank).alias("highest"), F.min_by(cell, least).alias("lowest"))
    return picked.select(F.explode(F.array(F.struct(F.lit("highest").alias("which"), F.col("highest").alias("c")), F.struct(F.lit("lowest").alias("which"), F.col("lowest").alias("c")))).alias("e")).select("e.which", "e.c.*")


def cross_section(points: DataFrame, minutes_remaining: int) -> DataFrame:
    return points.where(F.col("minutes_remaining") == minutes_remaining)


def heatmap(points: DataFrame, block_minutes: int) -> DataFrame:
    """One row per bucket and one column per remaining time."""
    return points.groupBy("bucket").pivot("minutes_remaining", list(range(1, block_minutes))).agg(F.first("probability"))


def trimmed(points: DataFrame, least: float = 0.001, margin: int = 5) -> DataFrame:
    """Cells up to a margin beyond the furthest bucket that is ever crossed."""
    furthest = points.where(F.col("probability") > least).agg(F.coalesce(F.max(F.abs("bucket")), F.lit(0)).alias("_far"))
    return points.join(F.broadcast(furthest), F.abs("bucket") <= F.col("_far") + margin).drop("_far")


def time_decay(points: DataFrame) -> DataFrame:
    """Buckets of high confidence with three points at least: does the probability mostly fall as time runs out?"""
    w = Window.partitionBy("bucket").orderBy(F.desc("minutes_remaining"))
    steps = points.where("confidence = 'high'").withColumn("before", F.lag("probability").over(w))
    falls = steps.groupBy("bucket").agg(F.count("*").alias("points"), F.sum((F.col("probability") < F.col("before")).cast("long")).alias("falls"), F.count("before").alias("steps")).where("points >= 3")
    return falls.withColumn("decays", F.col("falls") * 2 > F.col("steps"))
