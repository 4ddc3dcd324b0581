"""Bar frames derived from tick-like tables.

A bar frame has ``symbol, ts`` (epoch seconds, UTC), ``open, high, low, close, volume``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str) -> Column:
    """Epoch seconds of a timestamp without time zone (UTC)."""
    return F.unix_seconds(F.col(column).cast("timestamp"))


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the epoch-aligned bucket that ``ts`` falls into."""
    return (F.floor(ts / seconds) * seconds).cast("long")


def order_key(ticks: DataFrame, order: list[str]) -> Column:
    """One value that orders like the columns.

    A single time or whole number has an aggregation buffer of fixed width, so Spark
    hashes; a struct of several makes it sort within tasks first.
    """
    if len(order) == 1:
        c, kind = F.col(order[0]), dict(ticks.dtypes)[order[0]]
        return F.unix_micros(c.cast("timestamp")) if kind.startswith("timestamp") else c
    return F.struct(*order)


def bars_from_ticks(ticks: DataFrame, seconds: int, order: list[str]) -> DataFrame:
    """Bars of ``seconds`` from ``symbol, ts, price, size``; ``order`` breaks ties within a bar.

    One aggregation with partial results: the first and last price are the price at the
    least and greatest order key, so nothing is sorted by time.
    """
    key = order_key(ticks, order)
    return (
        ticks.groupBy("symbol", bucket(F.col("ts"), seconds).alias("bar"))
        .agg(
            F.min_by("price", key).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", key).alias("close"),
            F.sum("size").cast("double").alias("volume"),
        )
        .select("symbol", F.col("bar").alias("ts"), "open", "high", "low", "close", "volume")
    )


def event_ticks(spark: SparkSession, sf_dir: str, pooled: bool = False) -> DataFrame:
    symbol = F.lit("ALL") if pooled else F.col("event_type")
    return table(spark, sf_dir, "events").select(symbol.alias("symbol"), epoch("ts").alias("ts"), F.col("ts").alias("at"), "event_id", F.col("value").alias("price"), F.lit(1.0).alias("size"))


def event_bars(spark: SparkSession, sf_dir: str, seconds: int = 3600, pooled: bool = False, unique_times: bool = True) -> DataFrame:
    """Bars of events, whose times are unique; else the event id breaks ties."""
    ticks = event_ticks(spark, sf_dir, pooled)
    return bars_from_ticks(ticks, seconds, ["at"] if unique_times else ["at", "event_id"])


def lineitem_bars(spark: SparkSession, sf_dir: str, seconds: int = 86400) -> DataFrame:
    """Daily bars per return flag; the tie-break makes the order total."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    ticks = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("symbol"), epoch("l_shipdate").alias("ts"), price.alias("price"), F.col("l_quantity").alias("size"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return bars_from_ticks(ticks, seconds, ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"])
