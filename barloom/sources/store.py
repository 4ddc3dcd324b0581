"""The bar store: one Parquet dataset, partitioned by series."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bars import TIMEFRAMES, catalogue, merge_latest, missing_ranges, sanitise_symbol

PARTITIONS = ["exchange", "symbol", "timeframe", "data_type"]
SCHEMA = "ts long, open double, high double, low double, close double, volume double, exchange string, symbol string, timeframe string, data_type string"


class BarStore:
    """Bars under ``exchange/symbol/timeframe/data_type``; writes replace whole partitions through Spark's commit protocol."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def write(self, bars: DataFrame, exchange: str, timeframe: str, data_type: str = "ohlcv") -> None:
        """Replace the partitions of the bars' symbols."""
        if timeframe not in TIMEFRAMES:
            raise ValueError(f"no timeframe {timeframe}")
        shaped = bars.select("ts", "open", "high", "low", "close", "volume", F.lit(exchange).alias("exchange"), sanitise_symbol(F.col("symbol")).alias("symbol"), F.lit(timeframe).alias("timeframe"), F.lit(data_type).alias("data_type"))
        shaped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(self.path)

    def read(self, exchange: str | None = None, symbol: str | None = None, timeframe: str | None = None, data_type: str | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
        """Bars of some series; partition filters prune folders, the time filter row groups. Bounds are inclusive."""
        df = self.spark.read.schema(SCHEMA).parquet(self.path)
        for name, value in (("exchange", exchange), ("symbol", symbol), ("timeframe", timeframe), ("data_type", data_type)):
            df = df.where(F.col(name) == value) if value is not None else df
        df = df.where(F.col("ts") >= start) if start is not None else df
        return df.where(F.col("ts") <= stop) if stop is not None else df

    def merge(self, bars: DataFrame, exchange: str, timeframe: str, data_type: str = "ohlcv") -> None:
        """Add bars; where one is there already, the new one wins. The result is staged before partitions are replaced."""
        columns = ["symbol", "ts", "open", "high", "low", "close", "volume"]
        fresh = bars.withColumn("symbol", sanitise_symbol(F.col("symbol"))).select(*columns)
        kept = self.read(exchange, None, timeframe, data_type).select(*columns).join(fresh.select("symbol").distinct(), "symbol", "left_semi")
        staged = f"{self.path}_staged_{uuid.uuid4().hex}"  # merges that run together do not meet
        merge_latest([kept, fresh]).select(*columns).write.parquet(staged)
        self.write(self.spark.read.parquet(staged), exchange, timeframe, data_type)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(staged)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def catalogue(self) -> DataFrame:
        return catalogue(self.read(), tuple(PARTITIONS))

    def save_catalogue(self) -> DataFrame:
        """Write what :meth:`catalogue` finds beside the bars, for readers that want no scan."""
        found = self.catalogue()
        found.write.mode("overwrite").parquet(f"{self.path}_catalogue")
        return self.saved_catalogue()

    def saved_catalogue(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}_catalogue")

    def repair(self, dry_run: bool = False) -> DataFrame:
        """Series whose saved record count differs from the bars', with both; unless ``dry_run`` the catalogue is written anew."""
        saved = self.saved_catalogue().select(*PARTITIONS, F.col("records").alias("saved"))
        counted = self.read().groupBy(*PARTITIONS).agg(F.count("*").alias("records"))  # counts come from the footers
        wrong = saved.join(counted, PARTITIONS, "full").where(~F.col("saved").eqNullSafe(F.col("records")))
        rows = self.spark.createDataFrame(wrong.select(*PARTITIONS, "saved", "records").collect(), ", ".join(f"{p} string" for p in PARTITIONS) + ", saved long, records long")  # a row per wrong series
        if not dry_run:
            self.save_catalogue()
        return rows

    def missing(self, exchange: str, timeframe: str, start: int, stop: int) -> DataFrame:
        return missing_ranges(self.read(exchange, None, timeframe, "ohlcv"), TIMEFRAMES[timeframe], start, stop)

    def derived(self) -> DataFrame:
        """Data types that exist beside plain bars."""
        return self.read().where("data_type <> 'ohlcv'").select(*PARTITIONS).distinct()

    def delete(self, exchange: str, symbol: str, timeframe: str) -> None:
        """Drop a series, with all its data types."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/exchange={exchange}/symbol={symbol}/timeframe={timeframe}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, or under the warehouse of a session that runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/barloom-{label}-{uuid.uuid4().hex}"
