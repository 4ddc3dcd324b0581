"""Headline queries, timed; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query runs once
to warm up and then counts by the best of two runs into a sink that keeps nothing.
``opencross_500k`` is the published target: half a million one-minute bars of a random
walk, 15-minute blocks, buckets of 0.001, in under 3 seconds; ``scaling`` compares it
with a tenth of the bars. ``scales`` has more sizes, the run in units of volatility
(look-back 20, 100 000 bars), and ``host``, the seconds of a fixed loop in Python, which tells how fast the
machine was; none of these counts in the total.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))

QUERIES = [
    "bars_events_1h", "bars_lineitem_1d", "ind_overlap", "ind_statistics", "ind_recursive_all", "candles_basic", "conditions", "heiken_ashi", "renko",
    "opencross_surface", "calibration", "cross_period", "signal_evaluation", "trade_statistics", "drawdowns", "backtest_statistics", "optimise_grid", "monte_carlo",
]


def walk_bars(spark, n: int):
    """One-minute bars of a random walk: steps are hashes of the minute, summed in chunks of a day and over days."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    day = F.floor(F.col("id") / 1440)
    step = (F.pmod(F.xxhash64("id"), F.lit(2001)) - 1000) / 1e6
    base = spark.range(n).select("id", day.alias("day"), step.alias("step"))
    inside = Window.partitionBy("day").orderBy("id")
    days = base.groupBy("day").agg(F.sum("step").alias("s"))
    before = days.withColumn("carry", F.coalesce(F.sum("s").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("day", "carry")
    level = F.exp(F.col("carry") + F.sum("step").over(inside)) * 100
    out = base.join(before, "day").withColumn("close", level)
    opened = F.coalesce(F.lag("close").over(inside), F.col("close"))
    return out.withColumn("open", opened).select(
        F.lit("A").alias("symbol"), (F.col("id") * 60).alias("ts"), "open", (F.greatest("open", "close") * 1.0004).alias("high"), (F.least("open", "close") * 0.9996).alias("low"), "close", F.lit(1.0).alias("volume")
    )


def timed(df_of, runs: int = 2) -> float:
    best = float("inf")
    for i in range(runs + 1):
        start = time.perf_counter()
        df_of().write.format("noop").mode("overwrite").save()
        if i:
            best = min(best, time.perf_counter() - start)
    return round(best, 3)


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from barloom import registry
    from barloom.operators.opencross import SurfaceConfig, surface
    from barloom.plans.validation import with_volatility

    own, times = registry.queries(), {}
    for name in QUERIES:
        times[name] = timed(lambda n=name: own[n](spark, SF_DIR))
    sizes = {}
    for n in (50_000, 500_000):
        bars = walk_bars(spark, n).persist()
        bars.count()
        sizes[n] = timed(lambda b=bars: surface(b, SurfaceConfig(15, 0.001)), 3)
        bars.unpersist()
    times["opencross_50k"], times["opencross_500k"] = sizes[50_000], sizes[500_000]
    rate = round(500_000 / sizes[500_000])
    scales = {}
    for n in (10_000, 100_000, 250_000):
        bars = walk_bars(spark, n).persist()
        bars.count()
        scales[f"opencross_{n // 1000}k"] = timed(lambda b=bars: surface(b, SurfaceConfig(15, 0.001)))
        if n == 100_000:
            scales["opencross_normalised_100k"] = timed(lambda b=bars: surface(with_volatility(b, 20, 60), SurfaceConfig(15, 0.1, volatility_lookback=20)))
        bars.unpersist()
    start = time.perf_counter()
    sum(i * i for i in range(5_000_000))
    scales["host"] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")), "opencross_records_per_sec": rate, "scaling": round(sizes[500_000] / sizes[50_000], 2), "scales": scales}))


if __name__ == "__main__":
    main()
