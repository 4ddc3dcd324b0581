"""Building, resampling, merging and inspecting bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import bucket

# Names of timeframes and their seconds; a month counts as 30 days.
TIMEFRAMES = {
    "1s": 1, "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200,
    "4h": 14400, "6h": 21600, "12h": 43200, "1d": 86400, "3d": 259200, "1w": 604800, "1M": 2592000,
}


def check_ratio(source: int, target: int) -> int:
    """How many source bars make a target bar; the target must be a larger multiple."""
    if target <= source or target % source:
        raise ValueError(f"{target} s bars cannot be built from {source} s bars")
    return target // source


def _ohlcv() -> list[Column]:
    return [
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    ]


def aggregate(bars: DataFrame, seconds: int) -> DataFrame:
    """Epoch-aligned bars; buckets without source bars do not appear."""
    return bars.groupBy("symbol", bucket(F.col("ts"), seconds).alias("bar")).agg(*_ohlcv()).select("symbol", F.col("bar").alias("ts"), "open", "high", "low", "close", "volume")


def calendar_start(ts: Column, timeframe: str) -> Column:
    """Start of the calendar period: ISO week, month, day (also for 3d), or the epoch bucket of shorter frames."""
    at = F.timestamp_seconds(ts)
    if timeframe in ("1d", "3d"):
        return F.unix_seconds(F.date_trunc("DAY", at))
    if timeframe == "1w":
        return F.unix_seconds(F.date_trunc("WEEK", at))
    if timeframe == "1M":
        return F.unix_seconds(F.date_trunc("MONTH", at))
    return bucket(ts, TIMEFRAMES[timeframe])


def resample(bars: DataFrame, timeframe: str) -> DataFrame:
    """Calendar-aligned bars."""
    return bars.groupBy("symbol", calendar_start(F.col("ts"), timeframe).alias("bar")).agg(*_ohlcv()).select("symbol", F.col("bar").alias("ts"), "open", "high", "low", "close", "volume")


def bundle(bars: DataFrame, base: str, timeframes: list[str]) -> DataFrame:
    """The base bars and each higher timeframe in one frame, told apart by ``timeframe``."""
    out = bars.withColumn("timeframe", F.lit(base))
    for t in timeframes:
        out = out.unionByName(resample(bars, t).withColumn("timeframe", F.lit(t)))
    return out


def as_of_higher(bars: DataFrame, higher: DataFrame, seconds: int, columns: list[str], block_bars: int = 512) -> DataFrame:
    """Each bar with the columns of the last *closed* higher bar (prefix ``h_``).

    Time is cut into blocks of ``block_bars`` higher bars. Within a block one running window fills
    bars from the higher bars that close in it; what closed before a block is one carried row.
    """
    block = F.floor(F.col("ts") / (seconds * block_bars)).alias("_block")
    closed = higher.select("symbol", (F.col("ts") + seconds).alias("ts"), F.lit(0).alias("_own"), F.struct(*columns).alias("_h"))
    own = bars.select("symbol", "ts", F.lit(1).alias("_own"), F.lit(None).cast(closed.schema["_h"].dataType).alias("_h"), F.struct(*[c for c in bars.columns if c not in ("symbol", "ts")]).alias("_b"))
    both = closed.withColumn("_b", F.lit(None).cast(own.schema["_b"].dataType)).unionByName(own).select("*", block)
    ends = both.groupBy("symbol", "_block").agg(F.max_by("_h", F.when(F.col("_own") == 0, F.col("ts"))).alias("_end"))
    earlier = Window.partitionBy("symbol").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("symbol", "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    seen = Window.partitionBy("symbol", "_block").orderBy("ts", "_own").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_h", F.last("_h", ignorenulls=True).over(seen)).where("_own = 1").join(carry, ["symbol", "_block"])
    return filled.withColumn("_h", F.coalesce("_h", "_carry")).select("symbol", "ts", "_b.*", *[F.col(f"_h.{c}").alias(f"h_{c}") for c in columns])


def merge_latest(sources: list[DataFrame]) -> DataFrame:
    """Union in which the later source wins where bars share symbol and time.

    ``max_by`` over a source rank combines before the shuffle; no sort, no window.
    """
    ranked = None
    for rank, df in enumerate(sources):
        one = df.withColumn("_rank", F.lit(rank))
        ranked = one if ranked is None else ranked.unionByName(one)
    values = [c for c in sources[0].columns if c not in ("symbol", "ts")]
    return ranked.groupBy("symbol", "ts").agg(F.max_by(F.struct(*values), "_rank").alias("v")).select("symbol", "ts", "v.*")


def upsert_open_bar(stored: DataFrame, source: DataFrame, seconds: int, changed: DataFrame | None = None) -> DataFrame:
    """Incremental aggregation: from the last stored bar on, bars are rebuilt from the source.

    ``changed`` (source bars that are new) moves the start back to the bar that the
    earliest of them falls into.
    """
    since = stored.groupBy("symbol").agg(F.max("ts").alias("since"))
    if changed is not None:
        touched = changed.groupBy("symbol").agg(bucket(F.min("ts"), seconds).alias("touched"))
        since = since.join(touched, "symbol", "left").select("symbol", F.least("since", "touched").alias("since"))
    fresh = source.join(since, "symbol", "left").where(F.col("since").isNull() | (F.col("ts") >= F.col("since"))).drop("since")
    return merge_latest([stored, aggregate(fresh, seconds).select(*stored.columns)])


def catalogue(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """First and last time and count of each series."""
    return bars.groupBy(*keys).agg(F.count("*").alias("records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min_by("close", "ts").alias("first_close"), F.max_by("close", "ts").alias("last_close"))


def head_and_tail(bars: DataFrame, n: int = 5) -> DataFrame:
    """The first and last ``n`` bars of each series, with their place from either end."""
    up = Window.partitionBy("symbol").orderBy("ts")
    down = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return bars.withColumn("from_start", F.row_number().over(up)).withColumn("from_end", F.row_number().over(down)).where((F.col("from_start") <= n) | (F.col("from_end") <= n))


def by_ordinal(bars: DataFrame, start: int, length: int) -> DataFrame:
    """Bars ``start`` to ``start + length - 1``, counted from 0."""
    w = Window.partitionBy("symbol").orderBy("ts")
    return bars.withColumn("ordinal", F.row_number().over(w) - 1).where(F.col("ordinal").between(start, start + length - 1))


def irregularities(bars: DataFrame, seconds: int, order: str = "ts") -> DataFrame:
    """Rows whose distance to the one before (in ingestion order) is not the interval."""
    w = Window.partitionBy("symbol").orderBy(order)
    diff = F.col("ts") - F.lag("ts").over(w)
    kind = F.when(F.col("diff") == 0, "duplicate").when(F.col("diff") < 0, "out_of_order").when(F.col("diff") != seconds, "gap")
    return bars.select("symbol", "ts", F.lag("ts").over(w).alias("previous_ts"), diff.alias("diff")).withColumn("kind", kind).where("kind is not null")


def monthly_gaps(bars: DataFrame) -> DataFrame:
    """Months without a bar between the first and the last, for monthly series."""
    w = Window.partitionBy("symbol").orderBy("month")
    months = bars.select("symbol", F.trunc(F.timestamp_seconds("ts").cast("date"), "MM").alias("month")).distinct()
    return months.withColumn("expected", F.add_months(F.lag("month").over(w), 1)).where("month > expected").select("symbol", "expected", "month")


def coalesce_intervals(intervals: DataFrame, slack: int = 1) -> DataFrame:
    """Union of ``[start, stop]`` ranges per symbol; ranges up to ``slack`` apart are joined."""
    w = Window.partitionBy("symbol").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", F.coalesce((F.col("start") > reach + slack).cast("int"), F.lit(1)))
    grouped = marked.withColumn("_group", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("symbol", "_group").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_group")


def missing_ranges(bars: DataFrame, seconds: int, start: int, stop: int) -> DataFrame:
    """What a download of ``[start, stop]`` would still need: before, between and after the bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    inner = bars.withColumn("previous", F.lag("ts").over(w)).where(F.col("ts") - F.col("previous") > seconds).select("symbol", (F.col("previous") + seconds).alias("start"), (F.col("ts") - 1).alias("stop"))
    edges = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    before = edges.select("symbol", F.lit(start).cast("long").alias("start"), (F.col("a") - 1).alias("stop"))
    after = edges.select("symbol", (F.col("b") + seconds).alias("start"), F.lit(stop).cast("long").alias("stop"))
    clipped = inner.unionAll(before).unionAll(after).select("symbol", F.greatest("start", F.lit(start)).cast("long").alias("start"), F.least("stop", F.lit(stop)).cast("long").alias("stop")).where("start <= stop")
    return coalesce_intervals(clipped)


def coarsest_source(available: list[str], target: str) -> str | None:
    """The coarsest shorter timeframe that divides the target."""
    fits = [t for t in available if TIMEFRAMES[t] < TIMEFRAMES[target] and TIMEFRAMES[target] % TIMEFRAMES[t] == 0]
    return max(fits, key=TIMEFRAMES.get, default=None)


def sanitise_symbol(symbol: Column) -> Column:
    """Upper-case base and quote joined by an underscore."""
    return F.upper(F.regexp_replace(symbol, r"[^A-Za-z0-9]+", "_"))
