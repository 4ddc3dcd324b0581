"""Incremental variants as Structured Streaming queries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.bricks import BRICKS, NAMES, grid_bricks, lay_bricks
from ..sources.versions import VersionedTable


def open_bars(ticks: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Bars of a stream of ``symbol, at (timestamp), price, size``: open ones are updated, late ticks join theirs."""
    return (
        ticks.withWatermark("at", late)
        .groupBy(F.window("at", f"{seconds} seconds").alias("w"), "symbol")
        .agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("size").alias("volume"))
        .select("symbol", F.unix_seconds("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def sliding_means(ticks: DataFrame, length: str, step: str, late: str = "1 hour") -> DataFrame:
    """Mean price of sliding windows."""
    return ticks.withWatermark("at", late).groupBy(F.window("at", length, step).alias("w"), "symbol").agg(F.avg("price").alias("mean"), F.count("*").alias("ticks")).select("symbol", F.unix_seconds("w.start").alias("start"), F.unix_seconds("w.end").alias("stop"), "mean", "ticks")


def streamed_bricks(bars: DataFrame, size: float) -> DataFrame:
    """Renko bricks of a stream of bars; a symbol's first close, level and direction and its number of bricks are its state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values("ts", kind="stable")
        origin, level, way, seq = state.get if state.exists else (float(frame["close"].iat[0]), 0, 0, 0)
        rows = list(grid_bricks(frame if state.exists else frame.iloc[1:], origin, float(size), level, way, seq))
        for row in rows:
            way = 1 if row[6] > row[3] else -1
            level += way
        state.update((origin, level, way, seq + len(rows)))
        yield pd.DataFrame(rows, columns=NAMES)

    return bars.groupBy("symbol").applyInPandasWithState(step, BRICKS, "origin double, level long, way int, seq long", "append", GroupStateTimeout.NoTimeout)


def streamed_atr_bricks(bars: DataFrame, period: int = 14) -> DataFrame:
    """ATR-Renko bricks of a stream of bars, as of the whole series at once.

    A symbol's state is its last price and direction, the running true range, and the bars
    that wait for its first valid value (``period`` of them, unless prices stand still).
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = json.loads(state.get[0]) if state.exists else {"price": None, "way": 0, "before": None, "n": 0, "sum": 0.0, "atr": None, "first": None, "waiting": []}
        ready: list[tuple] = []
        for r in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples(index=False):
            if s["before"] is not None:
                span = max(r.high - r.low, abs(r.high - s["before"]), abs(r.low - s["before"]))
                s["n"] += 1
                if s["n"] <= period:
                    s["sum"] += span
                    s["atr"] = s["sum"] / period if s["n"] == period else None
                else:
                    s["atr"] += (span - s["atr"]) / period
            s["before"] = r.close
            bar = (int(r.ts), r.high, r.low, r.close, r.volume)
            if s["first"] is None and s["atr"]:
                s["first"] = s["atr"]
                ready += [(*b, s["first"]) for b in s["waiting"]]
                s["waiting"] = []
            if s["first"] is None:
                s["waiting"].append(bar)
            else:
                ready.append((*bar, s["atr"] or s["first"]))
        frame = pd.DataFrame(ready, columns=["ts", "high", "low", "close", "volume", "size"]).assign(symbol=key[0])
        if s["price"] is None and len(frame):
            s["price"], frame = float(frame["close"].iat[0]), frame.iloc[1:]
        rows = list(lay_bricks(frame, s["price"], s["way"]))
        if rows:
            s["price"], s["way"] = rows[-1][6], 1 if rows[-1][6] > rows[-1][3] else -1
        state.update((json.dumps(s),))
        yield pd.DataFrame(rows, columns=["symbol", "ts", "seq", "open", "high", "low", "close", "volume"])

    return bars.groupBy("symbol").applyInPandasWithState(step, BRICKS, "state string", "append", GroupStateTimeout.NoTimeout)


def streamed_heiken_ashi(bars: DataFrame) -> DataFrame:
    """Heiken-Ashi bars of a stream; the last smoothed bar of each symbol is its state, so any batching gives the same bars."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else None
        rows = []
        for r in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples(index=False):
            close = (r.open + r.high + r.low + r.close) / 4
            start = (r.open + r.close) / 2 if before is None else (before[0] + before[1]) / 2
            rows.append((r.symbol, r.ts, start, max(r.high, start, close), min(r.low, start, close), close, r.volume))
            before = (start, close)
        state.update(before)
        yield pd.DataFrame(rows, columns=["symbol", "ts", "open", "high", "low", "close", "volume"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts long, open double, high double, low double, close double, volume double", "open double, close double", "append", GroupStateTimeout.NoTimeout)


def trailing_stops(bars: DataFrame, percent: float) -> DataFrame:
    """Water mark and trailing level of each symbol as its bars arrive."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else float("-inf")
        rows = []
        for r in pd.concat(list(frames)).sort_values("ts", kind="stable").itertuples(index=False):
            mark = max(mark, r.high)
            level = mark * (1 - percent / 100)
            rows.append((r.symbol, r.ts, mark, level, r.close <= level))
        state.update((mark,))
        yield pd.DataFrame(rows, columns=["symbol", "ts", "mark", "level", "hit"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts long, mark double, level double, hit boolean", "mark double", "append", GroupStateTimeout.NoTimeout)


BARS = "symbol string, ts long, open double, high double, low double, close double, volume double"


def merge_into(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", period: int = 86400) -> StreamingQuery:
    """Keep a table of bars in which the newest version of a bar wins, in versions.

    Each batch writes the periods that its bars fall into and publishes a version; readers
    of an earlier one are not disturbed. A batch that is run again is left out.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            VersionedTable(batch.sparkSession, path, _ddl(batch), period).merge(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)


def merged(spark: SparkSession, path: str, schema: str = BARS, period: int = 86400) -> DataFrame:
    """The latest version of a table of :func:`merge_into`; empty if there is none."""
    return VersionedTable(spark, path, schema, period).read()
