"""Bars built by recursion: Heiken-Ashi, and Renko with fixed or range-sized bricks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.blocks import ROWS, carried, placed, with_halo
from ..functions.indicators import Spec, compute

BRICKS = "symbol string, ts long, seq int, open double, high double, low double, close double, volume double"


def heiken_ashi(bars: DataFrame, seconds: int | None = None) -> DataFrame:
    """One smoothed bar per bar. Only the open is recursive; the rest is columns.

    With ``seconds``, the usual distance of two bars of a symbol, the recursion runs in
    parallel over blocks of time; else it is one task per series.
    """
    close = (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4
    shaped = bars.select("symbol", "ts", "open", "high", "low", "close", "volume")

    def opens(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        out, c = np.empty(len(frame)), ((frame["open"] + frame["high"] + frame["low"] + frame["close"]) / 4).to_numpy()
        value = (frame["open"].iat[0] + frame["close"].iat[0]) / 2
        for i in range(len(frame)):
            out[i] = value
            value = (value + c[i]) / 2
        return frame.assign(ha_open=out)

    made = scan.heiken_ashi_open(shaped, seconds) if seconds else shaped.groupBy("symbol").applyInPandas(opens, "symbol string, ts long, open double, high double, low double, close double, volume double, ha_open double")
    made = made.withColumn("ha_close", close)
    return made.select("symbol", "ts", F.col("ha_open").alias("open"), F.greatest("high", "ha_open", "ha_close").alias("high"), F.least("low", "ha_open", "ha_close").alias("low"), F.col("ha_close").alias("close"), "volume")


def brick_steps(high: float, low: float, size: float, price: float, way: int) -> tuple[int, int]:
    """How many bricks a bar makes, and their direction; turning takes two bricks' worth."""
    up, down = int((high - price) // size), int((price - low) // size)
    if way >= 0:
        return (up, 1) if up >= 1 else (down, -1) if down >= 2 else (0, way)
    return (down, -1) if down >= 1 else (up, 1) if up >= 2 else (0, way)


def lay_bricks(frame: pd.DataFrame, price: float | None = None, way: int = 0) -> Iterator[tuple]:
    """Bricks of ordered bars with a ``size`` each; the first bar only sets the price."""
    seq = 0
    for row in frame.itertuples(index=False):
        if price is None:
            price = row.close
            continue
        n, turn = brick_steps(row.high, row.low, row.size, price, way)
        for _ in range(n):
            seq += 1
            after = price + turn * row.size
            yield row.symbol, row.ts, seq, price, max(price, after), min(price, after), after, row.volume / n
            price = after
        way = turn if n else way


def _bricks(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("ts", kind="stable")
    return pd.DataFrame(list(lay_bricks(frame)), columns=NAMES)


NAMES = ["symbol", "ts", "seq", "open", "high", "low", "close", "volume"]


def grid_bricks(frame: pd.DataFrame, origin: float, size: float, level: int = 0, way: int = 0, seq: int = 0) -> Iterator[tuple]:
    """Bricks of ordered bars; prices are ``origin + level * size``, so no rounding adds up."""
    for symbol, ts, high, low, volume in zip(frame["symbol"], frame["ts"], frame["high"], frame["low"], frame["volume"], strict=True):
        n, way = brick_steps(high, low, size, origin + level * size, way)
        for _ in range(n):
            a, z = origin + level * size, origin + (level + way) * size
            level, seq = level + way, seq + 1
            yield symbol, ts, seq, a, max(a, z), min(a, z), z, volume / n


def _grid(size: float):
    def bricks(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "high", "low", "close", "volume"], kind="stable")
        return pd.DataFrame(list(grid_bricks(frame.iloc[1:], frame["close"].iat[0], size)), columns=NAMES)

    return bricks


def _entries(high: float, low: float, origin: float, size: float) -> list[tuple[int, int]]:
    """Levels and directions among which are all that a bar can leave behind.

    A bar that makes bricks ends within one brick of the extreme it moved to; one that makes none
    was within two bricks of either extreme. Below an origin that no brick has left, the direction is 0.
    """
    ends = (int((low - origin) // size), int((high - origin) // size))
    levels = sorted({e + k for e in ends for k in range(-2, 4)})
    return [(0, 0), *[(level, way) for level in levels for way in (1, -1)]]


def _ends(frame: pd.DataFrame, entries: list[tuple[int, int]], origin: float, size: float) -> list[tuple[int, int, int]]:
    """Level, direction and number of bricks after the bars, from each entry. Entries that have met go on as one."""
    states = list(dict.fromkeys(entries))
    of, extra, made = [states.index(e) for e in entries], [0] * len(entries), [0] * len(states)
    for high, low in zip(frame["high"], frame["low"], strict=True):
        for i, (level, way) in enumerate(states):
            n, turn = brick_steps(high, low, size, origin + level * size, way)
            if n:
                states[i], made[i] = (level + n * turn, turn), made[i] + n
        if len(set(states)) < len(states):
            kept = list(dict.fromkeys(states))
            first = [states.index(k) for k in kept]
            extra = [x + made[o] - made[first[kept.index(states[o])]] for x, o in zip(extra, of, strict=True)]
            of, made, states = [kept.index(states[o]) for o in of], [made[i] for i in first], kept
    return [(*states[o], made[o] + x) for o, x in zip(of, extra, strict=True)]


def _renko_in_blocks(bars: DataFrame, size: float, seconds: int, rows: int) -> DataFrame:
    """Bricks of a fixed size, block by block.

    Prices stay on a grid from a symbol's first close. The bar before a block allows only a few
    levels and directions to enter it; the block is run from each of these, which soon run
    together, and what it makes of them is a small table. Tables are chained, and each block
    lays its bricks from its own entry.
    """
    shaped = bars.select("symbol", "ts", "open", "high", "low", "close", "volume")
    origins = shaped.groupBy("symbol").agg(F.min_by("close", F.struct("ts", "open", "high", "low", "close", "volume")).alias("_origin"))
    df = with_halo(placed(shaped, seconds, rows), 1, rows).join(origins, "symbol")

    def change(frame: pd.DataFrame, _: list) -> list[float]:
        """Entries with what they end in: level, direction, and bricks made."""
        own, origin = frame[~frame["_halo"]], frame["_origin"].iat[0]
        if len(own) < rows:
            return []
        if own["_place"].iat[0] == 0:
            own, entries = own.iloc[1:], [(0, 0)]
        else:
            before = frame[frame["_halo"]].iloc[-1]
            entries = _entries(before["high"], before["low"], origin, size)
        return [float(v) for entry, end in zip(entries, _ends(own, entries, origin, size), strict=True) for v in (*entry, *end)]

    def enter(blocks: list[int], maps: list) -> list[list[float]]:
        state, laid, out = (0.0, 0.0), 0.0, []
        for packed in maps:
            out.append([*state, laid])
            if len(packed):
                table = {tuple(packed[i : i + 2]): packed[i + 2 : i + 5] for i in range(0, len(packed), 5)}
                level, way, made = table[state]
                state, laid = (level, way), laid + made
        return out

    def replay(frame: pd.DataFrame, known: list) -> pd.DataFrame:
        own, origin = frame[~frame["_halo"]], frame["_origin"].iat[0]
        level, way, seq = map(int, known[0])
        return pd.DataFrame(list(grid_bricks(own.iloc[1:] if own["_place"].iat[0] == 0 else own, origin, size, level, way, seq)), columns=NAMES)

    return carried(df, [(change, enter)], replay, BRICKS)


def renko(bars: DataFrame, size: float, seconds: int | None = None, rows: int = ROWS) -> DataFrame:
    """Bricks of a fixed size; several may share a bar's time and split its volume.

    With ``seconds``, the usual distance of two bars of a symbol, blocks of ``rows`` bars run in
    parallel; else a series is one task. Prices are multiples of the size from the first close.
    """
    if size <= 0:
        raise ValueError("a brick has a positive size")
    if seconds:
        return _renko_in_blocks(bars, float(size), seconds, rows)
    return bars.select("symbol", "ts", "high", "low", "close", "volume").groupBy("symbol").applyInPandas(_grid(float(size)), BRICKS)


def atr_renko(bars: DataFrame, period: int = 14, seconds: int | None = None) -> DataFrame:
    """Bricks as large as the average true range of their bar; before it is known, as its first valid value."""
    ranged = compute(bars, [Spec("atr", {"period": period})], seconds=seconds)
    valid = F.when(F.col("atr") > 0, F.col("atr"))
    first = ranged.where(valid.isNotNull()).groupBy("symbol").agg(F.min_by("atr", "ts").alias("_first"))
    sized = ranged.join(first, "symbol").select("symbol", "ts", "high", "low", "close", "volume", F.coalesce(valid, F.col("_first")).alias("size"))
    return sized.groupBy("symbol").applyInPandas(_bricks, BRICKS)


def resolve_kind(kind: str, size: float | None = None, period: int | None = None) -> tuple[str, dict]:
    """The kind of bars that is meant, and its options; a Renko request with a range period and no size is ATR-Renko."""
    if kind == "renko" and size is None and period is not None:
        kind = "atr_renko"
    if kind == "renko" and not (size and size > 0):
        raise ValueError("Renko bars need a positive brick size")
    if kind == "atr_renko" and not (period and period > 0):
        raise ValueError("ATR-Renko bars need a positive period")
    if kind not in ("ohlcv", "heikenashi", "renko", "atr_renko"):
        raise ValueError(f"no bars of kind {kind}")
    return kind, {"renko": {"size": size}, "atr_renko": {"period": period}}.get(kind, {})
