"""Linear recursions over long series, in parallel over blocks of time.

``y_t = decay * y_(t-1) + x_t`` is an affine map, and maps compose: each block of a
series is solved alone from zero, by window functions; the ends of blocks, one row per
block, are chained; and every row adds what was carried into its block. So one endless
series is as many tasks as it has blocks, and only the chain is sequential.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import placed

#: Weights within a block stay under ten to this power.
MOST_EXPONENT = 200


def block_rows(decay: float, wanted: int = 4096) -> int:
    """Rows of a block at most, so that ``decay ** -rows`` stays representable."""
    return max(2, min(wanted, int(MOST_EXPONENT / math.log10(1 / decay)))) if 0 < decay < 1 else wanted


def recursions(df: DataFrame, parts: dict[str, tuple[Column, float]]) -> DataFrame:
    """``df`` (from :func:`placed`) with a column per part (value and decay): its recursion from zero before the series.

    All parts share the windows, the chain of block ends and the one join.
    """
    w = Window.partitionBy("symbol", "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    power = lambda decay, e: F.pow(F.lit(float(decay)), e)
    local = df.withColumns({f"_local_{n}": F.sum(x * power(decay, -F.col("_i"))).over(w) * power(decay, F.col("_i")) for n, (x, decay) in parts.items()})
    ends = local.groupBy("symbol", "_block").agg(F.count("*").alias("_n"), *[F.max_by(f"_local_{n}", "_i").alias(f"_end_{n}") for n in parts])
    decays = {n: decay for n, (_, decay) in parts.items()}

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_block")
        out = frame[["symbol", "_block"]].copy()
        for n, decay in decays.items():
            carry, carried = 0.0, []
            for end, rows in zip(frame[f"_end_{n}"], frame["_n"], strict=True):
                carried.append(carry)
                carry = end + decay**rows * carry
            out[f"_carry_{n}"] = carried
        return out

    carried = ends.groupBy("symbol").applyInPandas(chain, "symbol string, _block long, " + ", ".join(f"_carry_{n} double" for n in parts))
    joined = local.join(carried, ["symbol", "_block"])
    out = joined.withColumns({n: F.col(f"_local_{n}") + power(decay, F.col("_i") + 1) * F.col(f"_carry_{n}") for n, decay in decays.items()})
    return out.drop(*[f"_{kind}_{n}" for kind in ("local", "carry") for n in parts])


def smoothed(df: DataFrame, means: dict[str, tuple[str, float, int, int]]) -> DataFrame:
    """A column per mean (source, alpha, first, n): ``y += alpha * (x - y)``, seeded by the mean of
    ``n`` values from place ``first`` on; null before."""
    place = F.col("_place")
    first = {n: (place >= a) & (place < a + k) for n, (_, _, a, k) in means.items()}
    seeds = df.where(place < max(a + k for _, _, a, k in means.values())).groupBy("symbol").agg(*[F.when(F.count_if(first[n]) == k, F.avg(F.when(first[n], F.col(x)))).alias(f"_seed_{n}") for n, (x, _, _, k) in means.items()])
    parts = {}
    for n, (x, alpha, a, k) in means.items():
        at = a + k - 1
        parts[n] = F.when(place < at, 0.0).when(place == at, F.col(f"_seed_{n}")).otherwise(alpha * F.col(x)), 1 - alpha
    out = recursions(df.join(seeds, "symbol", "left"), parts)  # a series has one row of seeds
    return out.withColumns({n: F.when(place >= a + k - 1, F.col(n)) for n, (_, _, a, k) in means.items()}).drop(*[f"_seed_{n}" for n in means])


def _with_before(df: DataFrame, column: str, name: str) -> DataFrame:
    """The value of the bar before; a block's first bar has the last value of the block before."""
    last = df.groupBy("symbol", "_block").agg(F.max_by(column, "_i").alias("_last"))
    before = last.withColumn("_prior", F.lag("_last").over(Window.partitionBy("symbol").orderBy("_block"))).drop("_last")
    own = Window.partitionBy("symbol", "_block").orderBy("_i")
    return df.join(before, ["symbol", "_block"]).withColumn(name, F.coalesce(F.lag(column).over(own), F.col("_prior"))).drop("_prior")


@dataclass(frozen=True)
class Scanned:
    """An indicator in blocks: its means of columns of the bars, and its value of them."""

    means: Callable[[str, int], dict[str, tuple[str, float, int, int]]]
    value: Callable[[str], Column]
    period: int = 14


def _wilder(*sources: str) -> Callable[[str, int], dict[str, tuple[str, float, int, int]]]:
    return lambda name, n: {f"{name}{x}": (x, 1 / n, 1, n) for x in sources}


def _balance(sign: int) -> Callable[[str], Column]:
    def value(name: str) -> Column:
        gain, loss = F.col(f"{name}_up"), F.col(f"{name}_down")
        part = gain if sign > 0 else gain - loss
        return F.when(gain + loss == 0, 0.0).otherwise(100 * part / (gain + loss))

    return value


def _share(name: str) -> Column:
    r = F.col(f"{name}_tr")
    return F.when(F.col("close") != 0, r / F.col("close") * 100).when(r.isNotNull(), 0.0)


#: Indicators that run in parallel over blocks of time.
SCANNED: dict[str, Scanned] = {
    "ema": Scanned(lambda name, n: {f"{name}_e": ("close", 2 / (n + 1), 0, n)}, lambda name: F.col(f"{name}_e"), 30),
    "rsi": Scanned(_wilder("_up", "_down"), _balance(1)),
    "cmo": Scanned(_wilder("_up", "_down"), _balance(-1)),
    "atr": Scanned(_wilder("_tr"), lambda name: F.col(f"{name}_tr")),
    "natr": Scanned(_wilder("_tr"), _share),
}


def indicators(bars: DataFrame, wanted: list[tuple[str, str, int | None]], seconds: int, rows: int = 4096) -> DataFrame:
    """Bars with indicators (kind, name, period), as the kernels of the same kinds, in one pass over blocks."""
    means = {}
    for kind, name, period in wanted:
        means |= SCANNED[kind].means(f"_{name}", period or SCANNED[kind].period)
    df = _with_before(placed(bars, seconds, min(block_rows(1 - alpha, rows) for _, alpha, _, _ in means.values())), "close", "_before")
    change, before = F.col("close") - F.col("_before"), F.col("_before")
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    df = df.withColumns({"_tr": true_range, "_up": F.greatest(change, F.lit(0.0)), "_down": F.greatest(-change, F.lit(0.0))})
    return smoothed(df, means).select(*bars.columns, *[SCANNED[kind].value(f"_{name}").alias(name) for kind, name, _ in wanted])


def ema(bars: DataFrame, period: int, seconds: int, rows: int = 4096) -> DataFrame:
    return indicators(bars, [("ema", "ema", period)], seconds, rows)


def atr(bars: DataFrame, period: int, seconds: int, rows: int = 4096) -> DataFrame:
    return indicators(bars, [("atr", "atr", period)], seconds, rows)


def heiken_ashi_open(bars: DataFrame, seconds: int, rows: int = 4096) -> DataFrame:
    """``ha_open`` of each bar: half of the open and of the smoothed close before it, carried on."""
    df = placed(bars, seconds, block_rows(0.5, rows)).withColumn("_hc", (F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4)
    df = _with_before(df, "_hc", "_prior_close")
    x = F.when(F.col("_place") == 0, (F.col("open") + F.col("close")) / 2).otherwise(F.col("_prior_close") / 2)
    return recursions(df, {"ha_open": (x, 0.5)}).select(*bars.columns, "ha_open")


def ewma_volatility(bars: DataFrame, lookback: int, seconds: int, rows: int = 4096) -> DataFrame:
    """Bars with ``volatility``, as the kernel of the same name: the sample deviation of log returns
    so far, and from ``lookback`` returns on an exponential mean of their squares."""
    alpha = 2 / (lookback + 1)
    df = placed(bars, seconds, block_rows(1 - alpha, rows))
    df = _with_before(df, "close", "_before")
    df = df.withColumn("_r", F.when((F.col("close") > 0) & (F.col("_before") > 0), F.log(F.col("close") / F.col("_before"))).otherwise(0.0)).drop("_before")
    begin = df.where(F.col("_place") < lookback)  # a bounded number of rows of each series
    so_far = Window.partitionBy("symbol").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    warm = begin.select("symbol", "_place", F.stddev_samp("_r").over(so_far).alias("_warm"))
    seeds = begin.groupBy("symbol").agg(F.var_pop("_r").alias("_seed"))
    df = df.join(seeds, "symbol", "left").join(warm, ["symbol", "_place"], "left")
    x = F.when(F.col("_place") < lookback - 1, 0.0).when(F.col("_place") == lookback - 1, F.col("_seed")).otherwise(alpha * F.col("_r") * F.col("_r"))
    out = recursions(df, {"_square": (x, 1 - alpha)})
    value = F.when(F.col("_place") < lookback, F.coalesce("_warm", F.lit(0.0))).otherwise(F.sqrt("_square"))
    return out.select(*bars.columns, F.greatest(value, F.lit(0.001)).alias("volatility"))
