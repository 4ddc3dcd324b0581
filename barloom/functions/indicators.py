"""The registry of indicators and the two ways they run.

Windowed ones become columns; recursive ones of a call share one grouped map per
series. Both want the series key as partitioning, so Spark shuffles once.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import affine, scan
from .blocks import ROWS, placed, windows
from .candles import PATTERNS, patterns
from .kernels import RECURSIVE, TYPED
from .windowed import STAGED, WINDOWED, Series

#: Prices that a source may name beside the bars' own columns.
APPLIED = {"hlc3": "(high + low + close) / 3", "hl2": "(high + low) / 2", "ohlc4": "(open + high + low + close) / 4"}
#: Indicators as they come; one that a user adds or replaces is not run in blocks.
KERNELS = dict(RECURSIVE)
WINDOWS = dict(WINDOWED)
FIELDS = ("open", "high", "low", "close", "volume")
#: What indicators with several outputs call them; others are named like the indicator.
OUTPUTS = {
    "macd": ("macd", "signal", "histogram"), "macdfix": ("macd", "signal", "histogram"), "macdext": ("macd", "signal", "histogram"),
    "stochrsi": ("fastk", "fastd"), "ht_phasor": ("inphase", "quadrature"), "ht_sine": ("sine", "leadsine"), "mama": ("mama", "fama"),
    "ewma_volatility": ("volatility",), "bbands": ("upper", "middle", "lower"), "stoch": ("slowk", "slowd"),
}


@dataclass(frozen=True)
class Spec:
    """An indicator with parameters; ``name`` prefixes its outputs, ``source`` (a column, or a price of :data:`APPLIED`) replaces the close."""

    indicator: str
    params: dict = field(default_factory=dict)
    name: str | None = None
    source: str | None = None

    @property
    def prefix(self) -> str:
        return self.name or self.indicator

    @property
    def typed(self) -> bool:
        """With a moving mean other than the simple one, a windowed indicator is recursive."""
        return self.indicator in TYPED and bool(self.params.get("ma_type"))

    def columns(self) -> list[str]:
        outs = OUTPUTS.get(self.indicator, (self.indicator,))
        return [self.prefix if len(outs) == 1 else f"{self.prefix}_{o}" for o in outs]


def names() -> list[str]:
    return sorted({*WINDOWED, *RECURSIVE, *PATTERNS})


def register_windowed(name: str, build: Callable[..., dict[str, Column]]) -> None:
    WINDOWED[name] = build


def register_recursive(name: str, kernel: Callable, outputs: tuple[str, ...] = ()) -> None:
    RECURSIVE[name] = kernel
    if outputs:
        OUTPUTS[name] = outputs


def _windowed(df: DataFrame, spec: Spec, series: Series) -> DataFrame:
    s = replace(series, columns={"close": spec.source} if spec.source else {})
    before, kept = df, df.columns
    for stage in STAGED.get(spec.indicator, lambda s, **_: [])(s, **{k: v for k, v in spec.params.items() if k != "ma_type"}):
        before = before.withColumns(stage)
    params = {k: v for k, v in spec.params.items() if k != "ma_type"}
    outs = WINDOWED[spec.indicator](s, **params)
    named = {spec.prefix if len(outs) == 1 else f"{spec.prefix}_{k}": v for k, v in outs.items()}
    return before.select(*kept, *[v.alias(k) for k, v in named.items()])


def _recursive(df: DataFrame, specs: list[Spec], keys: tuple[str, ...], order: str) -> DataFrame:
    columns = [c for spec in specs for c in spec.columns()]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns)])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ties = [f for f in FIELDS if f in frame]
        frame = frame.sort_values([order, *ties], kind="stable").reset_index(drop=True)
        arrays = {f: frame[f].to_numpy(dtype=float) for f in FIELDS if f in frame}
        for spec in specs:
            own = arrays | ({"close": frame[spec.source].to_numpy(dtype=float)} if spec.source else {})
            found = (TYPED if spec.typed else RECURSIVE)[spec.indicator](own, **spec.params)
            for c, o in zip(spec.columns(), OUTPUTS.get(spec.indicator, (spec.indicator,)), strict=True):
                frame[c] = found[o]
        return frame

    out = df.groupBy(*keys).applyInPandas(run, schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})  # not a number: null


def reach(spec: Spec) -> int:
    """At least as many rows as a windowed indicator or a candlestick looks back: its windows stand on each other at most three deep."""
    if spec.indicator in PATTERNS:
        return 40
    if spec.indicator == "stochrsi":
        return spec.params.get("fast_k", 5) + spec.params.get("fast_d", 3)
    own = inspect.signature(WINDOWED[spec.indicator]).parameters
    periods = [v for v in ({n: p.default for n, p in own.items()} | spec.params).values() if isinstance(v, int) and not isinstance(v, bool)]
    return 3 * sum(periods) + 5


def _blocked(bars: DataFrame, specs: list[Spec], seconds: int, rows: int) -> tuple[DataFrame, list[Spec]]:
    """Bars with all indicators that run in blocks, and the specs that do not.

    Bars are placed once; recursions share one pass over the blocks, and windows follow in another.
    """
    own = lambda s: RECURSIVE.get(s.indicator) is KERNELS.get(s.indicator) and WINDOWED.get(s.indicator) is WINDOWS.get(s.indicator)
    specs, others = [s for s in specs if own(s)], [s for s in specs if not own(s)]
    if specs and all(s.indicator in scan.SCANNED and not s.source for s in specs):
        return scan.indicators(bars, [(s.indicator, s.prefix, s.params.get("period")) for s in specs], seconds, rows), others
    asked, sliding, inner = [], [], []
    for s in specs:
        kernel = TYPED[s.indicator] if s.typed else RECURSIVE.get(s.indicator)
        halo = affine.BOUNDED[s.indicator](**s.params) if kernel and s.indicator in affine.BOUNDED else None
        if s.indicator in ("adx", "adxr", "stochrsi"):
            under, n = f"_{s.prefix}_under", s.params.get("period", 14)
            below = "rsi" if s.indicator == "stochrsi" else "dx"
            asked.append(affine.wanted(affine.RECURSIONS[below], {"period": n}, [under], (below,), s.source))
            inner.append(under)
            if below == "dx":
                lags = {"lags": n - 1} if s.indicator == "adxr" else {}
                asked.append(affine.wanted(affine.MEAN, {"period": n, "at": n} | lags, s.columns(), ("mean",), under))
            else:
                sliding.append(s)
        elif halo is not None:
            asked.append(affine.Wanted(kernel, s.params, s.columns(), OUTPUTS.get(s.indicator, (s.indicator,)), s.source, halo, halo))
        elif s.indicator in affine.RECURSIONS and not s.typed:
            asked.append(affine.wanted(affine.RECURSIONS[s.indicator], s.params, s.columns(), OUTPUTS.get(s.indicator, (s.indicator,)), s.source))
        elif kernel:
            others.append(s)
        else:
            sliding.append(s)
    if not asked and not sliding:
        return bars, others
    halo = max([0, *map(reach, sliding)])
    rows = max(affine.rows_for(asked, rows), halo)
    df = placed(bars, seconds, rows)
    if asked:
        made = [c for w in asked for c in w.columns]
        df = affine.run(df, asked, rows).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in made})
    if sliding:
        df = windows(df, halo, lambda d, series: add_windows(d, sliding, series), rows)
    return df.drop("_place", "_block", "_i", *inner), others


def _stochastic(df: DataFrame, spec: Spec, series: Series) -> DataFrame:
    """Place of the strength index (a column beside) in its range, and the mean of that."""
    k, d, under = spec.params.get("fast_k", 5), spec.params.get("fast_d", 3), f"_{spec.prefix}_under"
    fast, slow = spec.columns()
    full = lambda c, n, v: F.when(F.count(c).over(series.last(n)) == n, v)
    low, high = F.min(under).over(series.last(k)), F.max(under).over(series.last(k))
    df = df.withColumn(fast, full(under, k, F.when(high > low, (F.col(under) - low) / (high - low) * 100).otherwise(0.0)))
    df = df.withColumn(slow, full(fast, d, F.avg(fast).over(series.last(d))))
    return df.withColumn(fast, F.when(F.col(slow).isNotNull(), F.col(fast)))


def add_windows(df: DataFrame, specs: list[Spec], series: Series) -> DataFrame:
    """``df`` with the outputs of windowed indicators and candlesticks over the given series."""
    for spec in specs:
        if spec.indicator in WINDOWED:
            df = _windowed(df, spec, series)
        elif spec.indicator == "stochrsi":
            df = _stochastic(df, spec, series)
    shapes = [s.indicator for s in specs if s.indicator in PATTERNS]
    return patterns(df, shapes, series) if shapes else df


def compute(bars: DataFrame, specs: list[Spec], keys: tuple[str, ...] = ("symbol",), order: str = "ts", seconds: int | None = None, rows: int = ROWS) -> DataFrame:
    """Bars with the outputs of all indicators, null where not yet defined.

    With ``seconds``, the usual distance of two bars of a symbol, all that looks back over a bounded
    number of rows and all recursions that are affine in their state run in parallel over blocks of
    ``rows`` rows, whatever the distances are. The others (the Hilbert family, MAMA, the
    parabolic stop, moving means of a type without end, and kernels that a user replaces) are one task per series.
    """
    unknown = [s.indicator for s in specs if s.indicator not in WINDOWED and s.indicator not in RECURSIVE and s.indicator not in PATTERNS]
    if unknown:
        raise KeyError(f"no such indicators: {', '.join(unknown)}")
    applied = {s.source for s in specs if s.source in APPLIED and s.source not in bars.columns}
    if applied:
        projected = bars.withColumns({n: F.expr(APPLIED[n]) for n in applied})
        return compute(projected, specs, keys, order, seconds, rows).drop(*applied)
    names = [c for s in specs for c in (s.columns() if s.indicator in RECURSIVE or s.typed else [])]
    if seconds and keys == ("symbol",) and order == "ts" and len(names) == len(set(names)):
        bars, specs = _blocked(bars, specs, seconds, rows)
    recursive = [s for s in specs if s.typed or s.indicator in RECURSIVE]
    out = _recursive(bars, recursive, keys, order) if recursive else bars
    return add_windows(out, [s for s in specs if s not in recursive], Series(keys, order))
