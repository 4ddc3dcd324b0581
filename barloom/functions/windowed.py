"""Indicators that look back over a bounded number of bars, as window expressions.

Every function takes a :class:`Series` and gives a dict of named output columns, null
for the first bars. Parameters have the usual defaults.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.statistics import correlation

Outputs = dict[str, Column]


@dataclass(frozen=True)
class Series:
    """Columns of bars and the order of their series."""

    keys: tuple[str, ...] = ("symbol",)
    order: str = "ts"
    columns: dict[str, str] = field(default_factory=dict)  # overrides, such as close -> another column
    place_column: str | None = None  # place in the whole series from 0, where the keys are only a part of it

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def last(self, n: int) -> WindowSpec:
        return self.window.rowsBetween(-(n - 1), 0)

    def so_far(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def __getitem__(self, name: str) -> Column:
        return F.col(self.columns.get(name, name))

    def place(self) -> Column:
        return F.col(self.place_column) + 1 if self.place_column else F.row_number().over(self.window)

    def ready(self, value: Column, bars: int) -> Column:
        """Null for the first ``bars`` rows."""
        return F.when(self.place() > bars, value)

    def lag(self, c: Column, n: int = 1) -> Column:
        return F.lag(c, n).over(self.window)


def _mean(s: Series, c: Column, n: int) -> Column:
    """Mean of the last n values; null while any of them is missing."""
    return F.when(F.count(c).over(s.last(n)) == n, F.avg(c).over(s.last(n)))


def _full(s: Series, c: Column, n: int, value: Column) -> Column:
    return F.when(F.count(c).over(s.last(n)) == n, value)


def sma(s: Series, period: int = 30) -> Outputs:
    return {"sma": _mean(s, s["close"], period)}


def _weighted(s: Series, c: Column, n: int) -> Column:
    """Linearly weighted mean of lags; the newest counts n times."""
    return sum((s.lag(c, k) if k else c) * (n - k) for k in range(n)) / (n * (n + 1) / 2)


def wma(s: Series, period: int = 30) -> Outputs:
    return {"wma": _weighted(s, s["close"], period)}


def trima(s: Series, period: int = 30) -> Outputs:
    """The mean of means, written as one weighting of lags."""
    a, b = (period + 1) // 2, period // 2 + 1
    weights = [sum(1 for j in range(a) if 0 <= k - j < b) for k in range(a + b - 1)]
    c = s["close"]
    return {"trima": sum((s.lag(c, k) if k else c) * float(w) for k, w in enumerate(weights)) / float(a * b)}


def midpoint(s: Series, period: int = 14) -> Outputs:
    c, w = s["close"], s.last(period)
    return {"midpoint": _full(s, c, period, (F.max(c).over(w) + F.min(c).over(w)) / 2)}


def midprice(s: Series, period: int = 14) -> Outputs:
    w = s.last(period)
    return {"midprice": _full(s, s["high"], period, (F.max(s["high"]).over(w) + F.min(s["low"]).over(w)) / 2)}


def bbands(s: Series, period: int = 5, up: float = 2.0, down: float = 2.0) -> Outputs:
    c = s["close"]
    middle, spread = _mean(s, c, period), F.stddev_pop(c).over(s.last(period))
    return {"upper": middle + spread * up, "middle": middle, "lower": middle - spread * down}


def accbands(s: Series, period: int = 20) -> Outputs:
    h, low = s["high"], s["low"]
    width = F.when(h + low != 0, 4 * (h - low) / (h + low)).otherwise(F.lit(0.0))
    return {"upper": _mean(s, h * (1 + width), period), "middle": _mean(s, s["close"], period), "lower": _mean(s, low * (1 - width), period)}


def mom(s: Series, period: int = 10) -> Outputs:
    return {"mom": s["close"] - s.lag(s["close"], period)}


def _change(s: Series, period: int) -> tuple[Column, Column]:
    return s["close"], s.lag(s["close"], period)


def roc(s: Series, period: int = 10) -> Outputs:
    c, p = _change(s, period)
    return {"roc": F.when(p != 0, (c / p - 1) * 100).when(p == 0, 0.0)}


def rocp(s: Series, period: int = 10) -> Outputs:
    c, p = _change(s, period)
    return {"rocp": F.when(p != 0, (c - p) / p).when(p == 0, 0.0)}


def rocr(s: Series, period: int = 10) -> Outputs:
    c, p = _change(s, period)
    return {"rocr": F.when(p != 0, c / p).when(p == 0, 0.0)}


def rocr100(s: Series, period: int = 10) -> Outputs:
    c, p = _change(s, period)
    return {"rocr100": F.when(p != 0, c / p * 100).when(p == 0, 0.0)}


def apo(s: Series, fast: int = 12, slow: int = 26) -> Outputs:
    """Difference of two simple means (the exponential form is among the kernels)."""
    return {"apo": _mean(s, s["close"], fast) - _mean(s, s["close"], slow) + F.when(s.place() < max(fast, slow), None).otherwise(0.0)}


def ppo(s: Series, fast: int = 12, slow: int = 26) -> Outputs:
    a, b = _mean(s, s["close"], fast), _mean(s, s["close"], slow)
    return {"ppo": F.when(b != 0, (a - b) / b * 100).when(b == 0, 0.0)}


def _fast_k(s: Series, n: int) -> Column:
    w = s.last(n)
    top, bottom = F.max(s["high"]).over(w), F.min(s["low"]).over(w)
    k = F.when(top != bottom, (s["close"] - bottom) / (top - bottom) * 100).otherwise(F.lit(0.0))
    return _full(s, s["high"], n, k)


def _mean_of_lags(s: Series, value: Callable[[Series, int], Column], n: int) -> Column:
    return sum((value(s, k) for k in range(n))) / n


def stochf(s: Series, fast_k: int = 5, fast_d: int = 3) -> Outputs:
    """Needs its K as a column of its own, see :data:`STAGED`."""
    k = F.col("_k")
    d = _mean(s, k, fast_d)
    return {"fastk": F.when(d.isNotNull(), k), "fastd": d}


def stoch(s: Series, fast_k: int = 5, slow_k: int = 3, slow_d: int = 3) -> Outputs:
    k = F.col("_slow_k")
    d = _mean(s, k, slow_d)
    return {"slowk": F.when(d.isNotNull(), k), "slowd": d}


def willr(s: Series, period: int = 14) -> Outputs:
    w = s.last(period)
    top, bottom = F.max(s["high"]).over(w), F.min(s["low"]).over(w)
    return {"willr": _full(s, s["high"], period, F.when(top != bottom, (top - s["close"]) / (top - bottom) * -100).otherwise(F.lit(0.0)))}


def cci(s: Series, period: int = 14) -> Outputs:
    """Commodity channel index; the mean deviation is taken over the frame's values."""
    typical = (s["high"] + s["low"] + s["close"]) / 3
    values, m = F.collect_list(typical).over(s.last(period)), F.avg(typical).over(s.last(period))
    deviation = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.abs(x - m)) / period
    return {"cci": _full(s, typical, period, F.when((deviation != 0) & (typical != m), (typical - m) / (0.015 * deviation)).otherwise(F.lit(0.0)))}


def _since(s: Series, name: str, n: int, top: bool) -> Column:
    """Bars since the latest extreme of the last n + 1 bars."""
    w, place = s.last(n + 1), F.col("_nth")
    value = F.struct(s[name].alias("x"), place.alias("p")) if top else F.struct((-s[name]).alias("x"), place.alias("p"))
    return F.when(place > n, place - F.max(value).over(w)["p"])


def aroon(s: Series, period: int = 14) -> Outputs:
    down, up = _since(s, "low", period, False), _since(s, "high", period, True)
    return {"aroondown": (period - down) * 100.0 / period, "aroonup": (period - up) * 100.0 / period}


def aroonosc(s: Series, period: int = 14) -> Outputs:
    return {"aroonosc": (_since(s, "low", period, False) - _since(s, "high", period, True)) * 100.0 / period}


def _true_range(s: Series) -> Column:
    before = s.lag(s["close"])
    return F.when(before.isNotNull(), F.greatest(s["high"] - s["low"], F.abs(s["high"] - before), F.abs(s["low"] - before)))


def ultosc(s: Series, short: int = 7, middle: int = 14, long: int = 28) -> Outputs:
    """Uses true range and buying pressure as columns, see :data:`STAGED`."""
    part = lambda n: F.when(F.sum("_tr").over(s.last(n)) != 0, F.sum("_bp").over(s.last(n)) / F.sum("_tr").over(s.last(n))).otherwise(F.lit(0.0))
    value = (4 * part(short) + 2 * part(middle) + part(long)) * 100 / 7
    return {"ultosc": s.ready(value, max(short, middle, long))}


def mfi(s: Series, period: int = 14) -> Outputs:
    typical, flow, w = F.col("_typical"), F.col("_typical") * s["volume"], s.last(period)
    before = F.col("_typical_before")
    up = F.sum(F.when(typical > before, flow).otherwise(0.0)).over(w)
    down = F.sum(F.when(typical < before, flow).otherwise(0.0)).over(w)
    return {"mfi": s.ready(F.when(up + down < 1.0, F.lit(0.0)).otherwise(100 * up / (up + down)), period)}


def imi(s: Series, period: int = 14) -> Outputs:
    w, change = s.last(period), s["close"] - s["open"]
    up = F.sum(F.when(change > 0, change).otherwise(0.0)).over(w)
    down = F.sum(F.when(change < 0, -change).otherwise(0.0)).over(w)
    return {"imi": s.ready(F.when(up + down != 0, 100 * up / (up + down)).otherwise(F.lit(0.0)), period - 1)}


def bop(s: Series) -> Outputs:
    span = s["high"] - s["low"]
    return {"bop": F.when(span > 0, (s["close"] - s["open"]) / span).otherwise(F.lit(0.0))}


def trange(s: Series) -> Outputs:
    return {"trange": _true_range(s)}


def _money_flow(s: Series) -> Column:
    h, low, c = s["high"], s["low"], s["close"]
    return F.when(h > low, ((c - low) - (h - c)) / (h - low) * s["volume"]).otherwise(F.lit(0.0))


def ad(s: Series) -> Outputs:
    return {"ad": F.sum(_money_flow(s)).over(s.so_far())}


def obv(s: Series) -> Outputs:
    sign = F.col("_sign")
    return {"obv": F.sum(sign * s["volume"]).over(s.so_far())}


def avgprice(s: Series) -> Outputs:
    return {"avgprice": (s["open"] + s["high"] + s["low"] + s["close"]) / 4}


def medprice(s: Series) -> Outputs:
    return {"medprice": (s["high"] + s["low"]) / 2}


def typprice(s: Series) -> Outputs:
    return {"typprice": (s["high"] + s["low"] + s["close"]) / 3}


def wclprice(s: Series) -> Outputs:
    return {"wclprice": (s["high"] + s["low"] + 2 * s["close"]) / 4}


def stddev(s: Series, period: int = 5, deviations: float = 1.0) -> Outputs:
    c = s["close"]
    return {"stddev": _full(s, c, period, F.stddev_pop(c).over(s.last(period)) * deviations)}


def var(s: Series, period: int = 5) -> Outputs:
    c = s["close"]
    return {"var": _full(s, c, period, F.var_pop(c).over(s.last(period)))}


def correl(s: Series, period: int = 30) -> Outputs:
    """Correlation of ``real0`` and ``real1`` (by default high and low)."""
    a, b = s["high"], s["low"]
    return {"correl": _full(s, a, period, F.coalesce(correlation(a, b, s.last(period)), F.lit(0.0)))}


def beta(s: Series, period: int = 5) -> Outputs:
    """Slope of the returns of the second series on those of the first."""
    x, y, w = F.col("_ret_a"), F.col("_ret_b"), s.last(period)
    v = F.var_pop(x).over(w)
    return {"beta": s.ready(F.when(v != 0, F.covar_pop(x, y).over(w) / v).otherwise(F.lit(0.0)), period)}


def _regression(s: Series, n: int) -> tuple[Column, Column]:
    """Slope and intercept over the last n values, at positions 0 to n - 1."""
    c, w, place = s["close"], s.last(n), F.col("_nth").cast("double")
    mean_x, mean_y = F.avg(place).over(w), F.avg(c).over(w)
    slope = F.covar_pop(place, c).over(w) / ((n * n - 1) / 12.0)
    start = F.col("_nth") - n + 1
    return _full(s, c, n, slope), _full(s, c, n, mean_y - slope * (mean_x - start))


def linearreg(s: Series, period: int = 14) -> Outputs:
    m, b = _regression(s, period)
    return {"linearreg": b + m * (period - 1)}


def linearreg_slope(s: Series, period: int = 14) -> Outputs:
    return {"linearreg_slope": _regression(s, period)[0]}


def linearreg_intercept(s: Series, period: int = 14) -> Outputs:
    return {"linearreg_intercept": _regression(s, period)[1]}


def linearreg_angle(s: Series, period: int = 14) -> Outputs:
    return {"linearreg_angle": F.degrees(F.atan(_regression(s, period)[0]))}


def tsf(s: Series, period: int = 14) -> Outputs:
    m, b = _regression(s, period)
    return {"tsf": b + m * period}


def avgdev(s: Series, period: int = 14) -> Outputs:
    c, w = s["close"], s.last(period)
    m = F.avg(c).over(w)
    return {"avgdev": _full(s, c, period, F.aggregate(F.collect_list(c).over(w), F.lit(0.0), lambda acc, x: acc + F.abs(x - m)) / period)}


def window_sum(s: Series, period: int = 30) -> Outputs:
    c = s["close"]
    return {"sum": _full(s, c, period, F.sum(c).over(s.last(period)))}


def _extreme(s: Series, n: int, top: bool) -> Column:
    c = s["close"]
    return _full(s, c, n, (F.max if top else F.min)(c).over(s.last(n)))


def _extreme_index(s: Series, n: int, top: bool) -> Column:
    """Position from 0 of the latest extreme of the last n values."""
    place = F.col("_nth")
    value = F.struct((s["close"] if top else -s["close"]).alias("x"), place.alias("p"))
    return _full(s, s["close"], n, F.max(value).over(s.last(n))["p"] - 1)


def window_max(s: Series, period: int = 30) -> Outputs:
    return {"max": _extreme(s, period, True)}


def window_min(s: Series, period: int = 30) -> Outputs:
    return {"min": _extreme(s, period, False)}


def maxindex(s: Series, period: int = 30) -> Outputs:
    return {"maxindex": _extreme_index(s, period, True)}


def minindex(s: Series, period: int = 30) -> Outputs:
    return {"minindex": _extreme_index(s, period, False)}


def minmax(s: Series, period: int = 30) -> Outputs:
    return {"min": _extreme(s, period, False), "max": _extreme(s, period, True)}


def minmaxindex(s: Series, period: int = 30) -> Outputs:
    return {"minidx": _extreme_index(s, period, False), "maxidx": _extreme_index(s, period, True)}


def _dual(name: str, combine: Callable[[Column, Column], Column]) -> Callable[[Series], Outputs]:
    """Operators over two series, by default high and low."""
    return lambda s: {name: combine(s["high"], s["low"])}


def _elementwise(name: str) -> Callable[[Series], Outputs]:
    function = {"ceil": lambda c: F.ceil(c).cast("double"), "floor": lambda c: F.floor(c).cast("double"), "ln": F.log}.get(name, getattr(F, name, None))
    return lambda s: {name: function(s["close"])}


#: Columns that an indicator needs beforehand, as a window cannot stand within a window.
STAGED: dict[str, Callable[..., list[dict[str, Column]]]] = {
    "stochf": lambda s, fast_k=5, fast_d=3: [{"_k": _fast_k(s, fast_k)}],
    "stoch": lambda s, fast_k=5, slow_k=3, slow_d=3: [{"_k": _fast_k(s, fast_k)}, {"_slow_k": _mean(s, F.col("_k"), slow_k)}],
    "ultosc": lambda s, **_: [{"_before": s.lag(s["close"])}, {"_tr": F.greatest("_before", s["high"]) - F.least("_before", s["low"]), "_bp": s["close"] - F.least("_before", s["low"])}],
    "mfi": lambda s, **_: [{"_typical": (s["high"] + s["low"] + s["close"]) / 3}, {"_typical_before": s.lag(F.col("_typical"))}],
    "obv": lambda s: [{"_before": s.lag(s["close"])}, {"_sign": F.when(F.col("_before").isNull() | (s["close"] > F.col("_before")), 1).when(s["close"] < F.col("_before"), -1).otherwise(0)}],
    "beta": lambda s, **_: [{"_ret_a": F.try_divide(s["high"], s.lag(s["high"])) - 1, "_ret_b": F.try_divide(s["low"], s.lag(s["low"])) - 1}],
}
for _name in ("aroon", "aroonosc", "linearreg", "linearreg_slope", "linearreg_intercept", "linearreg_angle", "tsf", "maxindex", "minindex", "minmaxindex"):
    STAGED[_name] = lambda s, **_: [{"_nth": s.place()}]

WINDOWED: dict[str, Callable[..., Outputs]] = {
    f.__name__: f
    for f in (
        sma, wma, trima, midpoint, midprice, bbands, accbands, mom, roc, rocp, rocr, rocr100, apo, ppo, stochf, stoch, willr, cci,
        aroon, aroonosc, ultosc, mfi, imi, bop, trange, ad, obv, avgprice, medprice, typprice, wclprice, stddev, var, correl, beta,
        linearreg, linearreg_slope, linearreg_intercept, linearreg_angle, tsf, avgdev, maxindex, minindex, minmax, minmaxindex,
    )
}
WINDOWED |= {"sum": window_sum, "max": window_max, "min": window_min}
WINDOWED |= {n: _elementwise(n) for n in ("acos", "asin", "atan", "ceil", "cos", "cosh", "exp", "floor", "ln", "log10", "sin", "sinh", "sqrt", "tan", "tanh")}
WINDOWED |= {
    "add": _dual("add", lambda a, b: a + b),
    "sub": _dual("sub", lambda a, b: a - b),
    "mult": _dual("mult", lambda a, b: a * b),
    "div": _dual("div", lambda a, b: F.when(b != 0, a / b)),
}
