"""Candlestick patterns as predicates over a candle and the ones before it.

A pattern is 100 or -100 where it completes and 0 elsewhere. What is long, short, near
or equal is relative to the mean of the preceding candles. All of it is columns: the
means, then the candles before as one struct each, so that the rows of a window stay narrow,
then element-wise logic.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windowed import Series

# Measure, candles averaged (0: this candle's own), factor.
SETTINGS = {
    "long": ("body", 10, 1.0), "short": ("body", 10, 1.0), "doji": ("range", 10, 0.1), "shadow_long": ("body", 0, 1.0),
    "shadow_very_long": ("body", 0, 2.0), "shadow_short": ("shadows", 10, 0.5), "very_short": ("range", 10, 0.1),
    "near": ("range", 5, 0.2), "far": ("range", 5, 0.6), "equal": ("range", 5, 0.05),
}


class Candle:
    """The candle ``back`` bars ago; ``used`` collects the measures that are asked of any."""

    def __init__(self, back: int, used: set[str]) -> None:
        self._back, self._used = back, used

    def __getattr__(self, name: str) -> Column:
        self._used.add(name)
        return F.col(f"_candle{self._back}")[name]

    @property
    def top(self) -> Column:
        return F.greatest(self.o, self.c)

    @property
    def bottom(self) -> Column:
        return F.least(self.o, self.c)

    @property
    def white(self) -> Column:
        return self.color == 1

    @property
    def black(self) -> Column:
        return self.color == -1

    @property
    def is_long(self) -> Column:
        return self.body > self.long

    @property
    def is_doji(self) -> Column:
        return self.body <= self.doji

    @property
    def bare_top(self) -> Column:
        return self.upper < self.very_short

    @property
    def bare_bottom(self) -> Column:
        return self.lower < self.very_short


def _gap_up(a: Candle, b: Candle) -> Column:
    return a.bottom > b.top


def _gap_down(a: Candle, b: Candle) -> Column:
    return a.top < b.bottom


def _near(x: Column, y: Column, width: Column) -> Column:
    return (x <= y + width) & (x >= y - width)


def _inside(a: Candle, b: Candle) -> Column:
    return (a.top < b.top) & (a.bottom > b.bottom)


def _all(*c: Column) -> Column:
    return reduce(lambda a, b: a & b, c)


def _sign(*cases: tuple[Column, Column | int]) -> Column:
    out = F.lit(0)
    for condition, value in reversed(cases):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


Pattern = Callable[..., Column]
PATTERNS: dict[str, Pattern] = {}


def _pattern(f: Pattern) -> Pattern:
    PATTERNS[f.__name__] = f
    return f


@_pattern
def cdl2crows(a, b, c, *_):
    return _sign((_all(c.white, c.is_long, b.black, _gap_up(b, c), a.black, a.o < b.o, a.o > b.c, a.c > c.o, a.c < c.c), -100))


@_pattern
def cdl3blackcrows(a, b, c, d, *_):
    return _sign((_all(d.white, c.black, b.black, a.black, c.bare_bottom, b.bare_bottom, a.bare_bottom, b.o < c.o, b.o > c.c, a.o < b.o, a.o > b.c, c.c < d.h, c.c > b.c, b.c > a.c), -100))


@_pattern
def cdl3inside(a, b, c, *_):
    base = _all(c.is_long, b.body <= b.short, _inside(b, c))
    return _sign((base & c.white & a.black & (a.c < c.o), -100), (base & c.black & a.white & (a.c > c.o), 100))


@_pattern
def cdl3linestrike(a, b, c, d, *_):
    base = _all(d.color == c.color, c.color == b.color, a.color == -b.color, c.o >= d.bottom - d.near, c.o <= d.top + d.near, b.o >= c.bottom - c.near, b.o <= c.top + c.near)
    return _sign((_all(base, b.white, b.c > c.c, c.c > d.c, a.o > b.c, a.c < d.o), 100), (_all(base, b.black, b.c < c.c, c.c < d.c, a.o < b.c, a.c > d.o), -100))


@_pattern
def cdl3outside(a, b, c, *_):
    return _sign((_all(b.white, c.black, b.c > c.o, b.o < c.c, a.c > b.c), 100), (_all(b.black, c.white, b.o > c.c, b.c < c.o, a.c < b.c), -100))


@_pattern
def cdl3starsinsouth(a, b, c, *_):
    first = _all(c.black, b.black, a.black, c.is_long, c.lower > c.shadow_long)
    second = _all(b.body < c.body, b.o > c.c, b.o <= c.h, b.l < c.c, b.l >= c.l, b.lower > b.very_short)
    return _sign((_all(first, second, a.body < a.short, a.bare_bottom, a.bare_top, a.l > b.l, a.h < b.h), 100))


@_pattern
def cdl3whitesoldiers(a, b, c, *_):
    rising = _all(c.white, b.white, a.white, c.bare_top, b.bare_top, a.bare_top, a.c > b.c, b.c > c.c)
    opens = _all(b.o > c.o, b.o <= c.c + c.near, a.o > b.o, a.o <= b.c + b.near)
    return _sign((_all(rising, opens, b.body > c.body - c.far, a.body > b.body - b.far, a.body > a.short), 100))


@_pattern
def cdladvanceblock(a, b, c, *_):
    base = _all(c.white, b.white, a.white, a.c > b.c, b.c > c.c, b.o > c.o, b.o <= c.c + c.near, a.o > b.o, a.o <= b.c + b.near, c.is_long, c.upper < c.shadow_short)
    weak = ((b.body < c.body - c.far) & (a.body < b.body + b.near)) | (a.body < b.body - b.far)
    weak = weak | _all(a.body < b.body, b.body < c.body, (a.upper > a.shadow_short) | (b.upper > b.shadow_short)) | ((a.body < b.body) & (a.upper > a.shadow_long))
    return _sign((base & weak, -100))


@_pattern
def cdlbelthold(a, *_):
    return _sign((a.is_long & ((a.white & a.bare_bottom) | (a.black & a.bare_top)), a.color * 100))


@_pattern
def cdlbreakaway(a, b, c, d, e):
    base = _all(e.is_long, e.color == d.color, d.color == b.color, b.color == -a.color)
    down = _all(e.black, _gap_down(d, e), c.h < d.h, c.l < d.l, b.h < c.h, b.l < c.l, a.c > d.o, a.c < e.c)
    up = _all(e.white, _gap_up(d, e), c.h > d.h, c.l > d.l, b.h > c.h, b.l > c.l, a.c < d.o, a.c > e.c)
    return _sign((base & (down | up), a.color * 100))


@_pattern
def cdlclosingmarubozu(a, *_):
    return _sign((a.is_long & ((a.white & a.bare_top) | (a.black & a.bare_bottom)), a.color * 100))


@_pattern
def cdlconcealbabyswall(a, b, c, d, *_):
    return _sign((_all(d.black, c.black, b.black, a.black, d.bare_bottom, d.bare_top, c.bare_bottom, c.bare_top, _gap_down(b, c), b.upper > b.very_short, b.h > c.c, a.h > b.h, a.l < b.l), 100))


@_pattern
def cdlcounterattack(a, b, *_):
    return _sign((_all(b.color == -a.color, b.is_long, a.is_long, _near(a.c, b.c, b.equal)), a.color * 100))


@_pattern
def cdldoji(a, *_):
    return _sign((a.is_doji, 100))


@_pattern
def cdldojistar(a, b, *_):
    return _sign((b.is_long & a.is_doji & ((b.white & _gap_up(a, b)) | (b.black & _gap_down(a, b))), b.color * -100))


@_pattern
def cdldragonflydoji(a, *_):
    return _sign((a.is_doji & a.bare_top & (a.lower > a.very_short), 100))


@_pattern
def cdlengulfing(a, b, *_):
    up = _all(a.white, b.black, ((a.c >= b.o) & (a.o < b.c)) | ((a.c > b.o) & (a.o <= b.c)))
    down = _all(a.black, b.white, ((a.o >= b.c) & (a.c < b.o)) | ((a.o > b.c) & (a.c <= b.o)))
    return _sign((up, 100), (down, -100))


@_pattern
def cdlgapsidesidewhite(a, b, c, *_):
    base = _all(b.white, a.white, _near(a.body, b.body, b.near), _near(a.o, b.o, b.equal))
    return _sign((_all(base, _gap_up(b, c), _gap_up(a, c)), 100), (_all(base, _gap_down(b, c), _gap_down(a, c)), -100))


@_pattern
def cdlgravestonedoji(a, *_):
    return _sign((a.is_doji & a.bare_bottom & (a.upper > a.very_short), 100))


@_pattern
def cdlhammer(a, b, *_):
    return _sign((_all(a.body < a.short, a.lower > a.shadow_long, a.bare_top, a.bottom <= b.l + b.near), 100))


@_pattern
def cdlhangingman(a, b, *_):
    return _sign((_all(a.body < a.short, a.lower > a.shadow_long, a.bare_top, a.bottom >= b.h - b.near), -100))


@_pattern
def cdlharami(a, b, *_):
    return _sign((_all(b.is_long, a.body <= a.short, _inside(a, b)), b.color * -100))


@_pattern
def cdlharamicross(a, b, *_):
    return _sign((_all(b.is_long, a.is_doji, _inside(a, b)), b.color * -100))


@_pattern
def cdlhighwave(a, *_):
    return _sign((_all(a.body < a.short, a.upper > a.shadow_very_long, a.lower > a.shadow_very_long), a.color * 100))


@_pattern
def cdlhikkake(a, b, c, *_):
    """An inside bar and a failed break of it; unconfirmed."""
    inside = (b.h < c.h) & (b.l > c.l)
    return _sign((_all(inside, a.h < b.h, a.l < b.l), 100), (_all(inside, a.h > b.h, a.l > b.l), -100))


@_pattern
def cdlhikkakemod(a, b, c, d, *_):
    inside = _all(c.h < d.h, c.l > d.l, b.h < c.h, b.l > c.l)
    return _sign((_all(inside, a.h < b.h, a.l < b.l, c.c <= c.l + c.near), 100), (_all(inside, a.h > b.h, a.l > b.l, c.c >= c.h - c.near), -100))


@_pattern
def cdlhomingpigeon(a, b, *_):
    return _sign((_all(b.black, a.black, b.is_long, a.body <= a.short, a.o < b.o, a.c > b.c), 100))


@_pattern
def cdlidentical3crows(a, b, c, *_):
    return _sign((_all(c.black, b.black, a.black, c.bare_bottom, b.bare_bottom, a.bare_bottom, c.c > b.c, b.c > a.c, _near(b.o, c.c, c.equal), _near(a.o, b.c, b.equal)), -100))


@_pattern
def cdlinneck(a, b, *_):
    return _sign((_all(b.black, b.is_long, a.white, a.o < b.l, a.c <= b.c + b.equal, a.c >= b.c), -100))


@_pattern
def cdlinvertedhammer(a, b, *_):
    return _sign((_all(a.body < a.short, a.upper > a.shadow_long, a.bare_bottom, _gap_down(a, b)), 100))


def _marubozu(a: Candle) -> Column:
    return _all(a.is_long, a.bare_top, a.bare_bottom)


def _kicks(a: Candle, b: Candle) -> Column:
    return _all(b.color == -a.color, _marubozu(b), _marubozu(a), (b.black & (a.l > b.h)) | (b.white & (a.h < b.l)))


@_pattern
def cdlkicking(a, b, *_):
    return _sign((_kicks(a, b), a.color * 100))


@_pattern
def cdlkickingbylength(a, b, *_):
    return _sign((_kicks(a, b), F.when(a.body > b.body, a.color).otherwise(b.color) * 100))


@_pattern
def cdlladderbottom(a, b, c, d, e):
    return _sign((_all(e.black, d.black, c.black, e.o > d.o, d.o > c.o, e.c > d.c, d.c > c.c, b.black, b.upper > b.very_short, a.white, a.o > b.o, a.c > b.h), 100))


@_pattern
def cdllongleggeddoji(a, *_):
    return _sign((a.is_doji & ((a.lower > a.shadow_long) | (a.upper > a.shadow_long)), 100))


@_pattern
def cdllongline(a, *_):
    return _sign((_all(a.is_long, a.upper < a.shadow_short, a.lower < a.shadow_short), a.color * 100))


@_pattern
def cdlmarubozu(a, *_):
    return _sign((_marubozu(a), a.color * 100))


@_pattern
def cdlmatchinglow(a, b, *_):
    return _sign((_all(b.black, a.black, _near(a.c, b.c, b.equal)), 100))


@_pattern
def cdlonneck(a, b, *_):
    return _sign((_all(b.black, b.is_long, a.white, a.o < b.l, _near(a.c, b.l, b.equal)), -100))


@_pattern
def cdlpiercing(a, b, *_):
    return _sign((_all(b.black, b.is_long, a.white, a.is_long, a.o < b.l, a.c < b.o, a.c > b.c + b.body * 0.5), 100))


@_pattern
def cdlrickshawman(a, *_):
    middle = a.l + a.range / 2
    return _sign((_all(a.is_doji, a.lower > a.shadow_long, a.upper > a.shadow_long, a.bottom <= middle + a.near, a.top >= middle - a.near), 100))


@_pattern
def cdlrisefall3methods(a, b, c, d, e):
    way = e.color
    small = _all(*(x.body < x.short for x in (d, c, b)), *((x.bottom < e.h) & (x.top > e.l) for x in (d, c, b)))
    colors = _all(e.color == -d.color, d.color == c.color, c.color == b.color, b.color == -a.color)
    steps = _all(c.c * way < d.c * way, b.c * way < c.c * way, a.o * way > b.c * way, a.c * way > e.c * way)
    return _sign((_all(e.is_long, a.is_long, small, colors, steps), way * 100))


@_pattern
def cdlseparatinglines(a, b, *_):
    return _sign((_all(b.color == -a.color, _near(a.o, b.o, b.equal), a.is_long, (a.white & a.bare_bottom) | (a.black & a.bare_top)), a.color * 100))


@_pattern
def cdlshootingstar(a, b, *_):
    return _sign((_all(a.body < a.short, a.upper > a.shadow_long, a.bare_bottom, _gap_up(a, b)), -100))


@_pattern
def cdlshortline(a, *_):
    return _sign((_all(a.body < a.short, a.upper < a.shadow_short, a.lower < a.shadow_short), a.color * 100))


@_pattern
def cdlspinningtop(a, *_):
    return _sign((_all(a.body < a.short, a.upper > a.body, a.lower > a.body), a.color * 100))


@_pattern
def cdlstalledpattern(a, b, c, *_):
    return _sign((_all(c.white, b.white, a.white, a.c > b.c, b.c > c.c, c.is_long, b.is_long, b.bare_top, b.o > c.o, b.o <= c.c + c.near, a.body < a.short, a.o >= b.c - a.body - b.near), -100))


@_pattern
def cdlsticksandwich(a, b, c, *_):
    return _sign((_all(c.black, b.white, a.black, b.l > c.c, _near(a.c, c.c, c.equal)), 100))


@_pattern
def cdltakuri(a, *_):
    return _sign((_all(a.is_doji, a.bare_top, a.lower > a.shadow_very_long), 100))


@_pattern
def cdltasukigap(a, b, c, *_):
    alike = F.abs(b.body - a.body) < b.near
    up = _all(_gap_up(b, c), b.white, a.black, a.o < b.c, a.o > b.o, a.c < b.o, a.c > c.top, alike)
    down = _all(_gap_down(b, c), b.black, a.white, a.o < b.o, a.o > b.c, a.c > b.o, a.c < c.bottom, alike)
    return _sign((up, 100), (down, -100))


@_pattern
def cdlthrusting(a, b, *_):
    return _sign((_all(b.black, b.is_long, a.white, a.o < b.l, a.c > b.c + b.equal, a.c <= b.c + b.body * 0.5), -100))


@_pattern
def cdltristar(a, b, c, *_):
    stars = _all(c.is_doji, b.body <= c.doji, a.body <= c.doji)
    return _sign((_all(stars, _gap_up(b, c), a.top < b.top), -100), (_all(stars, _gap_down(b, c), a.bottom > b.bottom), 100))


@_pattern
def cdlunique3river(a, b, c, *_):
    return _sign((_all(c.is_long, c.black, b.black, b.c > c.c, b.o <= c.o, b.l < c.l, a.body < a.short, a.white, a.o > b.l), 100))


@_pattern
def cdlupsidegap2crows(a, b, c, *_):
    return _sign((_all(c.white, c.is_long, b.black, b.body <= b.short, _gap_up(b, c), a.black, a.o > b.o, a.c < b.c, a.c > c.c), -100))


@_pattern
def cdlxsidegap3methods(a, b, c, *_):
    base = _all(c.color == b.color, b.color == -a.color, a.o < b.top, a.o > b.bottom, a.c < c.top, a.c > c.bottom)
    return _sign((base & ((c.white & _gap_up(b, c)) | (c.black & _gap_down(b, c))), c.color * 100))


@_pattern
def cdlabandonedbaby(a, b, c, d, e, penetration=0.3):
    base = _all(c.is_long, b.is_doji, a.body > a.short)
    top = _all(c.white, a.black, a.c < c.c - c.body * penetration, b.l > c.h, a.h < b.l)
    bottom = _all(c.black, a.white, a.c > c.c + c.body * penetration, b.h < c.l, a.l > b.h)
    return _sign((base & top, -100), (base & bottom, 100))


@_pattern
def cdldarkcloudcover(a, b, c, d, e, penetration=0.5):
    return _sign((_all(b.white, b.is_long, a.black, a.o > b.h, a.c > b.o, a.c < b.c - b.body * penetration), -100))


def _evening(a, b, c, star, penetration):
    return _sign((_all(c.is_long, c.white, star, _gap_up(b, c), a.body > a.short, a.black, a.c < c.c - c.body * penetration), -100))


def _morning(a, b, c, star, penetration):
    return _sign((_all(c.is_long, c.black, star, _gap_down(b, c), a.body > a.short, a.white, a.c > c.c + c.body * penetration), 100))


@_pattern
def cdleveningdojistar(a, b, c, d, e, penetration=0.3):
    return _evening(a, b, c, b.is_doji, penetration)


@_pattern
def cdleveningstar(a, b, c, d, e, penetration=0.3):
    return _evening(a, b, c, b.body <= b.short, penetration)


@_pattern
def cdlmorningdojistar(a, b, c, d, e, penetration=0.3):
    return _morning(a, b, c, b.is_doji, penetration)


@_pattern
def cdlmorningstar(a, b, c, d, e, penetration=0.3):
    return _morning(a, b, c, b.body <= b.short, penetration)


@_pattern
def cdlmathold(a, b, c, d, e, penetration=0.5):
    small = _all(*(x.body < x.short for x in (d, c, b)))
    held = _all(*((x.bottom < e.c) & (x.bottom > e.c - e.body * penetration) for x in (c, b)))
    falling = _all(c.top < d.o, b.top < c.top)
    return _sign((_all(e.is_long, small, e.white, d.black, a.white, _gap_up(d, e), held, falling, a.o > b.c, a.c > F.greatest(d.h, c.h, b.h)), 100))


def measured(bars: DataFrame, s: Series, used: set[str]) -> DataFrame:
    """Bars with ``_candle0``, a struct of those measures and standards of each candle that are used."""
    body = F.abs(F.col("close") - F.col("open"))
    shaped = bars.withColumns(
        {
            "_body": body,
            "_range": F.col("high") - F.col("low"),
            "_upper": F.col("high") - F.greatest("open", "close"),
            "_lower": F.least("open", "close") - F.col("low"),
            "_shadows": F.col("high") - F.col("low") - body,
            "_color": F.when(F.col("close") >= F.col("open"), 1).otherwise(-1),
        }
    )
    asked = {name: SETTINGS[name] for name in sorted(used & set(SETTINGS))}
    means = {f"_{measure}_{n}": F.avg(f"_{measure}").over(s.window.rowsBetween(-n, -1)) for measure, n, _ in asked.values() if n}
    parts = {"o": "open", "h": "high", "l": "low", "c": "close"}
    fields = {name: F.col(parts.get(name, f"_{name}")) for name in sorted(used - set(SETTINGS))}
    fields |= {name: F.col(f"_{measure}_{n}" if n else f"_{measure}") * factor for name, (measure, n, factor) in asked.items()}
    return shaped.withColumns(means).select(*bars.columns, F.struct(*[c.alias(n) for n, c in fields.items()]).alias("_candle0"))


def patterns(bars: DataFrame, names: list[str] | None = None, s: Series = Series(), penetration: float | None = None) -> DataFrame:
    """Bars with a column for each pattern; null-safe, 0 during the first 14 bars."""
    names = sorted(PATTERNS) if names is None else names
    used: set[str] = set()
    candles = [Candle(k, used) for k in range(5)]
    out = {}
    for name in names:
        f = PATTERNS[name]
        value = f(*candles, penetration) if penetration is not None and "penetration" in f.__code__.co_varnames else f(*candles)
        out[name] = F.when(F.col("_nth") > 14, F.coalesce(value, F.lit(0))).otherwise(0).cast("int")
    before = {f"_candle{k}": F.lag("_candle0", k).over(s.window) for k in range(1, 5)}
    placed = measured(bars, s, used).withColumns(before | {"_nth": F.row_number().over(s.window)})
    return placed.select(*bars.columns, *[c.alias(n) for n, c in out.items()])
