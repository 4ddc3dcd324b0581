"""Boolean conditions over ordered series, as columns that are never null.

Conditions that look back take the window of the series, which must be partitioned by
the series key and ordered by time.
"""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def above(a: Column, b: Column) -> Column:
    return _known(a > b)


def below(a: Column, b: Column) -> Column:
    return _known(a < b)


def at_least(a: Column, b: Column) -> Column:
    return _known(a >= b)


def at_most(a: Column, b: Column) -> Column:
    return _known(a <= b)


def crosses_above(a: Column, b: Column, w: WindowSpec) -> Column:
    """At or under before, over now; false at the first bar and next to nulls."""
    return _known((F.lag(a).over(w) <= F.lag(b).over(w)) & (a > b))


def crosses_below(a: Column, b: Column, w: WindowSpec) -> Column:
    return _known((F.lag(a).over(w) >= F.lag(b).over(w)) & (a < b))


def is_rising(a: Column, w: WindowSpec, bars: int = 1) -> Column:
    return _known(a > F.lag(a, bars).over(w))


def is_falling(a: Column, w: WindowSpec, bars: int = 1) -> Column:
    return _known(a < F.lag(a, bars).over(w))


def both(a: Column, b: Column) -> Column:
    return a & b


def either(a: Column, b: Column) -> Column:
    return a | b


def negated(a: Column) -> Column:
    return ~a


def within_last(c: Column, w: WindowSpec, bars: int) -> Column:
    """True at any of the last bars, this one included; the start has fewer of them."""
    return F.max(c.cast("int")).over(w.rowsBetween(-(bars - 1), 0)) == 1


def persisted_for(c: Column, w: WindowSpec, bars: int) -> Column:
    """True at each of the last bars; false as long as there are fewer."""
    frame = w.rowsBetween(-(bars - 1), 0)
    return (F.min(c.cast("int")).over(frame) == 1) & (F.count(c).over(frame) == bars)


def just_became(c: Column, w: WindowSpec) -> Column:
    """True now and false before; false at the first bar."""
    return c & ~F.coalesce(F.lag(c).over(w), F.lit(True))
