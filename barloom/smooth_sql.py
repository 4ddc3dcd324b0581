"""SQL of recursive smoothing in closed form, for comparison with another engine.

``y += alpha * (x - y)`` from a seed is a sum of powers, so a running window says it
without recursion. Places ``p`` count from 1; powers stay in range for some thousand rows.
"""

from __future__ import annotations

_SO_FAR = "(PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def smoothed(x: str, alpha: float, seed: str, at: int) -> str:
    """The recursion from place ``at`` on, where it has the value ``seed`` (an aggregate over the series)."""
    decay = repr(1 - alpha)
    terms = f"sum(CASE WHEN p > {at} THEN {alpha!r} * ({x}) * pow({decay}, {at} - p) ELSE 0 END) OVER {_SO_FAR}"
    return f"CASE WHEN p >= {at} THEN pow({decay}, p - {at}) * ({seed} + {terms}) END"


def _mean(x: str, first: int, last: int) -> str:
    return f"avg(CASE WHEN p BETWEEN {first} AND {last} THEN {x} END) OVER (PARTITION BY symbol)"


def ema(x: str, n: int, first: int = 1) -> str:
    """Exponential mean of a column that is defined from place ``first`` on."""
    return smoothed(x, 2 / (n + 1), _mean(x, first, first + n - 1), first + n - 1)


def wilder(x: str, n: int, first: int = 2) -> str:
    """Wilder's mean, seeded by ``n`` values from place ``first`` on."""
    return smoothed(x, 1 / n, _mean(x, first, first + n - 1), first + n - 1)


def wilder_sum(x: str, n: int) -> str:
    """Wilder's running sum, seeded by the ``n - 1`` values after the first."""
    decay = repr(1 - 1 / n)
    seed = f"sum(CASE WHEN p BETWEEN 2 AND {n} THEN {x} END) OVER (PARTITION BY symbol)"
    return f"CASE WHEN p >= {n} THEN pow({decay}, p - {n}) * ({seed} + sum(CASE WHEN p > {n} THEN ({x}) * pow({decay}, {n} - p) ELSE 0 END) OVER {_SO_FAR}) END"


_BEFORE = "OVER (PARTITION BY symbol ORDER BY ts)"


def directional(n: int = 14, source: str = "n") -> str:
    """Common tables up to ``x``: directional movement, indices and ADX over bars with places ``p``."""
    return f"""dm0 AS (SELECT *, high - lag(high) {_BEFORE} AS up, lag(low) {_BEFORE} - low AS dn,
      greatest(high - low, abs(high - lag(close) {_BEFORE}), abs(low - lag(close) {_BEFORE})) AS tr FROM {source}),
    dm1 AS (SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mm FROM dm0),
    dm2 AS (SELECT *, {wilder_sum('pm', n)} AS plus_dm, {wilder_sum('mm', n)} AS minus_dm, {wilder_sum('tr', n)} AS trs FROM dm1),
    dm3 AS (SELECT *, CASE WHEN p > {n} THEN CASE WHEN trs = 0 THEN 0 ELSE 100 * plus_dm / trs END END AS plus_di, CASE WHEN p > {n} THEN CASE WHEN trs = 0 THEN 0 ELSE 100 * minus_dm / trs END END AS minus_di FROM dm2),
    dm4 AS (SELECT *, CASE WHEN p > {n} THEN CASE WHEN plus_di + minus_di = 0 THEN 0 ELSE 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END END AS dx FROM dm3),
    dm5 AS (SELECT *, {wilder('dx', n, n + 1)} AS adx FROM dm4),
    x AS (SELECT *, (adx + lag(adx, {n - 1}) {_BEFORE}) / 2 AS adxr FROM dm5)"""
