"""SQL of the candlestick patterns, for comparison with another engine.

A pattern is written over structs: ``a`` is the candle at hand, ``b`` the one before it,
up to ``e``. A struct holds prices, body (``y``), range (``g``), upper and lower shadow
(``u``, ``d``), color (``w``: 1 or -1), body ends (``t``, ``m``) and standards: ``bl``
(mean body of the ten candles before), ``bd`` and ``sv`` (a tenth of their mean range),
``ss`` (half of their mean shadows), ``ne``, ``fa`` and ``eq`` (0.2, 0.6 and 0.05 of the
mean range of the five before).
"""

from __future__ import annotations

import re

_ROW = "(PARTITION BY symbol ORDER BY ts)"
_TEN = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
_FIVE = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)"

#: Abbreviations: gaps and closeness of two candles, and marubozu.
_MACROS = {
    r"UP\((\w),(\w)\)": r"(\1.m > \2.t)",
    r"DOWN\((\w),(\w)\)": r"(\1.t < \2.m)",
    r"IN\((\w),(\w)\)": r"(\1.t < \2.t AND \1.m > \2.m)",
    r"SAME\(([^,()]+),([^,()]+),([^,()]+)\)": r"(\1 BETWEEN \2 - \3 AND \2 + \3)",
    r"BARE\((\w)\)": r"(\1.y > \1.bl AND \1.u < \1.sv AND \1.d < \1.sv)",
}
_UP, _FALL, _OWN, _AGAINST = "100", "-100", "a.w * 100", "b.w * -100"
_SMALL3 = "d.y < d.bl AND c.y < c.bl AND b.y < b.bl"
_ADVANCE = "c.w = 1 AND b.w = 1 AND a.w = 1 AND a.c > b.c AND b.c > c.c AND b.o > c.o AND b.o <= c.c + c.ne"

# Each pattern's cases as (condition, value), the first that holds counts.
CASES: dict[str, list[tuple[str, str]]] = {
    "cdl2crows": [("c.w = 1 AND c.y > c.bl AND b.w = -1 AND UP(b,c) AND a.w = -1 AND a.o < b.o AND a.o > b.c AND a.c > c.o AND a.c < c.c", _FALL)],
    "cdl3blackcrows": [("d.w = 1 AND c.w = -1 AND b.w = -1 AND a.w = -1 AND c.d < c.sv AND b.d < b.sv AND a.d < a.sv AND b.o < c.o AND b.o > c.c AND a.o < b.o AND a.o > b.c AND d.h > c.c AND c.c > b.c AND b.c > a.c", _FALL)],
    "cdl3inside": [("c.y > c.bl AND b.y <= b.bl AND IN(b,c) AND c.w = 1 AND a.w = -1 AND a.c < c.o", _FALL), ("c.y > c.bl AND b.y <= b.bl AND IN(b,c) AND c.w = -1 AND a.w = 1 AND a.c > c.o", _UP)],
    "cdl3linestrike": [
        ("d.w = 1 AND c.w = 1 AND b.w = 1 AND a.w = -1 AND c.o BETWEEN d.m - d.ne AND d.t + d.ne AND b.o BETWEEN c.m - c.ne AND c.t + c.ne AND b.c > c.c AND c.c > d.c AND a.o > b.c AND a.c < d.o", _UP),
        ("d.w = -1 AND c.w = -1 AND b.w = -1 AND a.w = 1 AND c.o BETWEEN d.m - d.ne AND d.t + d.ne AND b.o BETWEEN c.m - c.ne AND c.t + c.ne AND b.c < c.c AND c.c < d.c AND a.o < b.c AND a.c > d.o", _FALL),
    ],
    "cdl3outside": [("b.w = 1 AND c.w = -1 AND b.c > c.o AND b.o < c.c AND a.c > b.c", _UP), ("b.w = -1 AND c.w = 1 AND b.o > c.c AND b.c < c.o AND a.c < b.c", _FALL)],
    "cdl3starsinsouth": [("c.w = -1 AND b.w = -1 AND a.w = -1 AND c.y > c.bl AND c.d > c.y AND b.y < c.y AND b.o > c.c AND b.o <= c.h AND b.l < c.c AND b.l >= c.l AND b.d > b.sv AND a.y < a.bl AND a.d < a.sv AND a.u < a.sv AND a.l > b.l AND a.h < b.h", _UP)],
    "cdl3whitesoldiers": [(_ADVANCE + " AND c.u < c.sv AND b.u < b.sv AND a.u < a.sv AND a.o > b.o AND a.o <= b.c + b.ne AND b.y > c.y - c.fa AND a.y > b.y - b.fa AND a.y > a.bl", _UP)],
    "cdladvanceblock": [(_ADVANCE + " AND a.o > b.o AND a.o <= b.c + b.ne AND c.y > c.bl AND c.u < c.ss AND ((b.y < c.y - c.fa AND a.y < b.y + b.ne) OR a.y < b.y - b.fa OR (a.y < b.y AND b.y < c.y AND (a.u > a.ss OR b.u > b.ss)) OR (a.y < b.y AND a.u > a.y))", _FALL)],
    "cdlbelthold": [("a.y > a.bl AND ((a.w = 1 AND a.d < a.sv) OR (a.w = -1 AND a.u < a.sv))", _OWN)],
    "cdlbreakaway": [("e.y > e.bl AND e.w = d.w AND d.w = b.w AND b.w = -a.w AND ((e.w = -1 AND DOWN(d,e) AND c.h < d.h AND c.l < d.l AND b.h < c.h AND b.l < c.l AND a.c > d.o AND a.c < e.c) OR (e.w = 1 AND UP(d,e) AND c.h > d.h AND c.l > d.l AND b.h > c.h AND b.l > c.l AND a.c < d.o AND a.c > e.c))", _OWN)],
    "cdlclosingmarubozu": [("a.y > a.bl AND ((a.w = 1 AND a.u < a.sv) OR (a.w = -1 AND a.d < a.sv))", _OWN)],
    "cdlconcealbabyswall": [("d.w = -1 AND c.w = -1 AND b.w = -1 AND a.w = -1 AND d.d < d.sv AND d.u < d.sv AND c.d < c.sv AND c.u < c.sv AND DOWN(b,c) AND b.u > b.sv AND b.h > c.c AND a.h > b.h AND a.l < b.l", _UP)],
    "cdlcounterattack": [("b.w = -a.w AND b.y > b.bl AND a.y > a.bl AND SAME(a.c,b.c,b.eq)", _OWN)],
    "cdldoji": [("a.y <= a.bd", _UP)],
    "cdldojistar": [("b.y > b.bl AND a.y <= a.bd AND ((b.w = 1 AND UP(a,b)) OR (b.w = -1 AND DOWN(a,b)))", _AGAINST)],
    "cdldragonflydoji": [("a.y <= a.bd AND a.u < a.sv AND a.d > a.sv", _UP)],
    "cdlengulfing": [("a.w = 1 AND b.w = -1 AND ((a.c >= b.o AND a.o < b.c) OR (a.c > b.o AND a.o <= b.c))", _UP), ("a.w = -1 AND b.w = 1 AND ((a.o >= b.c AND a.c < b.o) OR (a.o > b.c AND a.c <= b.o))", _FALL)],
    "cdlgapsidesidewhite": [("b.w = 1 AND a.w = 1 AND SAME(a.y,b.y,b.ne) AND SAME(a.o,b.o,b.eq) AND UP(b,c) AND UP(a,c)", _UP), ("b.w = 1 AND a.w = 1 AND SAME(a.y,b.y,b.ne) AND SAME(a.o,b.o,b.eq) AND DOWN(b,c) AND DOWN(a,c)", _FALL)],
    "cdlgravestonedoji": [("a.y <= a.bd AND a.d < a.sv AND a.u > a.sv", _UP)],
    "cdlhammer": [("a.y < a.bl AND a.d > a.y AND a.u < a.sv AND a.m <= b.l + b.ne", _UP)],
    "cdlhangingman": [("a.y < a.bl AND a.d > a.y AND a.u < a.sv AND a.m >= b.h - b.ne", _FALL)],
    "cdlharami": [("b.y > b.bl AND a.y <= a.bl AND IN(a,b)", _AGAINST)],
    "cdlharamicross": [("b.y > b.bl AND a.y <= a.bd AND IN(a,b)", _AGAINST)],
    "cdlhighwave": [("a.y < a.bl AND a.u > 2 * a.y AND a.d > 2 * a.y", _OWN)],
    "cdlhikkake": [("b.h < c.h AND b.l > c.l AND a.h < b.h AND a.l < b.l", _UP), ("b.h < c.h AND b.l > c.l AND a.h > b.h AND a.l > b.l", _FALL)],
    "cdlhikkakemod": [("c.h < d.h AND c.l > d.l AND b.h < c.h AND b.l > c.l AND a.h < b.h AND a.l < b.l AND c.c <= c.l + c.ne", _UP), ("c.h < d.h AND c.l > d.l AND b.h < c.h AND b.l > c.l AND a.h > b.h AND a.l > b.l AND c.c >= c.h - c.ne", _FALL)],
    "cdlhomingpigeon": [("b.w = -1 AND a.w = -1 AND b.y > b.bl AND a.y <= a.bl AND a.o < b.o AND a.c > b.c", _UP)],
    "cdlidentical3crows": [("c.w = -1 AND b.w = -1 AND a.w = -1 AND c.d < c.sv AND b.d < b.sv AND a.d < a.sv AND c.c > b.c AND b.c > a.c AND SAME(b.o,c.c,c.eq) AND SAME(a.o,b.c,b.eq)", _FALL)],
    "cdlinneck": [("b.w = -1 AND b.y > b.bl AND a.w = 1 AND a.o < b.l AND a.c BETWEEN b.c AND b.c + b.eq", _FALL)],
    "cdlinvertedhammer": [("a.y < a.bl AND a.u > a.y AND a.d < a.sv AND DOWN(a,b)", _UP)],
    "cdlkicking": [("b.w = -a.w AND BARE(b) AND BARE(a) AND ((b.w = -1 AND a.l > b.h) OR (b.w = 1 AND a.h < b.l))", _OWN)],
    "cdlkickingbylength": [("b.w = -a.w AND BARE(b) AND BARE(a) AND ((b.w = -1 AND a.l > b.h) OR (b.w = 1 AND a.h < b.l))", "CASE WHEN a.y > b.y THEN a.w ELSE b.w END * 100")],
    "cdlladderbottom": [("e.w = -1 AND d.w = -1 AND c.w = -1 AND e.o > d.o AND d.o > c.o AND e.c > d.c AND d.c > c.c AND b.w = -1 AND b.u > b.sv AND a.w = 1 AND a.o > b.o AND a.c > b.h", _UP)],
    "cdllongleggeddoji": [("a.y <= a.bd AND (a.d > a.y OR a.u > a.y)", _UP)],
    "cdllongline": [("a.y > a.bl AND a.u < a.ss AND a.d < a.ss", _OWN)],
    "cdlmarubozu": [("BARE(a)", _OWN)],
    "cdlmatchinglow": [("b.w = -1 AND a.w = -1 AND SAME(a.c,b.c,b.eq)", _UP)],
    "cdlonneck": [("b.w = -1 AND b.y > b.bl AND a.w = 1 AND a.o < b.l AND SAME(a.c,b.l,b.eq)", _FALL)],
    "cdlpiercing": [("b.w = -1 AND b.y > b.bl AND a.w = 1 AND a.y > a.bl AND a.o < b.l AND a.c < b.o AND a.c > b.c + b.y * 0.5", _UP)],
    "cdlrickshawman": [("a.y <= a.bd AND a.d > a.y AND a.u > a.y AND a.m <= a.l + a.g / 2 + a.ne AND a.t >= a.l + a.g / 2 - a.ne", _UP)],
    "cdlrisefall3methods": [("e.y > e.bl AND a.y > a.bl AND " + _SMALL3 + " AND e.w = -d.w AND d.w = c.w AND c.w = b.w AND b.w = -a.w AND d.m < e.h AND d.t > e.l AND c.m < e.h AND c.t > e.l AND b.m < e.h AND b.t > e.l AND c.c * e.w < d.c * e.w AND b.c * e.w < c.c * e.w AND a.o * e.w > b.c * e.w AND a.c * e.w > e.c * e.w", "e.w * 100")],
    "cdlseparatinglines": [("b.w = -a.w AND SAME(a.o,b.o,b.eq) AND a.y > a.bl AND ((a.w = 1 AND a.d < a.sv) OR (a.w = -1 AND a.u < a.sv))", _OWN)],
    "cdlshootingstar": [("a.y < a.bl AND a.u > a.y AND a.d < a.sv AND UP(a,b)", _FALL)],
    "cdlshortline": [("a.y < a.bl AND a.u < a.ss AND a.d < a.ss", _OWN)],
    "cdlspinningtop": [("a.y < a.bl AND a.u > a.y AND a.d > a.y", _OWN)],
    "cdlstalledpattern": [(_ADVANCE + " AND c.y > c.bl AND b.y > b.bl AND b.u < b.sv AND a.y < a.bl AND a.o >= b.c - a.y - b.ne", _FALL)],
    "cdlsticksandwich": [("c.w = -1 AND b.w = 1 AND a.w = -1 AND b.l > c.c AND SAME(a.c,c.c,c.eq)", _UP)],
    "cdltakuri": [("a.y <= a.bd AND a.u < a.sv AND a.d > 2 * a.y", _UP)],
    "cdltasukigap": [("UP(b,c) AND b.w = 1 AND a.w = -1 AND a.o < b.c AND a.o > b.o AND a.c < b.o AND a.c > c.t AND abs(b.y - a.y) < b.ne", _UP), ("DOWN(b,c) AND b.w = -1 AND a.w = 1 AND a.o < b.o AND a.o > b.c AND a.c > b.o AND a.c < c.m AND abs(b.y - a.y) < b.ne", _FALL)],
    "cdlthrusting": [("b.w = -1 AND b.y > b.bl AND a.w = 1 AND a.o < b.l AND a.c > b.c + b.eq AND a.c <= b.c + b.y * 0.5", _FALL)],
    "cdltristar": [("c.y <= c.bd AND b.y <= c.bd AND a.y <= c.bd AND UP(b,c) AND a.t < b.t", _FALL), ("c.y <= c.bd AND b.y <= c.bd AND a.y <= c.bd AND DOWN(b,c) AND a.m > b.m", _UP)],
    "cdlunique3river": [("c.y > c.bl AND c.w = -1 AND b.w = -1 AND b.c > c.c AND b.o <= c.o AND b.l < c.l AND a.y < a.bl AND a.w = 1 AND a.o > b.l", _UP)],
    "cdlupsidegap2crows": [("c.w = 1 AND c.y > c.bl AND b.w = -1 AND b.y <= b.bl AND UP(b,c) AND a.w = -1 AND a.o > b.o AND a.c < b.c AND a.c > c.c", _FALL)],
    "cdlxsidegap3methods": [("c.w = b.w AND b.w = -a.w AND a.o < b.t AND a.o > b.m AND a.c < c.t AND a.c > c.m AND ((c.w = 1 AND UP(b,c)) OR (c.w = -1 AND DOWN(b,c)))", "c.w * 100")],
    "cdlabandonedbaby": [("c.y > c.bl AND b.y <= b.bd AND a.y > a.bl AND c.w = 1 AND a.w = -1 AND a.c < c.c - c.y * 0.3 AND b.l > c.h AND a.h < b.l", _FALL), ("c.y > c.bl AND b.y <= b.bd AND a.y > a.bl AND c.w = -1 AND a.w = 1 AND a.c > c.c + c.y * 0.3 AND b.h < c.l AND a.l > b.h", _UP)],
    "cdldarkcloudcover": [("b.w = 1 AND b.y > b.bl AND a.w = -1 AND a.o > b.h AND a.c > b.o AND a.c < b.c - b.y * 0.5", _FALL)],
    "cdleveningdojistar": [("c.y > c.bl AND c.w = 1 AND b.y <= b.bd AND UP(b,c) AND a.y > a.bl AND a.w = -1 AND a.c < c.c - c.y * 0.3", _FALL)],
    "cdleveningstar": [("c.y > c.bl AND c.w = 1 AND b.y <= b.bl AND UP(b,c) AND a.y > a.bl AND a.w = -1 AND a.c < c.c - c.y * 0.3", _FALL)],
    "cdlmorningdojistar": [("c.y > c.bl AND c.w = -1 AND b.y <= b.bd AND DOWN(b,c) AND a.y > a.bl AND a.w = 1 AND a.c > c.c + c.y * 0.3", _UP)],
    "cdlmorningstar": [("c.y > c.bl AND c.w = -1 AND b.y <= b.bl AND DOWN(b,c) AND a.y > a.bl AND a.w = 1 AND a.c > c.c + c.y * 0.3", _UP)],
    "cdlmathold": [("e.y > e.bl AND " + _SMALL3 + " AND e.w = 1 AND d.w = -1 AND a.w = 1 AND UP(d,e) AND c.m < e.c AND b.m < e.c AND c.m > e.c - e.y * 0.5 AND b.m > e.c - e.y * 0.5 AND c.t < d.o AND b.t < c.t AND a.o > b.c AND a.c > greatest(d.h, c.h, b.h)", _UP)],
}


def _expanded(text: str) -> str:
    for pattern, into in _MACROS.items():
        text = re.sub(pattern, into, text)
    return text


def columns(names: list[str]) -> str:
    """One column per pattern over :func:`candles`; 0 during the first 14 bars."""
    out = []
    for n in names:
        cases = " ".join(f"WHEN {_expanded(condition)} THEN {value}" for condition, value in CASES[n])
        out.append(f"CASE WHEN p <= 14 THEN 0 {cases} ELSE 0 END AS {n}")
    return ", ".join(out)


def candles(source: str = "bars") -> str:
    """Common tables that end with ``k``: each bar with the structs ``a`` to ``e``."""
    lags = ", ".join(f"lag(a, {i}) OVER {_ROW} AS {n}" for i, n in enumerate("bcde", 1))
    return f"""k0 AS (SELECT *, row_number() OVER {_ROW} AS p, abs(close - open) AS y, high - low AS g, high - greatest(open, close) AS u, least(open, close) - low AS d0, high - low - abs(close - open) AS sh FROM {source}),
    k1 AS (SELECT symbol, ts, p, struct_pack(o := open, h := high, l := low, c := close, y := y, g := g, u := u, d := d0, w := CASE WHEN close >= open THEN 1 ELSE -1 END, t := greatest(open, close), m := least(open, close),
      bl := avg(y) OVER {_TEN}, bd := 0.1 * avg(g) OVER {_TEN}, sv := 0.1 * avg(g) OVER {_TEN}, ss := 0.5 * avg(sh) OVER {_TEN}, ne := 0.2 * avg(g) OVER {_FIVE}, fa := 0.6 * avg(g) OVER {_FIVE}, eq := 0.05 * avg(g) OVER {_FIVE}) AS a FROM k0),
    k AS (SELECT symbol, ts, p, a, {lags} FROM k1)"""
