"""All registered queries over the driver's tables, by name, and their SQL.

Queries build bars from ``events`` or ``lineitem``, apply one operator, and round what
is not whole, so that engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import candle_sql, loop_sql, smooth_sql
from .functions import blocks
from .functions import conditions as C
from .functions import indicators as I
from .functions.candles import PATTERNS
from .functions.indicators import Spec
from .functions.kernels import RECURSIVE
from .functions.windowed import Series
from .operators import bars as B
from .operators import bricks, montecarlo, regimes, signals
from .operators import opencross as X
from .operators import statistics as S
from .operators.orders import Commission, MaxBars, Sizing, TrailingStop, condition_exit, static_stop, static_target
from .plans import backtest as P
from .plans import blockwise
from .plans import search as G
from .plans import validation as V
from .plans.strategies import REGISTRY
from .sources import export
from .sources.tables import epoch, event_bars, lineitem_bars, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return wrap


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def _events(seconds: int = 3600, pooled: bool = False) -> str:
    symbol = "'ALL'" if pooled else "e.event_type"
    return f"""bars AS (
      SELECT {symbol} AS symbol, CAST(floor(epoch(e.ts) / {seconds}) * {seconds} AS BIGINT) AS ts, arg_min(e.value, e.ts) AS open, max(e.value) AS high,
        min(e.value) AS low, arg_max(e.value, e.ts) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM events e GROUP BY 1, 2)"""


_LINE = """bars AS (
  SELECT symbol, ts, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(size) AS volume FROM (
    SELECT l_returnflag AS symbol, CAST(floor(epoch(l_shipdate) / 86400) * 86400 AS BIGINT) AS ts, l_extendedprice / l_quantity AS price, l_quantity AS size,
      (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) AS k FROM lineitem)
  GROUP BY 1, 2)"""
_BARS = "symbol, ts, open, high, low, close, volume"
_RBARS = f"symbol, ts, {_r('open')} AS open, {_r('high')} AS high, {_r('low')} AS low, {_r('close')} AS close, {_r('volume')} AS volume"
_W = "(PARTITION BY symbol ORDER BY ts)"


def _frame(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n: int, x: str) -> str:
    return f"CASE WHEN row_number() OVER {_W} >= {n} THEN {_r(x)} END"


# Bars


@query("bars_events_1h", f"WITH {_events()} SELECT {_RBARS} FROM bars")
def bars_events_1h(spark, d):
    return rounded(event_bars(spark, d))


_RBARS8 = f"symbol, ts, {_r('open', 8)} AS open, {_r('high', 8)} AS high, {_r('low', 8)} AS low, {_r('close', 8)} AS close, {_r('volume')} AS volume"


@query("bars_lineitem_1d", f"WITH {_LINE} SELECT {_RBARS8} FROM bars")
def bars_lineitem_1d(spark, d):
    return rounded(lineitem_bars(spark, d), 8)


_AGG = "arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume"


@query("aggregate_4h", f"WITH {_events()}, a AS (SELECT symbol, ts // 14400 * 14400 AS bar, {_AGG} FROM bars GROUP BY 1, 2) SELECT symbol, bar AS ts, {_r('open')} AS open, {_r('high')} AS high, {_r('low')} AS low, {_r('close')} AS close, {_r('volume')} AS volume FROM a")
def aggregate_4h(spark, d):
    B.check_ratio(3600, 14400)
    return rounded(B.aggregate(event_bars(spark, d), 14400))


def _resampled(unit: str) -> str:
    return f"WITH {_LINE}, a AS (SELECT symbol, CAST(epoch(date_trunc('{unit}', make_timestamp(ts * 1000000))) AS BIGINT) AS bar, {_AGG} FROM bars GROUP BY 1, 2) SELECT symbol, bar AS ts, {_r('open', 8)} AS open, {_r('high', 8)} AS high, {_r('low', 8)} AS low, {_r('close', 8)} AS close, {_r('volume')} AS volume FROM a"


@query("resample_week", _resampled("week"))
def resample_week(spark, d):
    return rounded(B.resample(lineitem_bars(spark, d), "1w"), 8)


@query("resample_month", _resampled("month"))
def resample_month(spark, d):
    return rounded(B.resample(lineitem_bars(spark, d), "1M"), 8)


def _frames(seconds: int, name: str) -> str:
    return f"SELECT '{name}' AS timeframe, symbol, bars.ts // {seconds} * {seconds} AS ts, {_AGG.replace('ts)', 'bars.ts)')} FROM bars GROUP BY ALL"


@query("timeframe_bundle", f"WITH {_events()}, a AS (SELECT '1h' AS timeframe, * FROM bars UNION ALL BY NAME {_frames(14400, '4h')} UNION ALL BY NAME {_frames(86400, '1d')}) SELECT timeframe, {_RBARS} FROM a")
def timeframe_bundle(spark, d):
    return rounded(B.bundle(event_bars(spark, d), "1h", ["4h", "1d"]))


@query("as_of_higher", f"WITH {_events()}, h AS (SELECT symbol, ts // 86400 * 86400 + 86400 AS at, arg_max(close, ts) AS h_close FROM bars GROUP BY 1, 2) SELECT b.symbol, b.ts, {_r('b.close')} AS close, {_r('h.h_close')} AS h_close FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.ts >= h.at".replace("ts // 86400 * 86400 + 86400 AS at", "bars.ts // 86400 * 86400 + 86400 AS at"))
def as_of_higher(spark, d):
    b = event_bars(spark, d)
    return rounded(B.as_of_higher(b, B.aggregate(b, 86400), 86400, ["close"]).select("symbol", "ts", "close", "h_close"))


@query("merge_latest", f"WITH {_events()}, h AS (SELECT symbol, bars.ts // 14400 * 14400 AS at, arg_max(close, ts) AS close FROM bars GROUP BY 1, 2) SELECT coalesce(b.symbol, h.symbol) AS symbol, coalesce(b.ts, h.at) AS ts, {_r('coalesce(h.close, b.close)')} AS close FROM bars b FULL OUTER JOIN h ON h.symbol = b.symbol AND h.at = b.ts")
def merge_latest(spark, d):
    """Hourly bars under four-hourly ones, which win at the times that they share."""
    b = event_bars(spark, d)
    return rounded(B.merge_latest([b, B.aggregate(b, 14400)]).select("symbol", "ts", "close"))


@query("upsert_open_bar", f"WITH {_events()}, a AS (SELECT symbol, ts // 14400 * 14400 AS bar, {_AGG} FROM bars GROUP BY 1, 2) SELECT symbol, bar AS ts, {_r('open')} AS open, {_r('high')} AS high, {_r('low')} AS low, {_r('close')} AS close, {_r('volume')} AS volume FROM a")
def upsert_open_bar(spark, d):
    b = event_bars(spark, d)
    stored = B.aggregate(b.where("ts < 1705000000"), 14400)
    return rounded(B.upsert_open_bar(stored, b, 14400))


@query("catalogue", f"WITH {_events()} SELECT symbol, count(*) AS records, min(ts) AS first_ts, max(ts) AS last_ts, {_r('arg_min(close, ts)')} AS first_close, {_r('arg_max(close, ts)')} AS last_close FROM bars GROUP BY 1")
def catalogue(spark, d):
    return rounded(B.catalogue(event_bars(spark, d)))


@query("head_and_tail", f"WITH {_events()}, n AS (SELECT *, row_number() OVER {_W} AS from_start, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS from_end FROM bars) SELECT symbol, ts, from_start, from_end FROM n WHERE from_start <= 5 OR from_end <= 5")
def head_and_tail(spark, d):
    return B.head_and_tail(event_bars(spark, d)).select("symbol", "ts", F.col("from_start").cast("long").alias("from_start"), F.col("from_end").cast("long").alias("from_end"))


@query("slice_by_ordinal", f"WITH {_events()}, n AS (SELECT *, row_number() OVER {_W} - 1 AS ordinal FROM bars) SELECT symbol, ts, ordinal FROM n WHERE ordinal BETWEEN 100 AND 149")
def slice_by_ordinal(spark, d):
    return B.by_ordinal(event_bars(spark, d), 100, 50).select("symbol", "ts", F.col("ordinal").cast("long").alias("ordinal"))


@query("range_scan", f"WITH {_LINE} SELECT {_RBARS8} FROM bars WHERE ts BETWEEN 800000000 AND 820000000")
def range_scan(spark, d):
    return rounded(lineitem_bars(spark, d).where(F.col("ts").between(800000000, 820000000)), 8)


@query("irregularities", f"WITH {_events()}, g AS (SELECT symbol, ts, lag(ts) OVER {_W} AS previous_ts FROM bars) SELECT symbol, ts, previous_ts, ts - previous_ts AS diff, CASE WHEN ts = previous_ts THEN 'duplicate' WHEN ts < previous_ts THEN 'out_of_order' ELSE 'gap' END AS kind FROM g WHERE ts - previous_ts <> 3600")
def irregularities(spark, d):
    return B.irregularities(event_bars(spark, d), 3600)


@query("irregular_arrivals", "WITH a AS (SELECT o_orderpriority AS symbol, CAST(floor(epoch(o_orderdate) / 86400) * 86400 AS BIGINT) AS ts, o_orderkey AS i FROM orders), g AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY i) AS previous_ts FROM a) SELECT symbol, CASE WHEN ts = previous_ts THEN 'duplicate' WHEN ts < previous_ts THEN 'out_of_order' ELSE 'gap' END AS kind, count(*) AS rows, CAST(sum(ts - previous_ts) AS BIGINT) AS total FROM g WHERE ts - previous_ts <> 86400 GROUP BY 1, 2")
def irregular_arrivals(spark, d):
    """Orders as daily rows in the order of their keys: gaps, duplicates and rows out of order."""
    o = table(spark, d, "orders")
    day = (F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400) * 86400).cast("long")
    found = B.irregularities(o.select(F.col("o_orderpriority").alias("symbol"), day.alias("ts"), F.col("o_orderkey").alias("i")), 86400, "i")
    return found.groupBy("symbol", "kind").agg(F.count("*").alias("rows"), F.sum("diff").alias("total"))


@query("missing_ranges", f"""WITH {_events()}, e AS (SELECT symbol, min(ts) AS a, max(ts) AS b FROM bars GROUP BY 1), r AS (
  SELECT symbol, previous + 3600 AS start, ts - 1 AS stop FROM (SELECT symbol, ts, lag(ts) OVER {_W} AS previous FROM bars) WHERE ts - previous > 3600
  UNION ALL SELECT symbol, 1704000000, a - 1 FROM e UNION ALL SELECT symbol, b + 3600, 1706800000 FROM e)
SELECT symbol, CAST(greatest(start, 1704000000) AS BIGINT) AS start, CAST(least(stop, 1706800000) AS BIGINT) AS stop FROM r WHERE greatest(start, 1704000000) <= least(stop, 1706800000)""")
def missing_ranges(spark, d):
    return B.missing_ranges(event_bars(spark, d), 3600, 1704000000, 1706800000)


@query("coalesce_intervals", """WITH o AS (SELECT o_orderpriority AS symbol, CAST(epoch(o_orderdate) AS BIGINT) AS start, CAST(epoch(o_orderdate) AS BIGINT) + (o_orderkey % 3) * 43200 AS stop FROM orders),
g AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY symbol ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS fresh FROM o),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS grp FROM g)
SELECT symbol, min(start) AS start, max(stop) AS stop FROM s GROUP BY symbol, grp""")
def coalesce_intervals(spark, d):
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    spans = table(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), start.alias("start"), (start + (F.col("o_orderkey") % 3) * 43200).alias("stop"))
    return B.coalesce_intervals(spans)


@query("monthly_gaps", "SELECT symbol, strftime(expected, '%Y-%m-%d') AS expected, strftime(month, '%Y-%m-%d') AS month FROM (SELECT symbol, month, lag(month) OVER (PARTITION BY symbol ORDER BY month) + INTERVAL 1 MONTH AS expected FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS symbol, date_trunc('month', l_shipdate) AS month FROM lineitem)) WHERE month > expected")
def monthly_gaps(spark, d):
    """Months in which a supplier shipped nothing."""
    shipped = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), epoch("l_shipdate").alias("ts"))
    return B.monthly_gaps(shipped).select("symbol", F.col("expected").cast("string").alias("expected"), F.col("month").cast("string").alias("month"))


# Indicators


def _indicated(spark, d, specs: list[Spec]) -> DataFrame:
    df = I.compute(event_bars(spark, d), specs, seconds=3600)
    return rounded(df.drop("open", "high", "low", "close", "volume"))


def _lags(n: int, weight: Callable[[int], float]) -> str:
    return " + ".join(f"{weight(k)} * lag(close, {k}) OVER {_W}" if k else f"{weight(0)} * close" for k in range(n))


@query(
    "ind_overlap",
    f"""WITH {_events()} SELECT symbol, ts, {_full(20, f'avg(close) OVER {_frame(20)}')} AS sma, {_r('(' + _lags(10, lambda k: 10 - k) + ') / 55.0')} AS wma,
    {_full(14, f'(max(close) OVER {_frame(14)} + min(close) OVER {_frame(14)}) / 2')} AS midpoint, {_full(14, f'(max(high) OVER {_frame(14)} + min(low) OVER {_frame(14)}) / 2')} AS midprice,
    {_full(20, f'avg(close) OVER {_frame(20)} + 2 * stddev_pop(close) OVER {_frame(20)}')} AS bbands_upper, {_full(20, f'avg(close) OVER {_frame(20)}')} AS bbands_middle,
    {_full(20, f'avg(close) OVER {_frame(20)} - 2 * stddev_pop(close) OVER {_frame(20)}')} AS bbands_lower FROM bars""",
)
def ind_overlap(spark, d):
    return _indicated(spark, d, [Spec("sma", {"period": 20}), Spec("wma", {"period": 10}), Spec("midpoint"), Spec("midprice"), Spec("bbands", {"period": 20})])


_HL = f"(max(high) OVER {_frame(14)} - min(low) OVER {_frame(14)})"


@query(
    "ind_momentum",
    f"""WITH {_events()} SELECT symbol, ts, {_r(f'close - lag(close, 10) OVER {_W}')} AS mom, {_r(f'(close / lag(close, 10) OVER {_W} - 1) * 100')} AS roc,
    {_full(14, f'CASE WHEN {_HL} = 0 THEN 0 ELSE (max(high) OVER {_frame(14)} - close) / {_HL} * -100 END')} AS willr, {_r('CASE WHEN high > low THEN (close - open) / (high - low) ELSE 0 END')} AS bop,
    {_full(26, f'(avg(close) OVER {_frame(12)} - avg(close) OVER {_frame(26)})')} AS apo, {_full(26, f'(avg(close) OVER {_frame(12)} - avg(close) OVER {_frame(26)}) / (avg(close) OVER {_frame(26)}) * 100')} AS ppo FROM bars""",
)
def ind_momentum(spark, d):
    return _indicated(spark, d, [Spec("mom"), Spec("roc"), Spec("willr"), Spec("bop"), Spec("apo"), Spec("ppo")])


@query(
    "ind_aroon_cci",
    f"""WITH {_events()}, n AS (SELECT *, row_number() OVER {_W} AS p, (high + low + close) / 3 AS tp FROM bars),
    w AS (SELECT n.symbol, n.ts, n.p, n.tp, arg_max(m.p, (m.high, m.p)) AS hi, arg_max(m.p, (-m.low, m.p)) AS lo FROM n JOIN n m ON m.symbol = n.symbol AND m.p BETWEEN n.p - 14 AND n.p GROUP BY 1, 2, 3, 4),
    a AS (SELECT n.symbol, n.ts, avg(m.tp) AS mean FROM n JOIN n m ON m.symbol = n.symbol AND m.p BETWEEN n.p - 13 AND n.p GROUP BY 1, 2),
    v AS (SELECT n.symbol, n.ts, a.mean, avg(abs(m.tp - a.mean)) AS dev FROM n JOIN a ON a.symbol = n.symbol AND a.ts = n.ts JOIN n m ON m.symbol = n.symbol AND m.p BETWEEN n.p - 13 AND n.p GROUP BY 1, 2, 3)
    SELECT w.symbol, w.ts, CASE WHEN p > 14 THEN {_r('(14 - (p - lo)) * 100.0 / 14')} END AS aroon_aroondown, CASE WHEN p > 14 THEN {_r('(14 - (p - hi)) * 100.0 / 14')} END AS aroon_aroonup,
    CASE WHEN p >= 14 THEN {_r('(tp - mean) / (0.015 * dev)')} END AS cci FROM w JOIN v ON v.symbol = w.symbol AND v.ts = w.ts""",
)
def ind_aroon_cci(spark, d):
    return _indicated(spark, d, [Spec("aroon"), Spec("cci")])


_K = f"CASE WHEN max(high) OVER {_frame(5)} = min(low) OVER {_frame(5)} THEN 0 ELSE (close - min(low) OVER {_frame(5)}) / (max(high) OVER {_frame(5)} - min(low) OVER {_frame(5)}) * 100 END"


@query(
    "ind_stoch",
    f"""WITH {_events()}, k AS (SELECT symbol, ts, CASE WHEN row_number() OVER {_W} >= 5 THEN {_K} END AS k FROM bars),
    s AS (SELECT symbol, ts, k, CASE WHEN row_number() OVER {_W} >= 7 THEN avg(k) OVER {_frame(3)} END AS slow FROM k)
    SELECT symbol, ts, CASE WHEN row_number() OVER {_W} >= 7 THEN {_r('k')} END AS stochf_fastk, {_r('slow')} AS stochf_fastd, CASE WHEN row_number() OVER {_W} >= 9 THEN {_r('slow')} END AS stoch_slowk,
    CASE WHEN row_number() OVER {_W} >= 9 THEN {_r(f'avg(slow) OVER {_frame(3)}')} END AS stoch_slowd FROM s""",
)
def ind_stoch(spark, d):
    return _indicated(spark, d, [Spec("stochf"), Spec("stoch")])


@query(
    "ind_volume",
    f"""WITH {_events()}, p AS (SELECT *, lag(close) OVER {_W} AS before, (high + low + close) / 3 AS tp, lag((high + low + close) / 3) OVER {_W} AS tpb FROM bars),
    f AS (SELECT *, CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END AS flow, CASE WHEN tp > tpb THEN tp * volume ELSE 0 END AS up, CASE WHEN tp < tpb THEN tp * volume ELSE 0 END AS down,
      CASE WHEN before IS NULL OR close > before THEN 1 WHEN close < before THEN -1 ELSE 0 END * volume AS signed FROM p)
    SELECT symbol, ts, {_r(f'sum(flow) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)')} AS ad, {_r(f'sum(signed) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)')} AS obv,
    CASE WHEN row_number() OVER {_W} > 14 THEN {_r(f'CASE WHEN sum(up) OVER {_frame(14)} + sum(down) OVER {_frame(14)} < 1 THEN 0 ELSE 100 * sum(up) OVER {_frame(14)} / (sum(up) OVER {_frame(14)} + sum(down) OVER {_frame(14)}) END')} END AS mfi,
    CASE WHEN before IS NOT NULL THEN {_r('greatest(high - low, abs(high - before), abs(low - before))')} END AS trange FROM f""",
)
def ind_volume(spark, d):
    return _indicated(spark, d, [Spec("ad"), Spec("obv"), Spec("mfi"), Spec("trange")])


@query(
    "ind_statistics",
    f"""WITH {_events()}, n AS (SELECT *, CAST(row_number() OVER {_W} AS DOUBLE) AS p FROM bars) SELECT symbol, ts, {_full(5, f'stddev_pop(close) OVER {_frame(5)}')} AS stddev, {_full(5, f'var_pop(close) OVER {_frame(5)}')} AS var,
    {_full(30, f'corr(high, low) OVER {_frame(30)}')} AS correl, {_full(14, f'regr_slope(close, p) OVER {_frame(14)}')} AS linearreg_slope, {_full(14, f'regr_intercept(close, p) OVER {_frame(14)} + regr_slope(close, p) OVER {_frame(14)} * p')} AS linearreg,
    {_full(14, f'regr_intercept(close, p) OVER {_frame(14)} + regr_slope(close, p) OVER {_frame(14)} * (p + 1)')} AS tsf FROM n""",
)
def ind_statistics(spark, d):
    return _indicated(spark, d, [Spec("stddev"), Spec("var"), Spec("correl"), Spec("linearreg_slope"), Spec("linearreg"), Spec("tsf")])


@query("ind_price", f"WITH {_events()} SELECT symbol, ts, {_r('(open + high + low + close) / 4')} AS avgprice, {_r('(high + low) / 2')} AS medprice, {_r('(high + low + close) / 3')} AS typprice, {_r('(high + low + 2 * close) / 4')} AS wclprice FROM bars")
def ind_price(spark, d):
    return _indicated(spark, d, [Spec("avgprice"), Spec("medprice"), Spec("typprice"), Spec("wclprice")])


@query(
    "ind_math",
    f"""WITH {_events()} SELECT symbol, ts, {_r('sqrt(close)')} AS sqrt, {_r('sin(close)')} AS sin, {_r('atan(close)')} AS atan, {_r('floor(close)')} AS floor, {_r('ceil(close)')} AS ceil,
    {_r('high + low')} AS add, {_r('high - low')} AS sub, {_r('high * low', 4)} AS mult, {_r('CASE WHEN low <> 0 THEN high / low END')} AS div, {_full(30, f'sum(close) OVER {_frame(30)}')} AS sum,
    {_full(30, f'max(close) OVER {_frame(30)}')} AS max, {_full(30, f'min(close) OVER {_frame(30)}')} AS min FROM bars""",
)
def ind_math(spark, d):
    df = I.compute(event_bars(spark, d), [Spec(n) for n in ("sqrt", "sin", "atan", "floor", "ceil", "add", "sub", "mult", "div", "sum", "max", "min")])
    return rounded(df.drop("open", "high", "low", "close", "volume").withColumn("mult", F.round("mult", 4)))


@query("ind_windowed_all")
def ind_windowed_all(spark, d):
    """Every windowed indicator with its defaults."""
    from .functions.windowed import WINDOWED

    return _indicated(spark, d, [Spec(n, {}, f"i_{n}") for n in sorted(WINDOWED)])


@query("ind_recursive_all")
def ind_recursive_all(spark, d):
    """Every recursive indicator with its defaults, in one grouped map."""
    return _indicated(spark, d, [Spec(n, {}, f"i_{n}") for n in sorted(RECURSIVE)])


_NUM = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars)"


@query(
    "ind_ema",
    f"""WITH RECURSIVE {_events()}, {_NUM}, s AS (SELECT symbol, avg(close) AS seed FROM n WHERE p <= 20 GROUP BY 1),
    r AS (SELECT n.symbol, n.p, n.ts, s.seed AS e FROM n JOIN s ON s.symbol = n.symbol WHERE n.p = 20 UNION ALL SELECT n.symbol, n.p, n.ts, r.e + 2.0 / 21 * (n.close - r.e) FROM r JOIN n ON n.symbol = r.symbol AND n.p = r.p + 1)
    SELECT n.symbol, n.ts, {_r('r.e')} AS ema FROM n LEFT JOIN r ON r.symbol = n.symbol AND r.p = n.p""",
)
def ind_ema(spark, d):
    return _indicated(spark, d, [Spec("ema", {"period": 20})])


@query(
    "ind_rsi_atr",
    f"""WITH RECURSIVE {_events()}, {_NUM}, g AS (SELECT *, close - lag(close) OVER {_W} AS ch, greatest(high - low, abs(high - lag(close) OVER {_W}), abs(low - lag(close) OVER {_W})) AS tr FROM n),
    s AS (SELECT symbol, avg(greatest(ch, 0)) AS up, avg(greatest(-ch, 0)) AS down, avg(tr) AS atr FROM g WHERE p BETWEEN 2 AND 15 GROUP BY 1),
    r AS (SELECT symbol, 15::BIGINT AS p, up, down, atr FROM s UNION ALL SELECT g.symbol, g.p, r.up + (greatest(g.ch, 0) - r.up) / 14, r.down + (greatest(-g.ch, 0) - r.down) / 14, r.atr + (g.tr - r.atr) / 14 FROM r JOIN g ON g.symbol = r.symbol AND g.p = r.p + 1)
    SELECT n.symbol, n.ts, {_r('CASE WHEN r.up + r.down = 0 THEN 0 ELSE 100 * r.up / (r.up + r.down) END')} AS rsi, {_r('r.atr')} AS atr FROM n LEFT JOIN r ON r.symbol = n.symbol AND r.p = n.p""",
)
def ind_rsi_atr(spark, d):
    return _indicated(spark, d, [Spec("rsi"), Spec("atr")])


@query(
    "ind_macd",
    f"""WITH RECURSIVE {_events()}, {_NUM}, s AS (SELECT symbol, avg(close) FILTER (WHERE p > 14) AS f, avg(close) AS l FROM n WHERE p <= 26 GROUP BY 1),
    r AS (SELECT symbol, 26::BIGINT AS p, f, l FROM s UNION ALL SELECT n.symbol, n.p, r.f + 2.0 / 13 * (n.close - r.f), r.l + 2.0 / 27 * (n.close - r.l) FROM r JOIN n ON n.symbol = r.symbol AND n.p = r.p + 1),
    m AS (SELECT symbol, p, f - l AS line FROM r), z AS (SELECT symbol, avg(line) AS seed FROM m WHERE p <= 34 GROUP BY 1),
    g AS (SELECT symbol, 34::BIGINT AS p, seed AS sig FROM z UNION ALL SELECT m.symbol, m.p, g.sig + 0.2 * (m.line - g.sig) FROM g JOIN m ON m.symbol = g.symbol AND m.p = g.p + 1)
    SELECT n.symbol, n.ts, {_r('CASE WHEN g.sig IS NOT NULL THEN m.line END')} AS macd_macd, {_r('g.sig')} AS macd_signal, {_r('m.line - g.sig')} AS macd_histogram
    FROM n LEFT JOIN m ON m.symbol = n.symbol AND m.p = n.p LEFT JOIN g ON g.symbol = n.symbol AND g.p = n.p""",
)
def ind_macd(spark, d):
    return _indicated(spark, d, [Spec("macd")])


_RSI = "CASE WHEN g + l = 0 THEN 0 ELSE 100 * g / (g + l) END"


@query(
    "ind_adaptive",
    f"""WITH RECURSIVE {_events()}, {_NUM}, d AS (SELECT *, abs(close - lag(close) OVER {_W}) AS mv, lag(close, 10) OVER {_W} AS far, greatest(close - lag(close) OVER {_W}, 0) AS up, greatest(lag(close) OVER {_W} - close, 0) AS dn FROM n),
    e AS (SELECT *, sum(mv) OVER {_frame(10)} AS path, abs(close - far) AS net, {smooth_sql.wilder('up', 14)} AS g, {smooth_sql.wilder('dn', 14)} AS l,
      {smooth_sql.smoothed('close', 0.15, 'avg(CASE WHEN p BETWEEN 15 AND 26 THEN close END) OVER (PARTITION BY symbol)', 26)} - {smooth_sql.smoothed('close', 0.075, 'avg(CASE WHEN p <= 26 THEN close END) OVER (PARTITION BY symbol)', 26)} AS fix,
      CASE WHEN p >= 26 THEN avg(close) OVER {_frame(12)} - avg(close) OVER {_frame(26)} END AS ext FROM d),
    c AS (SELECT *, {_RSI} AS r, pow((CASE WHEN path <= net THEN 1.0 WHEN path > 0 THEN net / path ELSE 0.0 END) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS sc, {smooth_sql.ema('fix', 9, 26)} AS fixed, CASE WHEN p >= 34 THEN avg(ext) OVER {_frame(9)} END AS extended FROM e),
    k AS (SELECT symbol, p, close AS k FROM c WHERE p = 10 UNION ALL SELECT c.symbol, c.p, k.k + c.sc * (c.close - k.k) FROM k JOIN c ON c.symbol = k.symbol AND c.p = k.p + 1),
    x AS (SELECT *, min(r) OVER {_frame(5)} AS low_r, max(r) OVER {_frame(5)} AS high_r FROM c), y AS (SELECT *, CASE WHEN p >= 19 THEN CASE WHEN high_r > low_r THEN (r - low_r) / (high_r - low_r) * 100 ELSE 0 END END AS fast FROM x), z AS (SELECT *, CASE WHEN p >= 21 THEN avg(fast) OVER {_frame(3)} END AS slow FROM y),
    v AS (SELECT a.symbol, a.p, avg(b.close) AS mean FROM n a JOIN n b ON b.symbol = a.symbol AND b.p BETWEEN a.p - least(greatest(CAST(floor(a.volume) AS BIGINT), 2), 30) + 1 AND a.p GROUP BY 1, 2)
    SELECT z.symbol, z.ts, CASE WHEN z.p > 10 THEN {_r('k.k')} END AS kama, {_r('CASE WHEN fixed IS NOT NULL THEN fix END')} AS macdfix_macd, {_r('fixed')} AS macdfix_signal, {_r('fix - fixed')} AS macdfix_histogram,
      {_r('CASE WHEN extended IS NOT NULL THEN ext END')} AS macdext_macd, {_r('extended')} AS macdext_signal, {_r('ext - extended')} AS macdext_histogram, {_r('CASE WHEN slow IS NOT NULL THEN fast END')} AS stochrsi_fastk, {_r('slow')} AS stochrsi_fastd,
      CASE WHEN z.p >= 30 THEN {_r('v.mean')} END AS mavp, {_full(20, f'avg(z.close) OVER (PARTITION BY z.symbol ORDER BY z.ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)').replace(_W, '(PARTITION BY z.symbol ORDER BY z.ts)')} AS ma
    FROM z LEFT JOIN k ON k.symbol = z.symbol AND k.p = z.p JOIN v ON v.symbol = z.symbol AND v.p = z.p""",
)
def ind_adaptive(spark, d):
    """Means with a factor or a period of each bar's own, and means of means, in blocks of 128 bars."""
    specs = [Spec("kama", {"period": 10}), Spec("macdfix"), Spec("macdext"), Spec("stochrsi"), Spec("mavp"), Spec("ma", {"period": 20})]
    df = I.compute(event_bars(spark, d), specs, seconds=3600, rows=128)
    return rounded(df.drop("open", "high", "low", "close", "volume"))


@query("ind_directional", f"WITH {_events()}, {_NUM}, {smooth_sql.directional()} SELECT symbol, ts, {_r('adx')} AS adx, {_r('adxr')} AS adxr, {_r('dx')} AS dx, {_r('plus_di')} AS plus_di, {_r('minus_di')} AS minus_di, {_r('plus_dm')} AS plus_dm, {_r('minus_dm')} AS minus_dm FROM x")
def ind_directional(spark, d):
    return _indicated(spark, d, [Spec(n) for n in ("adx", "adxr", "dx", "plus_di", "minus_di", "plus_dm", "minus_dm")])


def _chain(x: str, n: int, deep: int) -> str:
    """Common tables ``m1`` to ``m<deep>``: means of means in columns ``e1`` and on."""
    out, source = [], "n"
    for k in range(1, deep + 1):
        out.append(f"m{k} AS (SELECT *, {smooth_sql.ema(x if k == 1 else f'e{k - 1}', n, 1 + (k - 1) * (n - 1))} AS e{k} FROM {source})")
        source = f"m{k}"
    return ", ".join(out)


@query("ind_ema_chains", f"WITH {_events()}, {_NUM}, {_chain('close', 5, 6)} SELECT symbol, ts, {_r('2 * e1 - e2')} AS dema, {_r('3 * e1 - 3 * e2 + e3')} AS tema, {_r(f'(e3 / lag(e3) OVER {_W} - 1) * 100', 4)} AS trix, {_r('-0.343 * e6 + 2.499 * e5 - 6.069 * e4 + 4.913 * e3')} AS t3 FROM m6")
def ind_ema_chains(spark, d):
    out = I.compute(event_bars(spark, d), [Spec(n, {"period": 5}) for n in ("dema", "tema", "trix", "t3")])
    return rounded(out.select("symbol", "ts", "dema", "tema", F.round("trix", 4).alias("trix"), "t3"))


@query(
    "ind_wilder",
    f"""WITH {_events()}, {_NUM}, g AS (SELECT *, greatest(close - lag(close) OVER {_W}, 0) AS up, greatest(lag(close) OVER {_W} - close, 0) AS dn, greatest(high - low, abs(high - lag(close) OVER {_W}), abs(low - lag(close) OVER {_W})) AS tr,
      sum(CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * volume ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS ad FROM n),
    w AS (SELECT *, {smooth_sql.wilder('up', 14)} AS gain, {smooth_sql.wilder('dn', 14)} AS loss, {smooth_sql.wilder('tr', 14)} AS atr, {smooth_sql.smoothed('ad', 0.5, 'first_value(ad) OVER ' + _W, 1)} AS fast, {smooth_sql.smoothed('ad', 2 / 11, 'first_value(ad) OVER ' + _W, 1)} AS slow FROM g)
    SELECT symbol, ts, {_r('CASE WHEN gain + loss = 0 THEN 0 ELSE 100 * (gain - loss) / (gain + loss) END')} AS cmo, {_r('CASE WHEN atr IS NULL THEN NULL WHEN close <> 0 THEN atr / close * 100 ELSE 0 END', 4)} AS natr, CASE WHEN p >= 10 THEN {_r('fast - slow')} END AS adosc FROM w""",
)
def ind_wilder(spark, d):
    out = I.compute(event_bars(spark, d), [Spec("cmo"), Spec("natr"), Spec("adosc")], seconds=3600)
    return rounded(out.select("symbol", "ts", "cmo", F.round("natr", 4).alias("natr"), "adosc"))


_ELEMENTS = ("acos", "asin", "cos", "cosh", "exp", "ln", "log10", "sinh", "tan", "tanh")
_UNIT = "(close - min(close) OVER (PARTITION BY symbol)) / (max(close) OVER (PARTITION BY symbol) - min(close) OVER (PARTITION BY symbol)) * 0.98 + 0.01"


@query("ind_elements", f"WITH {_events()}, u AS (SELECT symbol, ts, {_UNIT} AS x FROM bars) SELECT symbol, ts, " + ", ".join(f"{_r(f'{n}(x)')} AS {n}" for n in _ELEMENTS) + " FROM u")
def ind_elements(spark, d):
    """Functions of the close, brought to between 0 and 1."""
    from pyspark.sql import Window

    b, w = event_bars(spark, d), Window.partitionBy("symbol")
    low, high = F.min("close").over(w), F.max("close").over(w)
    scaled = b.withColumn("close", (F.col("close") - low) / (high - low) * 0.98 + 0.01)
    return rounded(I.compute(scaled, [Spec(n) for n in _ELEMENTS]).select("symbol", "ts", *_ELEMENTS))


_IMI = f"sum(greatest(close - open, 0)) OVER {_frame(14)}", f"sum(greatest(open - close, 0)) OVER {_frame(14)}"


def _ulti(n: int) -> str:
    return f"CASE WHEN sum(tr) OVER {_frame(n)} <> 0 THEN sum(bp) OVER {_frame(n)} / sum(tr) OVER {_frame(n)} ELSE 0 END"


@query(
    "ind_changes",
    f"""WITH {_events()}, n AS (SELECT *, row_number() OVER {_W} AS p, lag(close, 10) OVER {_W} AS c10, greatest(lag(close) OVER {_W}, high) - least(lag(close) OVER {_W}, low) AS tr, close - least(lag(close) OVER {_W}, low) AS bp,
      CASE WHEN high + low <> 0 THEN 4 * (high - low) / (high + low) ELSE 0 END AS width FROM bars),
    h AS (SELECT n.symbol, n.ts, arg_max(m.p, (m.high, m.p)) AS hi, arg_max(m.p, (-m.low, m.p)) AS lo FROM n JOIN n m ON m.symbol = n.symbol AND m.p BETWEEN n.p - 14 AND n.p GROUP BY 1, 2),
    q AS (SELECT symbol, ts, p, {_r('CASE WHEN c10 <> 0 THEN (close - c10) / c10 WHEN c10 = 0 THEN 0 END')} AS rocp, {_r('CASE WHEN c10 <> 0 THEN close / c10 WHEN c10 = 0 THEN 0 END')} AS rocr, {_r('CASE WHEN c10 <> 0 THEN close / c10 * 100 WHEN c10 = 0 THEN 0 END', 4)} AS rocr100,
    CASE WHEN p >= 14 THEN {_r(f'CASE WHEN {_IMI[0]} + {_IMI[1]} <> 0 THEN 100 * {_IMI[0]} / ({_IMI[0]} + {_IMI[1]}) ELSE 0 END')} END AS imi, 
    CASE WHEN p > 28 THEN {_r(f'(4 * {_ulti(7)} + 2 * {_ulti(14)} + {_ulti(28)}) * 100 / 7')} END AS ultosc,
    CASE WHEN p >= 20 THEN {_r(f'avg(high * (1 + width)) OVER {_frame(20)}', 4)} END AS accbands_upper, CASE WHEN p >= 20 THEN {_r(f'avg(low * (1 - width)) OVER {_frame(20)}', 4)} END AS accbands_lower FROM n)
    SELECT q.* EXCLUDE (p), CASE WHEN p > 14 THEN {_r('(h.hi - h.lo) * 100.0 / 14')} END AS aroonosc
    FROM q JOIN h ON h.symbol = q.symbol AND h.ts = q.ts""",
)
def ind_changes(spark, d):
    out = I.compute(event_bars(spark, d), [Spec(n) for n in ("rocp", "rocr", "rocr100", "imi", "aroonosc", "ultosc", "accbands")])
    four = lambda c: F.round(c, 4).alias(c)
    return rounded(out.select("symbol", "ts", "rocp", "rocr", four("rocr100"), "imi", "aroonosc", "ultosc", four("accbands_upper"), four("accbands_lower")))


@query(
    "ind_positions",
    f"""WITH {_events()}, n AS (SELECT *, row_number() OVER {_W} AS p, CASE WHEN lag(high) OVER {_W} <> 0 THEN high / lag(high) OVER {_W} END - 1 AS ra, CASE WHEN lag(low) OVER {_W} <> 0 THEN low / lag(low) OVER {_W} END - 1 AS rb FROM bars),
    h AS (SELECT n.symbol, n.ts, arg_max(m.p, (m.close, m.p)) AS hi, arg_max(m.p, (-m.close, m.p)) AS lo FROM n JOIN n m ON m.symbol = n.symbol AND m.p BETWEEN n.p - 29 AND n.p GROUP BY 1, 2),
    a AS (SELECT n.symbol, n.ts, avg(m.close) AS mean FROM n JOIN n m ON m.symbol = n.symbol AND m.p BETWEEN n.p - 13 AND n.p GROUP BY 1, 2),
    v AS (SELECT n.symbol, n.ts, avg(abs(m.close - a.mean)) AS dev FROM n JOIN a ON a.symbol = n.symbol AND a.ts = n.ts JOIN n m ON m.symbol = n.symbol AND m.p BETWEEN n.p - 13 AND n.p GROUP BY 1, 2),
    t AS (SELECT symbol, ts, p, avg(close) OVER {_frame(5)} AS m5 FROM n)
    SELECT n.symbol, n.ts, CASE WHEN n.p >= 30 THEN h.hi - 1 END AS maxindex, CASE WHEN n.p >= 30 THEN h.lo - 1 END AS minindex, CASE WHEN n.p >= 30 THEN {_r(f'max(close) OVER {_frame(30)}')} END AS minmax_max, CASE WHEN n.p >= 30 THEN {_r('min(close) OVER (PARTITION BY n.symbol ORDER BY n.ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)')} END AS minmax_min,
    CASE WHEN n.p >= 30 THEN h.lo - 1 END AS minmaxindex_minidx, CASE WHEN n.p >= 30 THEN h.hi - 1 END AS minmaxindex_maxidx, CASE WHEN n.p >= 14 THEN {_r('v.dev')} END AS avgdev, CASE WHEN n.p >= 14 THEN {_r(f'degrees(atan(regr_slope(close, CAST(n.p AS DOUBLE)) OVER {_frame(14).replace("symbol", "n.symbol").replace("ORDER BY ts", "ORDER BY n.ts")}))')} END AS linearreg_angle,
    CASE WHEN n.p >= 14 THEN {_r(f'regr_intercept(close, CAST(n.p AS DOUBLE)) OVER w14 + regr_slope(close, CAST(n.p AS DOUBLE)) OVER w14 * (n.p - 13)')} END AS linearreg_intercept,
    CASE WHEN n.p > 5 THEN {_r('CASE WHEN var_pop(ra) OVER w5 <> 0 THEN covar_pop(ra, rb) OVER w5 / var_pop(ra) OVER w5 ELSE 0 END', 4)} END AS beta, CASE WHEN n.p >= 9 THEN {_r('avg(t.m5) OVER w5')} END AS trima
    FROM n JOIN h ON h.symbol = n.symbol AND h.ts = n.ts JOIN v ON v.symbol = n.symbol AND v.ts = n.ts JOIN t ON t.symbol = n.symbol AND t.ts = n.ts
    WINDOW w5 AS (PARTITION BY n.symbol ORDER BY n.ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w14 AS (PARTITION BY n.symbol ORDER BY n.ts ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""".replace(f"max(close) OVER {_frame(30)}", "max(close) OVER (PARTITION BY n.symbol ORDER BY n.ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"),
)
def ind_positions(spark, d):
    out = I.compute(event_bars(spark, d), [Spec(n) for n in ("maxindex", "minindex", "minmax", "minmaxindex", "avgdev", "linearreg_angle", "linearreg_intercept", "beta")] + [Spec("trima", {"period": 9})], seconds=3600)
    whole = lambda c: F.col(c).cast("long").alias(c)
    return rounded(out.select("symbol", "ts", whole("maxindex"), whole("minindex"), whole("minmaxindex_minidx"), whole("minmaxindex_maxidx"), "minmax_max", "minmax_min", "avgdev", "linearreg_angle", "linearreg_intercept", F.round("beta", 4).alias("beta"), "trima"))


@query("candles_all", f"WITH {_LINE}, {candle_sql.candles()} SELECT symbol, ts, {candle_sql.columns(sorted(PATTERNS))} FROM k")
def candles_all(spark, d):
    """Every pattern over daily bars."""
    return I.compute(lineitem_bars(spark, d), [Spec(n) for n in sorted(PATTERNS)], seconds=86400).select("symbol", "ts", *sorted(PATTERNS))


@query("candles_events", f"WITH {_events()}, {candle_sql.candles()} SELECT symbol, ts, {candle_sql.columns(sorted(PATTERNS))} FROM k")
def candles_events(spark, d):
    """Every pattern over hourly bars, whose shapes are wilder."""
    return I.compute(event_bars(spark, d), [Spec(n) for n in sorted(PATTERNS)], seconds=3600).select("symbol", "ts", *sorted(PATTERNS))


#: Bodies, gaps and shadows of drawn bars, by kind: of all shapes, falling with long lower shadows, and falling without any.
_SHAPES = {
    "mixed": ((-30, -14, -9, -5, -1, 0, 1, 5, 9, 14, 30), (-30, -14, -4, -1, 0, 0, 1, 4, 14, 30), (0, 0, 1, 4, 12), (0, 0, 1, 4, 12)),
    "falling": ((-30, -12, -4, -1, -20, 8), (1, 3, 6, 10, 15, 22), (0, 0, 0, 1), (0, 0, 9, 20, 30)),
    "sinking": ((-30, -30, -18, -10, -26, 4), (-14, -8, 0, 4, 12, 26), (0, 0, 0, 12, 30), (0, 0, 0, 0, 2)),
}
_SHAPE_OF = "(l_orderkey * 31 + l_partkey * 1701 + l_suppkey * 77 + l_linenumber * 5 + CAST(l_quantity AS BIGINT) * 13) * 40503 % 1048576"
_ITEM_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _shape_sql() -> str:
    """Bars whose shapes are drawn by numbers of the line items; a series is the items of 64 order keys and a flag."""
    parts = []
    for kind, lists in _SHAPES.items():
        sizes, picks = 1, []
        for values in lists:
            picks.append(f"[{', '.join(map(str, values))}][(x // {sizes}) % {len(values)} + 1]")
            sizes *= len(values)
        parts.append(f"SELECT '{kind}-' || symbol AS symbol, p, {picks[0]} AS body, {picks[1]} AS gap, {picks[2]} AS above, {picks[3]} AS under FROM y0")
    return f"""y0 AS (SELECT l_returnflag || '-' || (l_orderkey // 64) AS symbol, row_number() OVER (PARTITION BY l_returnflag, l_orderkey // 64 ORDER BY {_ITEM_ORDER}) AS p, {_SHAPE_OF} AS x FROM lineitem), y1 AS ({' UNION ALL '.join(parts)}),
    y2 AS (SELECT *, 100000 + sum(body + gap) OVER (PARTITION BY symbol ORDER BY p ROWS UNBOUNDED PRECEDING) AS last FROM y1),
    bars AS (SELECT symbol, p * 60 AS ts, CAST(last - body AS DOUBLE) AS open, CAST(greatest(last, last - body) + above AS DOUBLE) AS high, CAST(least(last, last - body) - under AS DOUBLE) AS low, CAST(last AS DOUBLE) AS close, 1.0 AS volume FROM y2)"""


#: A series of drawn bars; its line items are shuffled once, by the first two.
_SHAPE_KEYS = ("series", "l_returnflag", "kind")


def _shape_bars(spark, d) -> DataFrame:
    """Each line item as a bar of each kind; ``p`` is its place in the series."""
    place = F.row_number().over(Window.partitionBy(*_SHAPE_KEYS[:2]).orderBy(*_ITEM_ORDER.split(", ")))
    items = table(spark, d, "lineitem").withColumn("series", F.floor(F.col("l_orderkey") / 64).cast("long"))
    kinds = []
    for kind, lists in _SHAPES.items():
        sizes, picks = 1, [F.lit(kind).alias("kind")]
        for name, values in zip(("body", "gap", "above", "under"), lists, strict=True):
            picks.append(F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("x") / sizes) % len(values) + 1).cast("int")).alias(name))
            sizes *= len(values)
        kinds.append(F.struct(*picks))
    drawn = items.select(*_SHAPE_KEYS[:2], place.alias("p"), F.expr(_SHAPE_OF).alias("x"))
    out = drawn.select(*_SHAPE_KEYS[:2], "p", F.inline(F.array(*kinds)))
    last = 100000 + F.sum(F.col("body") + F.col("gap")).over(Window.partitionBy(*_SHAPE_KEYS).orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("last", last)
    first = F.col("last") - F.col("body")
    number = lambda c, name: c.cast("double").alias(name)
    return out.select(*_SHAPE_KEYS, "p", number(first, "open"), number(F.greatest("last", first) + F.col("above"), "high"), number(F.least("last", first) - F.col("under"), "low"), number(F.col("last"), "close"), F.lit(1.0).alias("volume"))


@query("candles_shapes", f"WITH {_shape_sql()}, {candle_sql.candles()} SELECT symbol, ts, {candle_sql.columns(sorted(PATTERNS))} FROM k")
def candles_shapes(spark, d):
    """Every pattern over bars of drawn shapes, among which all patterns occur; the series are short, so each is a task's."""
    found = I.compute(_shape_bars(spark, d), [Spec(n) for n in sorted(PATTERNS)], _SHAPE_KEYS, "p")
    symbol = F.concat_ws("-", "kind", "l_returnflag", F.col("series").cast("string")).alias("symbol")
    return found.select(symbol, (F.col("p") * 60).cast("long").alias("ts"), *sorted(PATTERNS))


_CANDLE = f"c AS (SELECT *, row_number() OVER {_W} AS p, abs(close - open) AS body, high - low AS rng, CASE WHEN close >= open THEN 1 ELSE -1 END AS color, lag(open) OVER {_W} AS o1, lag(close) OVER {_W} AS c1 FROM bars)"
_BEFORE = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"


@query(
    "candles_basic",
    f"""WITH {_LINE}, {_CANDLE} SELECT symbol, ts, CASE WHEN p > 14 AND body <= 0.1 * avg(rng) OVER {_BEFORE} THEN 100 ELSE 0 END AS cdldoji,
    CASE WHEN p <= 14 THEN 0 WHEN color = 1 AND c1 < o1 AND ((close >= o1 AND open < c1) OR (close > o1 AND open <= c1)) THEN 100 WHEN color = -1 AND c1 >= o1 AND ((open >= c1 AND close < o1) OR (open > c1 AND close <= o1)) THEN -100 ELSE 0 END AS cdlengulfing,
    CASE WHEN p > 14 AND body > avg(body) OVER {_BEFORE} AND high - greatest(open, close) < 0.1 * avg(rng) OVER {_BEFORE} AND least(open, close) - low < 0.1 * avg(rng) OVER {_BEFORE} THEN color * 100 ELSE 0 END AS cdlmarubozu FROM c""",
)
def candles_basic(spark, d):
    return I.compute(lineitem_bars(spark, d), [Spec("cdldoji"), Spec("cdlengulfing"), Spec("cdlmarubozu")], seconds=86400).select("symbol", "ts", "cdldoji", "cdlengulfing", "cdlmarubozu")


# Conditions


@query(
    "conditions",
    f"""WITH {_events()}, m AS (SELECT symbol, ts, close, row_number() OVER {_W} AS p, CASE WHEN row_number() OVER {_W} >= 10 THEN avg(close) OVER {_frame(10)} END AS fast, CASE WHEN row_number() OVER {_W} >= 30 THEN avg(close) OVER {_frame(30)} END AS slow FROM bars),
    c AS (SELECT *, coalesce(close > slow, false) AS above, coalesce(lag(fast) OVER {_W} <= lag(slow) OVER {_W} AND fast > slow, false) AS crosses_above, coalesce(lag(fast) OVER {_W} >= lag(slow) OVER {_W} AND fast < slow, false) AS crosses_below,
      coalesce(close > lag(close, 3) OVER {_W}, false) AS rising, coalesce(close < lag(close, 3) OVER {_W}, false) AS falling FROM m)
    SELECT symbol, ts, above, crosses_above, crosses_below, rising, falling, max(CAST(crosses_above AS INT)) OVER {_frame(5)} = 1 AS within_last,
    min(CAST(above AS INT)) OVER {_frame(3)} = 1 AND p >= 3 AS persisted, above AND NOT coalesce(lag(above) OVER {_W}, true) AS became, above AND NOT rising OR falling AND NOT above AS mixed FROM c""",
)
def conditions(spark, d):
    """Conditions over blocks of rows; the halo covers means of 30 bars and five bars of memory after them."""

    def apply(df, s):
        w, close, fast, slow = s.window, F.col("close"), F.col("fast"), F.col("slow")
        df = I.add_windows(df, [Spec("sma", {"period": 10}, "fast"), Spec("sma", {"period": 30}, "slow")], s)
        df = df.withColumns({"above": C.above(close, slow), "crosses_above": C.crosses_above(fast, slow, w), "crosses_below": C.crosses_below(fast, slow, w), "rising": C.is_rising(close, w, 3), "falling": C.is_falling(close, w, 3)})
        above, rising, falling = F.col("above"), F.col("rising"), F.col("falling")
        return df.withColumns({"within_last": C.within_last(F.col("crosses_above"), w, 5), "persisted": C.persisted_for(above, w, 3), "became": C.just_became(above, w), "mixed": C.either(C.both(above, C.negated(rising)), C.both(falling, C.negated(above)))})

    df = blocks.windows(blocks.placed(event_bars(spark, d), 3600), 40, apply)
    return df.select("symbol", "ts", "above", "crosses_above", "crosses_below", "rising", "falling", "within_last", "persisted", "became", "mixed")


# Alternative bars


@query(
    "heiken_ashi",
    f"""WITH RECURSIVE {_events()}, {_NUM}, h AS (SELECT *, (open + high + low + close) / 4 AS hc FROM n),
    r AS (SELECT symbol, p, (open + close) / 2 AS ho, hc FROM h WHERE p = 1 UNION ALL SELECT h.symbol, h.p, (r.ho + r.hc) / 2, h.hc FROM r JOIN h ON h.symbol = r.symbol AND h.p = r.p + 1)
    SELECT h.symbol, h.ts, {_r('r.ho')} AS open, {_r('greatest(h.high, r.ho, h.hc)')} AS high, {_r('least(h.low, r.ho, h.hc)')} AS low, {_r('h.hc')} AS close, {_r('h.volume')} AS volume FROM h JOIN r ON r.symbol = h.symbol AND r.p = h.p""",
)
def heiken_ashi(spark, d):
    return rounded(bricks.heiken_ashi(event_bars(spark, d), 3600))


@query(
    "renko",
    f"""WITH RECURSIVE {_events()}, {_NUM},
    r AS (SELECT symbol, p, close AS origin, 0::BIGINT AS before, 0::BIGINT AS level, 0 AS way, 0::BIGINT AS made FROM n WHERE p = 1
      UNION ALL SELECT n.symbol, n.p, r.origin, r.level, r.level + CAST(s.k AS BIGINT), CASE WHEN s.k > 0 THEN 1 WHEN s.k < 0 THEN -1 ELSE r.way END, CAST(abs(s.k) AS BIGINT)
      FROM r JOIN n ON n.symbol = r.symbol AND n.p = r.p + 1, LATERAL (SELECT r.origin + 10 * r.level AS price) c,
      LATERAL (SELECT CASE WHEN r.way >= 0 THEN CASE WHEN floor((n.high - price) / 10) >= 1 THEN floor((n.high - price) / 10) WHEN floor((price - n.low) / 10) >= 2 THEN -floor((price - n.low) / 10) ELSE 0 END
        ELSE CASE WHEN floor((price - n.low) / 10) >= 1 THEN -floor((price - n.low) / 10) WHEN floor((n.high - price) / 10) >= 2 THEN floor((n.high - price) / 10) ELSE 0 END END AS k) s)
    SELECT r.symbol, n.ts, CAST(row_number() OVER (PARTITION BY r.symbol ORDER BY r.p, u.i) AS INTEGER) AS seq, {_r('origin + 10 * (before + r.way * u.i)', 4)} AS open, {_r('origin + 10 * (before + r.way * (u.i + 1))', 4)} AS close,
      {_r('origin + 10 * (before + greatest(r.way * u.i, r.way * (u.i + 1)))', 4)} AS high, {_r('origin + 10 * (before + least(r.way * u.i, r.way * (u.i + 1)))', 4)} AS low, {_r('n.volume / r.made', 4)} AS volume
    FROM r JOIN n ON n.symbol = r.symbol AND n.p = r.p, unnest(range(r.made)) u(i) WHERE r.made > 0""",
)
def renko(spark, d):
    """Every brick, laid in blocks of bars."""
    return rounded(bricks.renko(event_bars(spark, d), 10.0, 3600, 100), 4)


_BRICKS = "CASE WHEN r.way >= 0 THEN CASE WHEN floor((n.high - r.price) / n.size) >= 1 THEN floor((n.high - r.price) / n.size) WHEN floor((r.price - n.low) / n.size) >= 2 THEN -floor((r.price - n.low) / n.size) ELSE 0 END ELSE CASE WHEN floor((r.price - n.low) / n.size) >= 1 THEN -floor((r.price - n.low) / n.size) WHEN floor((n.high - r.price) / n.size) >= 2 THEN floor((n.high - r.price) / n.size) ELSE 0 END END"


@query(
    "atr_renko",
    f"""WITH RECURSIVE {_events()}, {_NUM}, q0 AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {_W}), abs(low - lag(close) OVER {_W})) AS tr FROM n), q1 AS (SELECT *, {smooth_sql.wilder('tr', 14)} AS atr FROM q0),
    q AS MATERIALIZED (SELECT *, coalesce(CASE WHEN atr > 0 THEN atr END, first_value(CASE WHEN atr > 0 THEN atr END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS size FROM q1),
    r AS (SELECT symbol, p, close AS price, 0 AS way, close AS before, 0::BIGINT AS made, size FROM q WHERE p = 1
      UNION ALL SELECT n.symbol, n.p, r.price + n.size * s.k, CASE WHEN s.k > 0 THEN 1 WHEN s.k < 0 THEN -1 ELSE r.way END, r.price, CAST(abs(s.k) AS BIGINT), n.size FROM r JOIN q n ON n.symbol = r.symbol AND n.p = r.p + 1, LATERAL (SELECT {_BRICKS} AS k) s)
    SELECT r.symbol, q.ts, CAST(r.way AS INTEGER) AS way, count(*) AS bricks, {_r('min(r.before)', 4)} AS start, {_r('min(r.price)', 4)} AS stop, {_r('min(q.volume / r.made) * count(*)', 4)} AS volume FROM r JOIN q ON q.symbol = r.symbol AND q.p = r.p, unnest(range(r.made)) WHERE r.made > 0 GROUP BY 1, 2, 3""",
)
def atr_renko(spark, d):
    """The bricks of each bar: how many, and where they begin and end."""
    laid = bricks.atr_renko(event_bars(spark, d), 14, 3600).withColumn("way", F.when(F.col("close") > F.col("open"), 1).otherwise(-1))
    four = lambda c, name: (F.round(c, 4) + 0.0).alias(name)
    return laid.groupBy("symbol", "ts", "way").agg(F.count("*").alias("bricks"), four(F.min_by("open", "seq"), "start"), four(F.max_by("close", "seq"), "stop"), four(F.sum("volume"), "volume"))


# Regimes


_SMA50 = f"CASE WHEN row_number() OVER {_W} >= 50 THEN avg(close) OVER {_frame(50)} END"


@query("regime_trend", f"WITH {_events()}, m AS (SELECT symbol, ts, close, row_number() OVER {_W} AS p, {_SMA50} AS ma FROM bars) SELECT symbol, ts, CASE WHEN p <= 51 THEN NULL WHEN close > ma THEN 'bull' ELSE 'bear' END AS regime FROM m")
def regime_trend(spark, d):
    return regimes.trend(event_bars(spark, d), 50).select("symbol", "ts", "regime")


_SMA50X = "avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"


@query("regime_adx", f"WITH {_events()}, {_NUM}, {smooth_sql.directional()}, y AS (SELECT *, CASE WHEN p >= 50 THEN {_SMA50X} END AS ma FROM x) SELECT symbol, ts, CASE WHEN p <= 28 OR adx IS NULL OR ma IS NULL THEN NULL WHEN adx < 20 THEN 'sideways' WHEN close > ma THEN 'bull' ELSE 'bear' END AS regime FROM y")
def regime_adx(spark, d):
    return regimes.adx(event_bars(spark, d)).select("symbol", "ts", "regime")


@query(
    "regime_volatility",
    f"""WITH RECURSIVE {_events()}, {_NUM}, g AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {_W}), abs(low - lag(close) OVER {_W})) AS tr FROM n),
    s AS (SELECT symbol, avg(tr) AS atr FROM g WHERE p BETWEEN 2 AND 15 GROUP BY 1),
    r AS (SELECT symbol, 15::BIGINT AS p, atr FROM s UNION ALL SELECT g.symbol, g.p, r.atr + (g.tr - r.atr) / 14 FROM r JOIN g ON g.symbol = r.symbol AND g.p = r.p + 1),
    k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY atr) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS c FROM r),
    q AS (SELECT symbol, min(atr) FILTER (WHERE i >= floor(c * 0.33)) AS lo, min(atr) FILTER (WHERE i >= floor(c * 0.67)) AS hi FROM k GROUP BY 1)
    SELECT n.symbol, n.ts, CASE WHEN r.atr IS NULL THEN NULL WHEN q.lo = q.hi THEN 'low_vol' WHEN r.atr >= q.hi THEN 'high_vol' WHEN r.atr >= q.lo THEN 'normal_vol' ELSE 'low_vol' END AS regime FROM n LEFT JOIN r ON r.symbol = n.symbol AND r.p = n.p LEFT JOIN q ON q.symbol = n.symbol""",
)
def regime_volatility(spark, d):
    return regimes.volatility(event_bars(spark, d), seconds=3600).select("symbol", "ts", "regime")


@query(
    "regime_combined",
    f"""WITH {_events()}, {_NUM}, g AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {_W}), abs(low - lag(close) OVER {_W})) AS tr, {_SMA50} AS ma FROM n), r AS (SELECT *, {smooth_sql.wilder('tr', 14)} AS atr FROM g),
    k AS (SELECT symbol, atr, row_number() OVER (PARTITION BY symbol ORDER BY atr) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS c FROM r WHERE atr IS NOT NULL),
    q AS (SELECT symbol, min(atr) FILTER (WHERE i >= floor(c * 0.33)) AS lo, min(atr) FILTER (WHERE i >= floor(c * 0.67)) AS hi FROM k GROUP BY 1)
    SELECT r.symbol, r.ts, CASE WHEN p > 51 AND atr IS NOT NULL THEN CASE WHEN close > ma THEN 'bull' ELSE 'bear' END || '_' || CASE WHEN lo = hi THEN 'low_vol' WHEN atr >= hi THEN 'high_vol' WHEN atr >= lo THEN 'normal_vol' ELSE 'low_vol' END END AS regime FROM r JOIN q ON q.symbol = r.symbol""",
)
def regime_combined(spark, d):
    return regimes.combined(event_bars(spark, d), 50).select("symbol", "ts", "regime")


# Open-cross

CROSS = X.SurfaceConfig(block_minutes=60, bucket_size=0.25, min_samples=10)
_SEEN = f"""{_events(60, True)}, b AS (SELECT *, ts // 3600 * 3600 AS block FROM bars),
  w AS (SELECT *, first_value(open) OVER (PARTITION BY block ORDER BY ts) AS bo, count(*) OVER (PARTITION BY block) - row_number() OVER (PARTITION BY block ORDER BY ts) AS rem,
    min(low) OVER (PARTITION BY block ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fl, max(high) OVER (PARTITION BY block ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fh FROM b),
  seen AS (SELECT symbol, ts, block, close, bo, rem AS minutes_remaining, CAST(floor((close - bo) / bo / 0.25) AS BIGINT) AS bucket,
    CASE WHEN abs(close - bo) < 1e-7 THEN false WHEN close > bo THEN fl < bo ELSE fh > bo END AS crossed FROM w WHERE rem > 0 AND bo <> 0)"""


def _surface(source: str = "seen", keys: str = "") -> str:
    return f"(SELECT {keys}bucket, minutes_remaining, count(*) AS samples, CAST(count(*) FILTER (WHERE crossed) AS BIGINT) AS crosses, count(*) FILTER (WHERE crossed) / count(*) AS probability FROM {source} GROUP BY ALL)"


_CONFIDENCE = "CASE WHEN samples >= 10 THEN 'high' WHEN samples >= 30 THEN 'medium' ELSE 'low' END"


@query("opencross_surface", f"WITH {_SEEN} SELECT bucket, minutes_remaining, samples, crosses, {_r('probability')} AS probability, {_CONFIDENCE} AS confidence FROM {_surface()}")
def opencross_surface(spark, d):
    return rounded(X.surface(event_bars(spark, d, 60, True), CROSS))


@query("opencross_symmetric", f"WITH {_SEEN}, f AS (SELECT abs(bucket) AS bucket, minutes_remaining, crossed FROM seen) SELECT bucket, minutes_remaining, samples, crosses, {_r('probability')} AS probability, {_CONFIDENCE} AS confidence FROM {_surface('f')}")
def opencross_symmetric(spark, d):
    return rounded(X.surface(event_bars(spark, d, 60, True), X.SurfaceConfig(60, 0.25, 10, symmetric=True)))


#: Deviation of log returns so far; from place 60 on an exponential mean of their squares, seeded by the variance before.
_EWMA = f"""r0 AS (SELECT *, row_number() OVER (ORDER BY ts) AS p, CASE WHEN close > 0 AND lag(close) OVER (ORDER BY ts) > 0 THEN ln(close / lag(close) OVER (ORDER BY ts)) ELSE 0 END AS r FROM bars),
  bars2 AS (SELECT *, greatest(coalesce(CASE WHEN p <= 60 THEN stddev_samp(r) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) ELSE sqrt({smooth_sql.smoothed('r * r', 2 / 61, '(SELECT var_pop(r) FROM r0 WHERE p <= 60)', 60)}) END, 0), 0.001) AS volatility FROM r0)"""


@query(
    "opencross_normalised",
    f"""WITH {_SEEN.split(", b AS")[0]}, {_EWMA}, b AS{_SEEN.split(", b AS")[1].split("seen AS")[0].replace("FROM bars", "FROM bars2")}
    seen AS (SELECT rem AS minutes_remaining, CAST(floor(ln(close / bo) / greatest(volatility * sqrt(greatest(rem, 1)), 0.001) / 0.5) AS BIGINT) AS bucket, CASE WHEN abs(close - bo) < 1e-7 THEN false WHEN close > bo THEN fl < bo ELSE fh > bo END AS crossed FROM w WHERE rem > 0 AND bo > 0 AND close > 0)
    SELECT bucket, minutes_remaining, samples, crosses, {_r('probability')} AS probability, {_CONFIDENCE} AS confidence FROM {_surface()}""",
)
def opencross_normalised(spark, d):
    config = X.SurfaceConfig(60, 0.5, 10, volatility_lookback=60)
    return rounded(X.surface(V.with_volatility(event_bars(spark, d, 60, True), 60, 60), config))


@query("opencross_overall", f"WITH {_SEEN} SELECT CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(crosses) AS BIGINT) AS crosses, {_r('sum(crosses) / sum(samples)')} AS cross_rate, count(DISTINCT bucket) AS buckets, count(*) AS cells FROM {_surface()}")
def opencross_overall(spark, d):
    return rounded(X.overall(X.surface(event_bars(spark, d, 60, True), CROSS)))


@query("opencross_cross_section", f"WITH {_SEEN} SELECT bucket, samples, {_r('probability')} AS probability FROM {_surface()} WHERE minutes_remaining = 5")
def opencross_cross_section(spark, d):
    return rounded(X.cross_section(X.surface(event_bars(spark, d, 60, True), CROSS), 5).select("bucket", "samples", "probability"))


@query("opencross_extremes", f"WITH {_SEEN}, s AS {_surface()}, o AS (SELECT *, row_number() OVER (ORDER BY probability DESC, bucket, minutes_remaining DESC) AS a, row_number() OVER (ORDER BY probability, bucket, minutes_remaining DESC) AS z FROM s) SELECT CASE WHEN a = 1 THEN 'highest' ELSE 'lowest' END AS which, bucket, minutes_remaining, {_r('probability')} AS probability, samples FROM o WHERE a = 1 OR z = 1")
def opencross_extremes(spark, d):
    return rounded(X.extremes(X.surface(event_bars(spark, d, 60, True), CROSS)))


@query("opencross_heatmap", f"WITH {_SEEN}, s AS {_surface()} SELECT bucket, " + ", ".join(f"max(CASE WHEN minutes_remaining = {k} THEN {_r('probability')} END) AS \"{k}\"" for k in range(1, 60)) + " FROM s GROUP BY 1")
def opencross_heatmap(spark, d):
    return rounded(X.heatmap(X.surface(event_bars(spark, d, 60, True), CROSS), CROSS.block_minutes))


@query("opencross_trimmed", f"WITH {_SEEN}, s AS {_surface()} SELECT bucket, minutes_remaining, samples FROM s WHERE abs(bucket) <= (SELECT max(abs(bucket)) FROM s WHERE probability > 0.001) + 5")
def opencross_trimmed(spark, d):
    return X.trimmed(X.surface(event_bars(spark, d, 60, True), CROSS)).select("bucket", "minutes_remaining", "samples")


@query("opencross_time_decay", f"WITH {_SEEN}, s AS {_surface()}, h AS (SELECT *, lag(probability) OVER (PARTITION BY bucket ORDER BY minutes_remaining DESC) AS before FROM s WHERE samples >= 10) SELECT bucket, count(*) AS points, CAST(count(*) FILTER (WHERE probability < before) AS BIGINT) AS falls, count(before) AS steps, count(*) FILTER (WHERE probability < before) * 2 > count(before) AS decays FROM h GROUP BY 1 HAVING count(*) >= 3")
def opencross_time_decay(spark, d):
    return X.time_decay(X.surface(event_bars(spark, d, 60, True), CROSS)).select("bucket", "points", F.coalesce("falls", F.lit(0)).alias("falls"), "steps", "decays")


# Validation

SPLITS = V.Splits(1704067200, 1705276799, 1705276800, 1706745599)
_PART = "ts BETWEEN {0.train_start} AND {0.train_end}".format(SPLITS), "ts BETWEEN {0.test_start} AND {0.test_end}".format(SPLITS)
_TRAIN = f"{_SEEN}, pts AS {_surface(f'(SELECT * FROM seen WHERE {_PART[0]})')}"


@query(
    "train_test",
    f"""WITH {_TRAIN} SELECT part, count(*) AS observations, {_r('avg(probability)')} AS predicted, {_r('avg(CAST(crossed AS DOUBLE))')} AS realised, {_r('abs(avg(probability) - avg(CAST(crossed AS DOUBLE)))')} AS difference
    FROM (SELECT *, CASE WHEN {_PART[0]} THEN 'train' WHEN {_PART[1]} THEN 'test' END AS part FROM seen) JOIN pts USING (bucket, minutes_remaining) WHERE part IS NOT NULL GROUP BY 1""",
)
def train_test(spark, d):
    return rounded(V.train_test(event_bars(spark, d, 60, True), SPLITS, CROSS))


def _predicted(spark, d):
    train, test = V.split(event_bars(spark, d, 60, True), SPLITS)
    return V.looked_up(X.observations(test, CROSS), X.surface(train, CROSS))


_BINS = f"{_TRAIN}, bins AS (SELECT CAST(floor(round(probability / 0.05, 9)) AS BIGINT) AS bin, count(*) AS samples, avg(probability) AS predicted, avg(CAST(crossed AS DOUBLE)) AS observed, avg(pow(probability - CAST(crossed AS DOUBLE), 2)) AS brier FROM seen JOIN pts USING (bucket, minutes_remaining) WHERE {_PART[1]} GROUP BY 1)"


@query("calibration_bins", f"WITH {_BINS} SELECT bin, samples, {_r('predicted')} AS predicted, {_r('observed')} AS observed, {_r('brier')} AS brier, {_r('abs(predicted - observed)')} AS error FROM bins")
def calibration_bins(spark, d):
    return rounded(V.calibration_bins(_predicted(spark, d)))


@query("calibration", f"WITH {_BINS} SELECT CAST(sum(samples) AS BIGINT) AS samples, {_r('sum(brier * samples) / sum(samples)')} AS brier, {_r('sum(abs(predicted - observed) * samples) / sum(samples)')} AS mace, {_r('max(abs(predicted - observed))')} AS max_error FROM bins")
def calibration(spark, d):
    return rounded(V.calibration(_predicted(spark, d)).select("samples", "brier", "mace", "max_error"))


@query(
    "uncertainty",
    f"""WITH {_SEEN}, s AS {_surface()}, u AS (SELECT *, 1.96 AS z, sqrt(probability * (1 - probability) / samples) AS se, samples + 1.96 * 1.96 AS nt, (crosses + 1.96 * 1.96 / 2) / (samples + 1.96 * 1.96) AS pt,
      (probability + 1.96 * 1.96 / (2 * samples)) / (1 + 1.96 * 1.96 / samples) AS mid, 1.96 * sqrt(probability * (1 - probability) / samples + 1.96 * 1.96 / (4.0 * samples * samples)) / (1 + 1.96 * 1.96 / samples) AS half FROM s)
    SELECT bucket, minutes_remaining, {_r('se')} AS standard_error, {_r('least(greatest(probability - z * se, 0), 1)')} AS wald_low, {_r('least(greatest(probability + z * se, 0), 1)')} AS wald_high, {_r('least(greatest(mid - half, 0), 1)')} AS wilson_low, {_r('least(greatest(mid + half, 0), 1)')} AS wilson_high,
      {_r('least(greatest(pt - z * sqrt(pt * (1 - pt) / nt), 0), 1)')} AS agresti_low, {_r('least(greatest(pt + z * sqrt(pt * (1 - pt) / nt), 0), 1)')} AS agresti_high, CAST(385 AS INTEGER) AS needed, samples >= 385 AS enough FROM u""",
)
def uncertainty(spark, d):
    return rounded(V.uncertainty(X.surface(event_bars(spark, d, 60, True), CROSS)).drop("samples", "crosses", "probability", "confidence"))


_PERIODS = f"""WITH {_SEEN}, f AS (SELECT *, strftime(date_trunc('week', make_timestamp(ts * 1000000)), '%Y-%m-%d') AS period FROM seen), s AS {_surface('f', 'period, ')}
    SELECT a.period AS left_period, b.period AS right_period, count(*) AS cells, {_r('avg(abs(a.probability - b.probability))')} AS mean_difference, {_r('CASE WHEN count(*) >= 3 THEN coalesce(CASE WHEN stddev_pop(a.probability) > 0 AND stddev_pop(b.probability) > 0 THEN corr(a.probability, b.probability) END, 0) ELSE 0 END')} AS correlation
    FROM s a JOIN s b USING (bucket, minutes_remaining) WHERE a.period < b.period GROUP BY 1, 2"""


@query("cross_period", _PERIODS)
def cross_period(spark, d):
    return rounded(V.cross_period(event_bars(spark, d, 60, True), CROSS, "week"))


_AGREE = "count(*) AS cells, round(avg(abs(p - q)), 6) + 0.0 AS mean_difference, round(max(abs(p - q)), 6) + 0.0 AS max_difference, round(CASE WHEN count(*) >= 3 AND stddev_pop(p) > 1e-12 AND stddev_pop(q) > 1e-12 THEN covar_pop(p, q) / (stddev_pop(p) * stddev_pop(q)) ELSE 0 END, 6) + 0.0 AS correlation"


def _seen_of(bars: str, seconds: int, size: float) -> str:
    """Common tables up to ``seen`` over bars of several symbols, as ``_SEEN`` over one."""
    own = "PARTITION BY symbol, block ORDER BY ts"
    return f"""b AS (SELECT *, ts // {seconds} * {seconds} AS block FROM {bars}),
  w AS (SELECT *, first_value(open) OVER ({own}) AS bo, count(*) OVER (PARTITION BY symbol, block) - row_number() OVER ({own}) AS rem,
    min(low) OVER ({own} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fl, max(high) OVER ({own} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS fh FROM b),
  seen AS (SELECT * EXCLUDE (rem), rem AS minutes_remaining, CAST(floor((close - bo) / bo / {size}) AS BIGINT) AS bucket,
    CASE WHEN abs(close - bo) < 1e-7 THEN false WHEN close > bo THEN fl < bo ELSE fh > bo END AS crossed FROM w WHERE rem > 0 AND bo <> 0)"""


@query("cross_period_matrix", f"WITH x AS ({_PERIODS}), y AS (SELECT left_period AS a, right_period AS b, correlation, mean_difference FROM x UNION ALL SELECT right_period, left_period, correlation, mean_difference FROM x) SELECT a AS period, count(*) AS others, {_r('avg(correlation)', 8)} AS persistence, {_r('avg(mean_difference)', 8)} AS mean_difference, {_r('min(correlation)')} AS least_correlation FROM y GROUP BY 1")
def cross_period_matrix(spark, d):
    """Each row of the matrix of periods, without its diagonal."""
    return rounded(V.persistence(rounded(V.cross_period(event_bars(spark, d, 60, True), CROSS, "week"))), 8)


@query(
    "rolling_stability",
    f"""WITH {_LINE}, {_seen_of('bars', 604800, 0.1)}, e AS (SELECT min(ts) AS a, max(ts) AS z FROM seen),
    p AS (SELECT seen.*, least(floor((ts - a) / 2592000), floor((z - a - 15552000) / 2592000)) AS hi, greatest(floor((ts - a - 15552000) / 2592000) + 1, 0) AS lo FROM seen, e),
    o AS (SELECT *, unnest(range(CAST(lo AS BIGINT), CAST(hi AS BIGINT) + 1)) AS win FROM p WHERE lo <= hi), s AS {_surface('o', 'win, ')}
    SELECT x.win AS "window", {_AGREE.replace('p - q', 'x.probability - y.probability').replace('(p)', '(x.probability)').replace('(q)', '(y.probability)').replace('(p, q)', '(x.probability, y.probability)')} FROM s x JOIN s y ON y.win = x.win + 1 AND y.bucket = x.bucket AND y.minutes_remaining = x.minutes_remaining GROUP BY 1""",
)
def rolling_stability(spark, d):
    """Over daily bars of years: windows of six months by one."""
    return rounded(V.rolling_stability(lineitem_bars(spark, d), X.SurfaceConfig(7 * 1440, 0.1, 10)))


@query(
    "regime_sensitivity",
    f"""WITH {_SEEN}, r AS (SELECT block, CASE WHEN close > 0 AND lag(close) OVER (PARTITION BY block ORDER BY ts) > 0 THEN ln(close / lag(close) OVER (PARTITION BY block ORDER BY ts)) END AS r FROM seen),
    v AS (SELECT block, stddev_samp(r) AS v FROM r GROUP BY 1 HAVING stddev_samp(r) IS NOT NULL), c AS (SELECT v AS cut FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM v) WHERE i = least(floor(n * 0.7::DOUBLE), n - 1)),
    g AS (SELECT block, CASE WHEN v <= 0.8 * cut THEN 'low' WHEN v >= 1.2 * cut THEN 'high' END AS regime FROM v, c), o AS (SELECT seen.*, g.regime FROM seen JOIN g ON g.block = seen.block WHERE g.regime IS NOT NULL), s AS {_surface('o', 'regime, ')},
    d AS (SELECT {_AGREE.replace('p - q', 'x.probability - y.probability').replace('(p)', '(x.probability)').replace('(q)', '(y.probability)').replace('(p, q)', '(x.probability, y.probability)')} FROM s x JOIN s y ON x.regime = 'low' AND y.regime = 'high' AND y.bucket = x.bucket AND y.minutes_remaining = x.minutes_remaining),
    f AS (SELECT avg(abs(probability - 0.5)) FILTER (WHERE regime = 'low') AS lo, avg(abs(probability - 0.5)) FILTER (WHERE regime = 'high') AS hi FROM s)
    SELECT d.*, {_r('lo')} AS low_offset, {_r('hi')} AS high_offset, mean_difference <= 0.2 AND lo <= 0.3 AND hi <= 0.3 AS explainable FROM d, f""",
)
def regime_sensitivity(spark, d):
    return rounded(V.regime_sensitivity(event_bars(spark, d, 60, True), CROSS))


@query(
    "random_baseline",
    f"""WITH {_SEEN}, real AS {_surface()}, i AS (SELECT range AS iteration FROM range(10)),
    m1 AS (SELECT i.iteration, b.*, (b.ts % 2147483648 + (i.iteration + 1) * 7919) % 2147483648 AS x FROM b, i), m2 AS (SELECT * REPLACE ((x * 1103515245 + 12345) % 2147483648 AS x) FROM m1), m3 AS (SELECT * REPLACE ((x * 1103515245 + 12345) % 2147483648 AS x) FROM m2), m4 AS (SELECT * REPLACE ((x * 1103515245 + 12345) % 2147483648 AS x) FROM m3),
    q AS (SELECT *, row_number() OVER (PARTITION BY iteration, block ORDER BY x, ts) AS m, row_number() OVER (PARTITION BY iteration, block ORDER BY ts) AS n FROM m4),
    f0 AS (SELECT CAST(v.iteration AS VARCHAR) AS symbol, t.ts, v.open, v.high, v.low, v.close FROM q v JOIN q t ON t.iteration = v.iteration AND t.block = v.block AND t.n = v.m),
    {_seen_of('f0', 3600, 0.25).replace('b AS (', 'fb AS (').replace('FROM b)', 'FROM fb)').replace('w AS (', 'fw AS (').replace('FROM w ', 'FROM fw ').replace('seen AS (', 'fseen AS (')}, fake AS {_surface('fseen', 'symbol, ')}
    SELECT CAST(y.symbol AS INTEGER) AS iteration, {_AGREE.replace('p - q', 'x.probability - y.probability').replace('(p)', '(x.probability)').replace('(q)', '(y.probability)').replace('(p, q)', '(x.probability, y.probability)')} FROM real x JOIN fake y ON y.bucket = x.bucket AND y.minutes_remaining = x.minutes_remaining GROUP BY 1""",
)
def random_baseline(spark, d):
    return rounded(V.random_baseline(event_bars(spark, d, 60, True), CROSS))


@query("surface_structure", f"WITH {_SEEN}, s AS {_surface()} SELECT {_r('sum(CASE WHEN s.probability > 0 AND s.probability < 1 THEN -(s.probability * ln(s.probability) + (1 - s.probability) * ln(1 - s.probability)) ELSE 0 END)')} AS entropy, {_r('avg(abs(s.probability - b.probability))')} AS bucket_gradient, {_r('avg(abs(s.probability - m.probability))')} AS minute_gradient, count(*) AS cells FROM s LEFT JOIN s b ON b.bucket = s.bucket + 1 AND b.minutes_remaining = s.minutes_remaining LEFT JOIN s m ON m.bucket = s.bucket AND m.minutes_remaining = s.minutes_remaining + 1")
def surface_structure(spark, d):
    return rounded(V.structure(X.surface(event_bars(spark, d, 60, True), CROSS)))


@query("surface_monotonicity", f"WITH {_SEEN}, s AS {_surface()}, t AS (SELECT *, sign(probability - lag(probability) OVER (PARTITION BY minutes_remaining ORDER BY bucket)) AS step FROM s WHERE samples >= 10), u AS (SELECT *, CAST(step = lag(step) OVER (PARTITION BY minutes_remaining ORDER BY bucket) AS DOUBLE) AS same FROM t) SELECT minutes_remaining, {_r('avg(same)')} AS monotonicity, count(*) AS cells FROM u GROUP BY 1")
def surface_monotonicity(spark, d):
    return rounded(V.monotonicity(X.surface(event_bars(spark, d, 60, True), CROSS)))


_SIM = f"""{_TRAIN}, o AS (SELECT block, ts, close, bo, CASE WHEN probability > 0.7 THEN CASE WHEN close > bo THEN 'short' ELSE 'long' END WHEN probability < 1 - 0.7 THEN CASE WHEN close > bo THEN 'long' ELSE 'short' END END AS side FROM seen JOIN pts USING (bucket, minutes_remaining) WHERE {_PART[1]}),
  e AS (SELECT block, min(ts) AS entry_ts, arg_min(side, ts) AS side, arg_min(close, ts) AS entry_price, arg_min(bo, ts) AS bo FROM o WHERE side IS NOT NULL GROUP BY 1),
  l AS (SELECT e.*, min(b.ts) FILTER (WHERE CASE WHEN e.entry_price > e.bo THEN b.low < e.bo ELSE b.high > e.bo END) AS cross_ts, max(b.ts) AS last_ts, arg_max(b.close, b.ts) AS last FROM e JOIN bars b ON b.ts // 3600 * 3600 = e.block AND b.ts > e.entry_ts AND b.{_PART[1]} GROUP BY ALL),
  sim AS (SELECT 'ALL' AS symbol, block, entry_ts, side, entry_price, CASE WHEN cross_ts IS NULL THEN last ELSE bo END AS exit_price, coalesce(cross_ts, last_ts) AS exit_ts, CASE WHEN side = 'long' THEN 1 ELSE -1 END * (CASE WHEN cross_ts IS NULL THEN last ELSE bo END - entry_price) AS pnl FROM l)"""


@query("surface_simulation", f"WITH {_SIM} SELECT symbol, block, entry_ts, side, {_r('entry_price')} AS entry_price, {_r('exit_price')} AS exit_price, exit_ts, {_r('pnl')} AS pnl FROM sim")
def surface_simulation(spark, d):
    train, test = V.split(event_bars(spark, d, 60, True), SPLITS)
    return rounded(V.simulate(test, X.surface(train, CROSS), CROSS, 0.7))


@query("surface_simulation_monthly", f"WITH {_SIM} SELECT strftime(make_timestamp(exit_ts * 1000000), '%Y-%m') AS month, count(*) AS trades, CAST(count(*) FILTER (WHERE pnl > 0) AS BIGINT) AS wins, {_r('sum(pnl)', 4)} AS total_pnl, {_r('avg(pnl)', 4)} AS avg_pnl, {_r('avg(CAST(pnl > 0 AS DOUBLE))', 4)} AS win_rate FROM sim GROUP BY 1")
def surface_simulation_monthly(spark, d):
    return rounded(V.monthly(surface_simulation(spark, d)), 4)


# Signals


def _signals(spark, d) -> DataFrame:
    """One signal per symbol and day, from the day's first bar."""
    b = event_bars(spark, d)
    first = b.groupBy("symbol", F.floor(F.col("ts") / 86400).alias("day")).agg(F.min("ts").alias("entry_ts"), F.min_by("close", "ts").alias("entry_price")).where("entry_price > 0")
    odd = F.col("day") % 2 == 1
    p = F.col("entry_price")
    return first.select(
        F.concat_ws("-", "symbol", "day").alias("signal_id"), "symbol", F.when(odd, "short").otherwise("long").alias("direction"), "entry_price",
        F.when(odd, p * 1.5).otherwise(p * 0.5).alias("stop_loss"), F.when(odd, p * 0.25).otherwise(p * 3).alias("take_profit"),
        F.when(F.col("day") % 3 == 0, 40.0).alias("trailing_percent"), F.lit(None).cast("double").alias("high_water_mark"), "entry_ts",
    )


@query(
    "signal_evaluation",
    f"""WITH {_events()}, s AS (SELECT symbol, ts // 86400 AS day, min(ts) AS entry_ts, arg_min(close, ts) AS entry_price FROM bars GROUP BY 1, 2),
    g AS (SELECT symbol || '-' || day AS signal_id, symbol, day % 2 = 1 AS short, entry_price AS p, CASE WHEN day % 2 = 1 THEN entry_price * 1.5 ELSE entry_price * 0.5 END AS sl, CASE WHEN day % 2 = 1 THEN entry_price * 0.25 ELSE entry_price * 3 END AS tp, day % 3 = 0 AS trails, entry_ts FROM s WHERE entry_price > 0),
    h AS (SELECT g.*, b.ts, b.high, b.low, b.close, greatest(p, max(b.high) OVER w) AS up, least(p, min(b.low) OVER w) AS down FROM g JOIN bars b ON b.symbol = g.symbol AND b.ts >= g.entry_ts WINDOW w AS (PARTITION BY signal_id ORDER BY b.ts ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT *, CASE WHEN short THEN down + close * 0.4 ELSE up - close * 0.4 END AS trail FROM h),
    r AS (SELECT *, CASE WHEN (short AND high >= sl) OR (NOT short AND low <= sl) THEN 'stop_loss' WHEN trails AND ((short AND high >= trail) OR (NOT short AND low <= trail)) THEN 'trailing_stop' WHEN (short AND low <= tp) OR (NOT short AND high >= tp) THEN 'take_profit' END AS reason FROM t),
    x AS (SELECT signal_id, any_value(short) AS short, any_value(p) AS p, arg_min(reason, ts) FILTER (WHERE reason IS NOT NULL) AS reason, arg_min(CASE reason WHEN 'stop_loss' THEN sl WHEN 'trailing_stop' THEN trail ELSE tp END, ts) FILTER (WHERE reason IS NOT NULL) AS price, min(ts) FILTER (WHERE reason IS NOT NULL) AS exit_ts FROM r GROUP BY 1)
    SELECT signal_id, CASE WHEN reason IS NULL THEN 'open' WHEN (CASE WHEN short THEN p - price ELSE price - p END) > 0 THEN 'winner' ELSE 'loser' END AS status, reason AS exit_reason, {_r('price')} AS exit_price, exit_ts FROM x""",
)
def signal_evaluation(spark, d):
    return rounded(signals.evaluate(_signals(spark, d), event_bars(spark, d)).select("signal_id", "status", "exit_reason", "exit_price", "exit_ts"))


# Statistics over a ledger: orders as trades of each priority


def _ledger(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    start = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return o.select(F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderstatus") == "O", "short").otherwise("long").alias("direction"), (F.col("o_totalprice") - 150000).alias("pnl"), start.alias("entry_ts"), (start + 3600 + F.col("o_orderkey") % 7 * 3600).alias("exit_ts"), F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, "stop_loss").otherwise("take_profit").alias("exit_reason"))


_LEDGER = "t AS (SELECT o_orderpriority AS symbol, CASE WHEN o_orderstatus = 'O' THEN 'short' ELSE 'long' END AS direction, o_totalprice - 150000 AS pnl, CAST(epoch(o_orderdate) AS BIGINT) AS entry_ts, CAST(epoch(o_orderdate) AS BIGINT) + 3600 + o_orderkey % 7 * 3600 AS exit_ts, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'stop_loss' ELSE 'take_profit' END AS exit_reason FROM orders)"


@query(
    "trade_statistics",
    f"""WITH {_LEDGER} SELECT symbol, count(*) AS total_trades, {_r('sum(pnl)', 2)} AS total_return, CAST(count(*) FILTER (WHERE pnl > 0) AS BIGINT) AS winning_trades, CAST(count(*) FILTER (WHERE pnl < 0) AS BIGINT) AS losing_trades,
    {_r('count(*) FILTER (WHERE pnl > 0) / count(*)')} AS win_rate, {_r('sum(pnl) FILTER (WHERE pnl > 0) / abs(sum(pnl) FILTER (WHERE pnl < 0))')} AS profit_factor, {_r('max(pnl)', 2)} AS largest_win, {_r('min(pnl)', 2)} AS largest_loss,
    {_r('avg(exit_ts - entry_ts)', 2)} AS avg_trade_duration, {_r('median(exit_ts - entry_ts)', 2)} AS median_trade_duration, CAST(count(*) FILTER (WHERE direction = 'short') AS BIGINT) AS short_trades FROM t GROUP BY 1""",
)
def trade_statistics(spark, d):
    out = S.trade_statistics(_ledger(spark, d), ("symbol",), 1e6)
    out = out.select("symbol", "total_trades", "total_return", "winning_trades", "losing_trades", "win_rate", "profit_factor", "largest_win", "largest_loss", "avg_trade_duration", "median_trade_duration", "short_trades")
    return rounded(out.withColumns({c: F.round(c, 2) for c in ("total_return", "largest_win", "largest_loss", "avg_trade_duration", "median_trade_duration")}))


@query(
    "streaks",
    f"""WITH {_LEDGER}, s AS (SELECT symbol, entry_ts, k, sign(pnl) AS s, CASE WHEN sign(pnl) IS DISTINCT FROM lag(sign(pnl)) OVER (PARTITION BY symbol ORDER BY entry_ts, k) THEN 1 ELSE 0 END AS n FROM t),
    i AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY entry_ts, k ROWS UNBOUNDED PRECEDING) AS isl FROM s), c AS (SELECT symbol, isl, s, count(*) AS c FROM i GROUP BY 1, 2, 3)
    SELECT symbol, CAST(coalesce(max(c) FILTER (WHERE s = 1), 0) AS BIGINT) AS max_consecutive_wins, CAST(coalesce(max(c) FILTER (WHERE s = -1), 0) AS BIGINT) AS max_consecutive_losses FROM c GROUP BY 1""",
)
def streaks(spark, d):
    return S.streaks(_ledger(spark, d), ("symbol",), ["entry_ts", "k"])


@query("drawdowns", f"WITH {_events()}, p AS (SELECT symbol, ts, close, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM bars), f AS (SELECT *, peak - close AS fall, sum(CASE WHEN peak - close <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM p), l AS (SELECT symbol, g, count(*) FILTER (WHERE fall > 0) AS n FROM f GROUP BY 1, 2) SELECT f.symbol, {_r('max(fall)')} AS max_drawdown, {_r('max(CASE WHEN peak <> 0 THEN fall / peak ELSE 0 END)')} AS max_drawdown_percent, CAST(any_value(m.n) AS BIGINT) AS max_drawdown_duration FROM f JOIN (SELECT symbol, max(n) AS n FROM l GROUP BY 1) m ON m.symbol = f.symbol GROUP BY 1")
def drawdowns(spark, d):
    curve = event_bars(spark, d).select("symbol", "ts", F.col("close").alias("equity"))
    return rounded(S.drawdown_summary(curve, ("symbol",), "ts").drop("avg_drawdown"))


@query("running_balance", f"WITH {_LEDGER} SELECT symbol, k, {_r('1000000 + sum(pnl) OVER (PARTITION BY symbol ORDER BY entry_ts, k ROWS UNBOUNDED PRECEDING)', 2)} AS balance FROM t")
def running_balance(spark, d):
    return S.running_balance(_ledger(spark, d), ("symbol",), ["entry_ts", "k"], 1e6).select("symbol", "k", (F.round("balance", 2) + 0.0).alias("balance"))


@query("exit_reasons", f"WITH {_LEDGER} SELECT symbol, exit_reason, count(*) AS trades, {_r('count(*) / sum(count(*)) OVER (PARTITION BY symbol)')} AS share FROM t GROUP BY 1, 2")
def exit_reasons(spark, d):
    return rounded(S.exit_reasons(_ledger(spark, d), ("symbol",)))


@query(
    "series_metrics",
    f"""WITH {_events()}, m AS (SELECT symbol, avg(close) AS mean, stddev_pop(close) AS sd FROM bars GROUP BY 1), k AS (SELECT symbol, any_value(avg3) AS skew FROM (SELECT b.symbol, avg(pow((b.close - m.mean) / m.sd, 3)) OVER (PARTITION BY b.symbol) AS avg3 FROM bars b JOIN m USING (symbol)) GROUP BY 1)
    SELECT symbol, (SELECT {_r('skew')} FROM k WHERE k.symbol = bars.symbol) AS skewness, count(close) AS count, {_r('min(close)')} AS min, {_r('max(close)')} AS max, {_r('avg(close)')} AS mean, {_r('quantile_cont(close, 0.5)')} AS median, {_r('stddev_pop(close)')} AS std_dev, {_r('var_pop(close)')} AS variance,
    {_r('sum(close)')} AS sum, {_r('max(close) - min(close)')} AS range, {_r('quantile_cont(close, 0.25)')} AS q1, {_r('quantile_cont(close, 0.5)')} AS q2, {_r('quantile_cont(close, 0.75)')} AS q3, {_r('kurtosis_pop(close)')} AS kurtosis FROM bars GROUP BY 1""",
)
def series_metrics(spark, d):
    return rounded(S.series_metrics(event_bars(spark, d), "close", ("symbol",)))


@query("return_ratios", f"WITH {_LINE}, r AS (SELECT symbol, close / lag(close) OVER {_W} - 1 AS r FROM bars) SELECT symbol, count(r) AS n, {_r('avg(r) / stddev_samp(r)')} AS sharpe, {_r('avg(r) / sqrt(avg(pow(least(r, 0), 2)))')} AS sortino FROM r WHERE r IS NOT NULL GROUP BY 1")
def return_ratios(spark, d):
    w = Series().window
    r = lineitem_bars(spark, d).select("symbol", (F.col("close") / F.lag("close").over(w) - 1).alias("r")).where("r is not null")
    return rounded(S.return_ratios(r, "r", ("symbol",)))


@query("daily_stability", f"WITH {_LEDGER}, p AS (SELECT symbol, entry_ts // 86400 AS d, sum(pnl) AS p FROM t GROUP BY 1, 2) SELECT symbol, count(*) AS days, {_r('avg(CAST(p > 0 AS DOUBLE))')} AS stability FROM p GROUP BY 1")
def daily_stability(spark, d):
    return rounded(S.daily_stability(_ledger(spark, d), "entry_ts", "pnl", ("symbol",)))


@query("win_loss", f"WITH {_LEDGER} SELECT symbol, count(pnl) AS total, CAST(count(*) FILTER (WHERE pnl > 0) AS BIGINT) AS winning, CAST(count(*) FILTER (WHERE pnl < 0) AS BIGINT) AS losing, {_r('avg(CAST(pnl > 0 AS DOUBLE))')} AS win_rate, {_r('avg(pnl)', 4)} AS expected_value FROM t GROUP BY 1")
def win_loss(spark, d):
    return rounded(S.win_loss(_ledger(spark, d), "pnl", ("symbol",)).withColumn("expected_value", F.round("expected_value", 4)))


@query("buy_and_hold", f"WITH {_LINE}, r AS (SELECT *, close / lag(close) OVER {_W} - 1 AS r, ts - lag(ts) OVER {_W} AS gap, max(close) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM bars) SELECT symbol, {_r('(arg_max(close, ts) / arg_min(close, ts) - 1) * 100', 2)} AS return_percent, {_r('max((peak - close) / peak) * 100', 2)} AS max_drawdown_percent, {_r('avg(r) / stddev_samp(r) * sqrt(31536000 / min(gap))', 2)} AS sharpe_ratio FROM r GROUP BY 1")
def buy_and_hold(spark, d):
    return rounded(S.buy_and_hold(lineitem_bars(spark, d)), 2)


# Backtests and search

_FIVE = [P.Run(n) for n in sorted(REGISTRY)]


_IDS = {n: P.Run(n).run_id for n in REGISTRY}
_ALL = f"""WITH RECURSIVE {_events()}, {_NUM}, {smooth_sql.directional()}, g AS MATERIALIZED ({loop_sql.all_strategies(_IDS)}), {loop_sql.loop('g')}, {loop_sql.trades('g')}"""


@query(
    "backtest_trades",
    f"""{_ALL} SELECT run AS run_id, symbol, 'long' AS direction, {_r('qty')} AS qty, {_r('entry_price')} AS entry_price, entry_ts, {_r('exit_price')} AS exit_price, exit_ts, {_r('pnl')} AS pnl, 0.0 AS commission, bars_held, {_r('mae')} AS mae, {_r('mfe')} AS mfe, exit_reason FROM t""",
)
def backtest_trades(spark, d):
    """All strategies with their defaults over hourly bars of every symbol."""
    return rounded(P.trades_of(P.backtest(event_bars(spark, d), _FIVE)))


_TRADES_SQL = _SQL["backtest_trades"]


@query("backtest_blocks", _TRADES_SQL)
def backtest_blocks(spark, d):
    """The same trades, simulated in blocks of 50 bars."""
    return rounded(P.trades_of(blockwise.backtest_blocks(event_bars(spark, d), _FIVE, 3600, rows=50)))


#: Thresholds that hourly bars of the events reach, so that the strategies trade.
_LOOSE = [P.Run(n, {"rsi_reversal": {"oversoldThreshold": 45, "overboughtThreshold": 55}, "bb_reversal": {"stdDev": 1.0}, "adx_trend_pullback": {"adxThreshold": 15, "rsiPullbackLevel": 50}}.get(n)) for n in sorted(REGISTRY)]
_RANGED = f"q0 AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {_W}), abs(low - lag(close) OVER {_W})) AS tr0 FROM n), q AS MATERIALIZED (SELECT * EXCLUDE (tr0), {smooth_sql.wilder('tr0', 14)} AS rng FROM q0)"
_LOOSE_SQL = loop_sql.all_strategies({r.strategy: r.run_id for r in _LOOSE}, "q", "rng", 45, 55, 1.0, 15, 50)


def _account(rules: loop_sql.Rules, signals: str = _LOOSE_SQL) -> str:
    """Common tables up to the trades ``t`` of an account with these rules."""
    return f"WITH RECURSIVE {_events()}, {_NUM}, {_RANGED}, {smooth_sql.directional(source='q')}, g AS MATERIALIZED ({signals}), {loop_sql.account('g', rules)}, {loop_sql.account_trades('g', rules)}"


def _traded(direction: str, source: str = "t") -> str:
    return f"SELECT run AS run_id, symbol, '{direction}' AS direction, {_r('qty')} AS qty, {_r('entry_price')} AS entry_price, entry_ts, {_r('exit_price')} AS exit_price, exit_ts, {_r('pnl')} AS pnl, {_r('commission')} AS commission, bars_held, {_r('mae')} AS mae, {_r('mfe')} AS mfe, exit_reason FROM {source}"


@query("backtest_short", f"{_account(loop_sql.Rules(-1, 0.1, 0.05))} {_traded('short')}")
def backtest_short(spark, d):
    """Strategies with looser thresholds on the short side, with a commission."""
    settings = P.Settings(direction="short", commission=Commission("percentage", 0.1, 0.05))
    return rounded(P.trades_of(P.backtest(event_bars(spark, d), _LOOSE, settings)))


_EXITS = (("stop_loss", static_stop), ("trail", TrailingStop(percent=2.0)), ("take_profit", static_target), ("condition", condition_exit), ("age", MaxBars(1)))


@query("backtest_exits", f"{_account(loop_sql.Rules(1, 0.0, 0.25, exits=loop_sql.exits_of(1, 2.0, 1, True)))} {_traded('long')}")
def backtest_exits(spark, d):
    """All exit rules in order, with a flat commission."""
    return rounded(P.trades_of(P.backtest(event_bars(spark, d), _LOOSE, P.Settings(rules=_EXITS, commission=Commission("fixed", 0.25)))))


_SIZED = P.Run("sma_crossover", {"fastPeriod": 5, "slowPeriod": 20})
_DISTANCE = "CASE WHEN price > {0} THEN (price - {0}) / price ELSE 0.05 END"
_SIZERS = {
    "fixed_dollar": (Sizing("fixed_dollar", fixed=250.0), "250.0"),
    "risk_based": (Sizing("risk_based", percent=0.02), f"least(cash * 0.02 / 100 / ({_DISTANCE.format('stop')}), cash)"),
    "kelly": (Sizing("kelly", win_rate=0.55, payoff=1.2, fraction=0.05), f"cash * {(0.55 - 0.45 / 1.2) * 0.05!r}"),
    "atr_volatility": (Sizing("atr_volatility", percent=0.02, atr_multiplier=0.2), f"least(cash * 0.02 / 100 / (CASE WHEN atr IS NULL THEN 0.05 ELSE {_DISTANCE.format('(price - atr * 0.2)')} END), cash)"),
}


def _sizers_sql() -> str:
    tables = [f"WITH RECURSIVE {_events()}, {_NUM}, {_RANGED}, g AS MATERIALIZED ({loop_sql.sma_grid([(_SIZED.run_id, 5, 20)], 'q', 'rng')})"]
    for name, (_, stake) in _SIZERS.items():
        tables += [loop_sql.account("g", loop_sql.Rules(stake=stake), f"r_{name}"), loop_sql.account_trades("g", loop_sql.Rules(stake=stake), f"r_{name}", f"t_{name}")]
    return ", ".join(tables) + " " + " UNION ALL ".join(f"SELECT '{n}' AS sizer, * FROM ({_traded('long', f't_{n}')})" for n in _SIZERS)


@query("backtest_sizers", _sizers_sql())
def backtest_sizers(spark, d):
    """One strategy under each of the sizers beside the default."""
    out = None
    for name, (sizing, _) in _SIZERS.items():
        one = P.trades_of(P.backtest(event_bars(spark, d), [_SIZED], P.Settings(sizing=sizing))).select(F.lit(name).alias("sizer"), "*")
        out = one if out is None else out.unionByName(one)
    return rounded(out)


_FIGURES = (*P._CURVE, *P._TRADES)
_WHOLE = set(P._WHOLE)


def _figures(source: str) -> str:
    # yearly growth of a month's gains is compared by its logarithm, as six decimals of a double do not hold it
    return ", ".join(c if c in _WHOLE else f"{_r('log10(1 + cagr)' if c == 'cagr' else c)} AS {c}" for c in _FIGURES) + f" FROM {source}"


@query("backtest_statistics", f"{_ALL}, {loop_sql.figures()} SELECT run AS run_id, symbol, {_figures('z')}")
def backtest_statistics(spark, d):
    return rounded(P.evaluate(event_bars(spark, d), _FIVE).withColumn("cagr", F.log10(1 + F.col("cagr"))))


_DUAL = P.Run("sma_crossover", {"fastPeriod": 5, "slowPeriod": 20}).run_id
#: Signals of four-hourly bars, at the last hourly bar of each.
_FINE = f"""h4 AS (SELECT symbol, bars.ts // 14400 * 14400 AS ts, {_AGG.replace('ts)', 'bars.ts)')} FROM bars GROUP BY 1, 2), n4 AS (SELECT *, row_number() OVER {_W} AS p FROM h4), s4 AS ({loop_sql.sma_grid([(_DUAL, 5, 20)], 'n4')}),
  nf AS (SELECT *, row_number() OVER {_W} AS p, row_number() OVER (PARTITION BY symbol, ts // 14400 ORDER BY ts DESC) AS back FROM bars),
  g AS MATERIALIZED (SELECT s4.run, nf.symbol, nf.p, nf.ts, nf.open, nf.high, nf.low, nf.close, s4.ent AND back = 1 AS ent, s4.lev AND back = 1 AS lev, s4.sl, s4.tp, s4.stp, s4.p AS i FROM nf JOIN s4 ON s4.symbol = nf.symbol AND s4.ts = nf.ts // 14400 * 14400)"""


@query(
    "backtest_dual",
    f"""WITH RECURSIVE {_events()}, {_FINE}, {loop_sql.loop('g')}, {loop_sql.trades('g')} SELECT t.run AS run_id, t.symbol, 'long' AS direction, {_r('qty')} AS qty, {_r('entry_price')} AS entry_price, entry_ts, {_r('exit_price')} AS exit_price, exit_ts, {_r('pnl')} AS pnl, 0.0 AS commission,
    b.i - a.i AS bars_held, {_r('mae')} AS mae, {_r('mfe')} AS mfe, exit_reason FROM t JOIN g a ON a.symbol = t.symbol AND a.ts = entry_ts JOIN g b ON b.symbol = t.symbol AND b.ts = exit_ts""",
)
def backtest_dual(spark, d):
    fine = event_bars(spark, d)
    return rounded(P.trades_of(P.backtest_dual(B.aggregate(fine, 14400), fine, 14400, [P.Run("sma_crossover", {"fastPeriod": 5, "slowPeriod": 20})])))


_SPACE = {"fastPeriod": G.Dimension(5, 15, 5, True), "slowPeriod": G.Dimension(20, 40, 10, True)}


def _grid():
    return list(G.grid(_SPACE))


_SETS = [(P.Run("sma_crossover", x).run_id, x["fastPeriod"], x["slowPeriod"]) for x in _grid()]
_SEARCHED = f"WITH RECURSIVE {_events()}, {_NUM}, g AS MATERIALIZED ({loop_sql.sma_grid(_SETS)}), {loop_sql.loop('g')}, {loop_sql.trades('g')}, {loop_sql.figures()}"


@query(
    "optimise_grid",
    f"""{_SEARCHED} SELECT CAST(row_number() OVER (ORDER BY sharpe_ratio DESC, run) AS INTEGER) AS rank, {_r('sharpe_ratio')} AS score, substr(run, 15) AS parameters, {_r('total_return_percent')} AS total_return_percent, {_r('sharpe_ratio')} AS sharpe_ratio, {_r('sortino_ratio')} AS sortino_ratio,
    {_r('max_drawdown_percent')} AS max_drawdown_percent, {_r('win_rate')} AS win_rate, {_r('profit_factor')} AS profit_factor, total_trades FROM z WHERE total_trades > 0 ORDER BY sharpe_ratio DESC, run, symbol LIMIT 10""",
)
def optimise_grid(spark, d):
    best = G.optimise(event_bars(spark, d), "sma_crossover", _grid(), top=10)
    return rounded(export.ranked_runs(best))


@query(
    "optimise_portfolio",
    f"""{_SEARCHED}, o AS (SELECT *, 0.4 * greatest(sharpe_ratio, 0) + 0.3 * total_return_percent / greatest(max_drawdown_percent * 100, 1) + 0.2 * win_rate + 0.1 * least(total_trades / 50, 1) AS own, stddev_pop(total_return_percent) OVER (PARTITION BY run) AS spread, avg(total_return_percent) OVER (PARTITION BY run) AS mean FROM z WHERE total_trades >= 1),
    m AS (SELECT run, avg(own) AS own, max(CASE WHEN spread > 0 THEN abs((total_return_percent - mean) / spread) ELSE 0 END) AS zz, count(*) AS n, avg(total_return_percent) AS ret, avg(sharpe_ratio) AS sharpe, avg(win_rate) AS win, CAST(sum(total_trades) AS BIGINT) AS trades FROM o GROUP BY 1)
    SELECT run AS run_id, {_r('greatest(own * (1 - CASE WHEN n > 1 THEN greatest(0, least(0.5, 1 - 0.5 * zz)) ELSE 0 END) * n / 5, 0)')} AS score, n AS symbols, {_r('ret')} AS total_return_percent, {_r('sharpe')} AS sharpe_ratio, {_r('win')} AS win_rate, trades AS total_trades FROM m""",
)
def optimise_portfolio(spark, d):
    return rounded(G.portfolio(G.evaluate(event_bars(spark, d), "sma_crossover", _grid()), 5))


def _ranged(tag: str, a: int, b: int) -> str:
    """Common tables of the search over a range of time, ending with ``z<tag>``."""
    signals, account, closed = f"g{tag}", f"r{tag}", f"t{tag}"
    bars = f"n{tag} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS p FROM bars WHERE ts BETWEEN {a} AND {b})"
    return f"{bars}, {signals} AS MATERIALIZED ({loop_sql.sma_grid(_SETS, f'n{tag}')}), {loop_sql.loop(signals, account)}, {loop_sql.trades(signals, account, closed)}, {loop_sql.figures(account, closed, f'z{tag}')}"


_KEPT = ("total_return_percent", "sharpe_ratio", "max_drawdown_percent", "win_rate")


@query(
    "walk_forward",
    f"""WITH RECURSIVE {_events()}, {_ranged('i', 1704067200, 1706054399)}, {_ranged('u', 1706054400, 1706745599)}, best AS (SELECT *, row_number() OVER (ORDER BY sharpe_ratio DESC, run, symbol) AS k FROM zi WHERE total_trades > 0)
    SELECT b.run AS run_id, b.symbol, CAST(b.k AS INTEGER) AS rank, {_r('b.sharpe_ratio')} AS is_score, {', '.join(f"{_r(f'b.{c}')} AS is_{c}" for c in _KEPT)}, b.total_trades AS is_total_trades, {_r('o.sharpe_ratio')} AS oos_score, {', '.join(f"{_r(f'o.{c}')} AS oos_{c}" for c in _KEPT)}, o.total_trades AS oos_total_trades,
    {_r('CASE WHEN b.sharpe_ratio <> 0 THEN (b.sharpe_ratio - coalesce(o.sharpe_ratio, 0)) / abs(b.sharpe_ratio) * 100 ELSE 0 END', 4)} AS degradation FROM best b LEFT JOIN zu o ON o.run = b.run AND o.symbol = b.symbol WHERE b.k <= 10""",
)
def walk_forward(spark, d):
    import datetime as dt

    s = G.split_dates(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    out = G.walk_forward(event_bars(spark, d), "sma_crossover", _grid(), s, top=10)
    return rounded(out.withColumn("degradation", F.round("degradation", 4)))


@query(
    "walk_forward_summary",
    f"""WITH RECURSIVE {_events()}, {_ranged('i', 1704067200, 1706054399)}, {_ranged('u', 1706054400, 1706745599)}, best AS (SELECT *, row_number() OVER (ORDER BY sharpe_ratio DESC, run, symbol) AS k FROM zi WHERE total_trades > 0),
    w AS (SELECT {_r('b.sharpe_ratio')} AS a, {_r('o.sharpe_ratio')} AS z, {_r('CASE WHEN b.sharpe_ratio <> 0 THEN (b.sharpe_ratio - o.sharpe_ratio) / abs(b.sharpe_ratio) * 100 ELSE 0 END', 4)} AS d, o.total_trades AS n, {_r('o.total_return_percent')} AS ret FROM best b JOIN zu o ON o.run = b.run AND o.symbol = b.symbol WHERE b.k <= 10),
    q AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY z) + (count(*) OVER (PARTITION BY z) - 1) / 2 AS rz FROM w),
    m AS (SELECT count(*) AS results, avg(a) AS mean_is, avg(z) AS mean_oos, median(a) AS median_is, median(z) AS median_oos, CASE WHEN avg(a) <> 0 THEN avg(z) / avg(a) * 100 ELSE 0 END AS efficiency, count(*) FILTER (WHERE z > 0) AS profitable, count(*) FILTER (WHERE z > 0 AND d < 50) / count(*) * 100 AS robust_percent,
      count(*) FILTER (WHERE n >= 1) AS reliable, count(*) FILTER (WHERE ret > 10) AS strong_returns, max(z) AS best_oos, CASE WHEN count(*) >= 2 THEN CASE WHEN max(z) = min(z) THEN 0 ELSE coalesce(corr(ra, rz), 0) END END AS spearman FROM q)
    SELECT results, {_r('mean_is')} AS mean_is, {_r('mean_oos')} AS mean_oos, {_r('median_is')} AS median_is, {_r('median_oos')} AS median_oos, {_r('efficiency')} AS efficiency, profitable, {_r('robust_percent')} AS robust_percent, reliable, strong_returns, {_r('best_oos')} AS best_oos, {_r('spearman')} AS spearman,
    CASE WHEN efficiency < 10 OR robust_percent < 10 THEN 'likely_overfit' WHEN spearman > 0.8 AND efficiency > 70 AND robust_percent > 70 THEN 'excellent' WHEN spearman > 0.6 AND efficiency > 50 AND robust_percent > 50 THEN 'good' WHEN spearman > 0.4 AND efficiency > 30 THEN 'moderate' ELSE 'weak' END AS tier,
    CASE WHEN spearman > 0.7 THEN 'stable' WHEN spearman >= 0.3 THEN 'moderate' ELSE 'unstable' END AS rank_stability FROM m""",
)
def walk_forward_summary(spark, d):
    return rounded(G.walk_forward_summary(walk_forward(spark, d)))


def _scored(spark, d) -> DataFrame:
    """Parts as runs: size and a price class are the parameters, the retail price the score."""
    return table(spark, d, "part").select(F.create_map(F.lit("size"), F.col("p_size").cast("double"), F.lit("cls"), (F.col("p_partkey") % 4).cast("double")).alias("params"), F.col("p_retailprice").alias("score"))


_VALUES = "v AS (SELECT 'size' AS name, CAST(p_size AS DOUBLE) AS value, avg(p_retailprice) AS m FROM part GROUP BY ALL UNION ALL SELECT 'cls', CAST(p_partkey % 4 AS DOUBLE), avg(p_retailprice) FROM part GROUP BY ALL)"


@query("sensitivity_importance", f"WITH {_VALUES}, s AS (SELECT name, var_pop(m) AS variance, count(*) AS values FROM v GROUP BY 1) SELECT name, {_r('variance', 4)} AS variance, values, {_r('variance / sum(variance) OVER () * 100', 4)} AS importance FROM s")
def sensitivity_importance(spark, d):
    return rounded(G.importance(_scored(spark, d)), 4)


@query("sensitivity_surface", "SELECT a, b, round(mean, 4) + 0.0 AS mean, runs FROM (SELECT DISTINCT CAST(p_partkey % 4 AS DOUBLE) AS a FROM part) CROSS JOIN (SELECT DISTINCT CAST(p_size AS DOUBLE) AS b FROM part) LEFT JOIN (SELECT CAST(p_partkey % 4 AS DOUBLE) AS a, CAST(p_size AS DOUBLE) AS b, avg(p_retailprice) AS mean, count(*) AS runs FROM part GROUP BY ALL) USING (a, b)")
def sensitivity_surface(spark, d):
    return rounded(G.score_surface(_scored(spark, d), "cls", "size"), 4)


@query("sensitivity_interactions", f"WITH {_VALUES}, o AS (SELECT name, var_pop(m) AS own FROM v GROUP BY 1), j AS (SELECT var_pop(m) AS joint FROM (SELECT avg(p_retailprice) AS m FROM part GROUP BY p_size, p_partkey % 4)) SELECT 'cls' AS a, 'size' AS b, {_r('joint', 4)} AS joint, {_r('(SELECT own FROM o WHERE name = ' + chr(39) + 'cls' + chr(39) + ')', 4)} AS own_a, {_r('(SELECT own FROM o WHERE name = ' + chr(39) + 'size' + chr(39) + ')', 4)} AS own_b, {_r('joint - (SELECT sum(own) FROM o)', 4)} AS interaction FROM j")
def sensitivity_interactions(spark, d):
    return rounded(G.interactions(_scored(spark, d)), 4)


def _pnl(spark, d) -> DataFrame:
    """Customers as trades, by key: what their orders are above or below the usual, in thousands."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice") - 150000).alias("v"))
    c = table(spark, d, "customer").select("c_custkey")
    own = F.round(F.coalesce("v", F.lit(0.0)) / 1000, 2)
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select((F.col("c_custkey") - F.lit(_first_key(c))).cast("long").alias("place"), own.alias("pnl"))


def _first_key(customers: DataFrame) -> int:
    return customers.agg(F.min("c_custkey")).first()[0]


_STEP = "({} * 1103515245 + 12345) % 2147483648"
_DRAWN = f"""v AS (SELECT o_custkey, sum(o_totalprice - 150000) AS v FROM orders GROUP BY 1), n AS (SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS place, round(coalesce(v, 0) / 1000, 2) AS pnl FROM customer LEFT JOIN v ON o_custkey = c_custkey), c AS (SELECT count(*) AS n FROM n),
  i AS (SELECT i.range AS iteration, k.range AS k, c.n FROM range(1000) i, c, range((SELECT n FROM c)) k),
  s0 AS (SELECT *, (iteration * 7919 + k * 104729 + 42 * 31 + 17) % 2147483648 AS x FROM i), s1 AS (SELECT *, {_STEP.format('x')} AS y FROM s0), s2 AS (SELECT *, {_STEP.format('y')} AS a FROM s1), s3 AS (SELECT *, {_STEP.format('a')} AS b FROM s2), s4 AS (SELECT *, {_STEP.format('b')} AS e FROM s3),
  d AS (SELECT iteration, k, pnl FROM s4 JOIN n ON n.place = ((a // 65536 * 32768 + b // 65536) * 32768 + e // 65536) % s4.n),
  e AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY iteration ORDER BY k ROWS UNBOUNDED PRECEDING) AS equity FROM d),
  f AS (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY iteration ORDER BY k ROWS UNBOUNDED PRECEDING)) - equity AS fall FROM e)"""


@query("monte_carlo", f"WITH {_DRAWN} SELECT iteration, {_r('sum(pnl)')} AS total_return, {_r('avg(CAST(pnl > 0 AS DOUBLE))')} AS win_rate, {_r('max(fall)')} AS max_drawdown, {_r('avg(pnl) / stddev_samp(pnl)')} AS sharpe_ratio FROM f GROUP BY 1")
def monte_carlo(spark, d):
    return rounded(montecarlo.bootstrap(_pnl(spark, d)).select("iteration", "total_return", "win_rate", "max_drawdown", "sharpe_ratio"))


_MC = f"m AS (SELECT iteration, sum(pnl) AS total_return, sum(pnl) / 10000 * 100 AS total_return_percent, avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate, CASE WHEN sum(least(pnl, 0)) <> 0 THEN sum(greatest(pnl, 0)) / abs(sum(least(pnl, 0))) ELSE 1e308 END AS profit_factor, max(fall) AS max_drawdown, avg(pnl) / stddev_samp(pnl) AS sharpe_ratio FROM f GROUP BY 1), u AS (UNPIVOT m ON total_return, total_return_percent, win_rate, profit_factor, max_drawdown, sharpe_ratio INTO NAME metric VALUE v)"


@query("monte_carlo_summary", f"WITH {_DRAWN}, {_MC} SELECT metric, {_r('quantile_cont(v, 0.05)')} AS p5, {_r('quantile_cont(v, 0.25)')} AS p25, {_r('quantile_cont(v, 0.5)')} AS p50, {_r('quantile_cont(v, 0.75)')} AS p75, {_r('quantile_cont(v, 0.95)')} AS p95, {_r('avg(CAST(CASE WHEN metric = ' + chr(39) + 'profit_factor' + chr(39) + ' THEN v < 1 ELSE v < 0 END AS DOUBLE))')} AS p_negative FROM u GROUP BY 1")
def monte_carlo_summary(spark, d):
    return rounded(montecarlo.summary(montecarlo.bootstrap(_pnl(spark, d))).drop("significant"))


_SIX = ", ".join(f"printf('%.6f', {c}) AS {c}" for c in ("qty", "entry_price", "exit_price", "pnl", "commission", "mae", "mfe"))


@query("export_trades", f"WITH RECURSIVE {_events()}, {_NUM}, g AS MATERIALIZED ({loop_sql.sma_grid([('sma', 10, 50)])}), {loop_sql.loop('g')}, {loop_sql.trades('g')} SELECT 'long' AS direction, entry_ts, exit_ts, exit_reason, {_SIX} FROM (SELECT *, 0.0::DOUBLE AS commission FROM t)")
def export_trades(spark, d):
    return export.trades_table(P.trades_of(P.backtest(event_bars(spark, d), [P.Run("sma_crossover")])))


@query(
    "boundary_warnings",
    f"""{_SEARCHED}, o AS (SELECT substr(run, 15) AS params, row_number() OVER (ORDER BY sharpe_ratio DESC, run, symbol) AS rank FROM z WHERE total_trades >= 1),
    v AS (SELECT name, CAST(json_extract(params, '$.' || name) AS DOUBLE) AS value, low, high FROM o, (VALUES ('fastPeriod', 5.0, 15.0), ('slowPeriod', 20.0, 40.0)) e(name, low, high) WHERE rank <= 10),
    w AS (SELECT name, avg(CAST(value <= low AS DOUBLE)) AS at_low, avg(CAST(value >= high AS DOUBLE)) AS at_high FROM v GROUP BY 1)
    SELECT name, {_r('at_low')} AS at_low, {_r('at_high')} AS at_high, CASE WHEN at_low >= 0.5 THEN 'low' WHEN at_high >= 0.5 THEN 'high' END AS warning FROM w""",
)
def boundary_warnings(spark, d):
    """Whether the ten best sets of the search crowd at an end of a parameter's range."""
    results = G.score(G.evaluate(event_bars(spark, d), "sma_crossover", _grid()), G.objective("sharpe_ratio"))
    return rounded(G.boundary_warnings(results, _SPACE))


@query("expected_streaks", f"WITH {_LEDGER}, w AS (SELECT symbol, count(*) AS n, avg(CAST(pnl > 0 AS DOUBLE)) AS rate FROM t GROUP BY 1) SELECT symbol, n AS trades, {_r('CASE WHEN n >= 2 AND rate < 1 THEN 1 / (1 - rate) END')} AS win_streak, {_r('CASE WHEN n >= 2 AND rate > 0 THEN 1 / rate END')} AS loss_streak FROM w")
def expected_streaks(spark, d):
    own = _ledger(spark, d).groupBy("symbol").agg(F.count("*").alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("rate"))
    win, loss = S.expected_streaks(F.col("rate"), F.col("trades"))
    return rounded(own.select("symbol", "trades", win.alias("win_streak"), loss.alias("loss_streak")))


@query("regime_labels", f"SELECT DISTINCT regime FROM ({_SQL['regime_combined']}) WHERE regime IS NOT NULL")
def regime_labels(spark, d):
    """The distinct labels of the combined regime."""
    return regimes.labels(regime_combined(spark, d))


@query(
    "sliding_means",
    f"""WITH e AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS t, value FROM events), w AS (SELECT symbol, value, (t // 3600 - k.k) * 3600 AS start FROM e, (VALUES (0), (1), (2)) k(k))
    SELECT symbol, CAST(start AS BIGINT) AS start, CAST(start + 10800 AS BIGINT) AS stop, {_r('avg(value)')} AS mean, count(*) AS ticks FROM w GROUP BY 1, 2, 3""",
)
def sliding_means(spark, d):
    """Means of windows of three hours that begin every hour, by the function that also runs on streams."""
    from .streaming.bars import sliding_means as means

    ticks = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("price"))
    return rounded(means(ticks, "3 hours", "1 hour"))


@query("binary_bars", f"WITH {_events()} SELECT {_RBARS} FROM bars WHERE bars.ts BETWEEN 1704153600 AND 1705363200")
def binary_bars(spark, d):
    """Bars written to archives of fixed-length records, and a range of time read back from them."""
    from .sources import barfiles
    from .sources.store import scratch_folder

    folder = scratch_folder(spark, "archives")
    barfiles.write(event_bars(spark, d), folder, "1h", bars_per_file=200)
    return rounded(barfiles.read(spark, folder, 1704153600, 1705363200).drop("timeframe", "data_type"))


@query("surface_incremental", _SQL["opencross_surface"])
def surface_incremental(spark, d):
    """The surface of all bars, from counts of two thirds of the days that two updates bring up to date."""
    from .operators.surfacestore import SurfaceStore
    from .sources.store import scratch_folder

    bars = event_bars(spark, d, 60, True)
    day = F.floor(F.col("ts") / 86400)
    store = SurfaceStore(spark, scratch_folder(spark, "surface"), CROSS)
    stale = bars.where(day % 3 < 2).withColumn("close", F.when(day % 3 == 1, F.col("open")).otherwise(F.col("close")))
    store.update(stale, stale)
    store.update(bars, bars.where(day % 3 == 1))
    store.update(bars, bars.where(day % 3 == 2))
    return rounded(store.surface())


@query("streamed_bars", f"WITH {_events()} SELECT {_RBARS} FROM bars")
def streamed_bars(spark, d):
    """Hourly bars of the events as a stream that is run to its end; each batch is merged into a versioned table."""
    from .sources.store import scratch_folder
    from .streaming.bars import merge_into, merged, open_bars

    path = f"{d}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else d + "/event[s].parquet")
    ticks = stream.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("price"), F.lit(1.0).alias("size"))
    folder = scratch_folder(spark, "stream")
    merge_into(open_bars(ticks, 3600), f"{folder}/bars", f"{folder}/checkpoint", "update").awaitTermination()
    return rounded(merged(spark, f"{folder}/bars"))


def _is_folder(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
