"""SQL of backtests by a recursion over bars, for comparison with another engine.

A signal table has ``run, symbol, p`` (place from 1), bars, ``ent`` and ``lev`` (entry and
exit signals), ``sl`` and ``tp`` (percent) and ``stp`` (a stop price or null). Orders are
market orders of 1 % of equity, without commission, as the defaults of a backtest.
"""

from __future__ import annotations

from dataclasses import dataclass

from . import smooth_sql as sm

_W = "(PARTITION BY symbol ORDER BY ts)"


def _last(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(n: int, x: str) -> str:
    return f"CASE WHEN p >= {n} THEN {x} END"


def crossings(a: str, b: str) -> tuple[str, str]:
    above = f"coalesce(lag({a}) OVER {_W} <= lag({b}) OVER {_W} AND {a} > {b}, false)"
    below = f"coalesce(lag({a}) OVER {_W} >= lag({b}) OVER {_W} AND {a} < {b}, false)"
    return above, below


def _signal(source: str, run: str, entry: str, leave: str, loss: float, gain: float, stop: str = "CAST(NULL AS DOUBLE)", span: str = "") -> str:
    return f"SELECT '{run}' AS run, symbol, p, ts, open, high, low, close, {f'{span} AS atr, ' if span else ''}{entry} AS ent, {leave} AS lev, {float(loss)!r}::DOUBLE AS sl, {float(gain)!r}::DOUBLE AS tp, {stop} AS stp FROM {source}"


def sma_grid(sets: list[tuple[str, int, int]], source: str = "n", span: str = "") -> str:
    """Signal table of mean crossings for (run, fast, slow)."""
    parts = []
    for run, fast, slow in sets:
        inner = f"(SELECT *, {_full(fast, f'avg(close) OVER {_last(fast)}')} AS f, {_full(slow, f'avg(close) OVER {_last(slow)}')} AS s FROM {source})"
        parts.append(_signal(inner, run, *crossings("f", "s"), 5, 10, span=span))
    return " UNION ALL ".join(parts)


def all_strategies(ids: dict[str, str], source: str = "n", span: str = "", oversold: float = 30, overbought: float = 70, deviations: float = 2, trend: float = 25, pullback: float = 40) -> str:
    """Signal table of the eight strategies, with their defaults but for the thresholds given; ``ids`` names the
    runs, ``span`` a column of ``source`` with the true range."""
    before = f"lag(close) OVER {_W}"
    base = f"(SELECT *, greatest(close - {before}, 0) AS up, greatest({before} - close, 0) AS dn, greatest(high - low, abs(high - {before}), abs(low - {before})) AS tr, max(high) OVER {_last(14)} AS t14, min(low) OVER {_last(14)} AS b14 FROM {source})"
    rsi = "CASE WHEN g + l = 0 THEN 0 ELSE 100 * g / (g + l) END"
    wild = f"(SELECT *, {sm.wilder('up', 14)} AS g, {sm.wilder('dn', 14)} AS l, {sm.wilder('tr', 14)} AS atr FROM {base})"
    rsis = f"(SELECT *, {rsi} AS r FROM {wild})"
    risen = f"(SELECT *, lag(r) OVER {_W} AS r1 FROM {rsis})"
    emas = f"(SELECT *, {sm.ema('close', 10)} AS f, {sm.ema('close', 30)} AS s FROM {source})"
    quick = sm.smoothed("close", 2 / 13, "avg(CASE WHEN p BETWEEN 15 AND 26 THEN close END) OVER (PARTITION BY symbol)", 26)
    lines = f"(SELECT *, {quick} - {sm.ema('close', 26)} AS f0 FROM {source})"
    macd = f"(SELECT *, CASE WHEN s IS NOT NULL THEN f0 END AS f FROM (SELECT *, {sm.ema('f0', 9, 26)} AS s FROM {lines}))"
    fast_k = f"(SELECT *, {_full(14, 'CASE WHEN t14 > b14 THEN (close - b14) / (t14 - b14) * 100 ELSE 0 END')} AS k FROM {base})"
    slow_k = f"(SELECT *, {_full(16, f'avg(k) OVER {_last(3)}')} AS f FROM {fast_k})"
    stoch = f"(SELECT *, {_full(18, f'avg(f) OVER {_last(3)}')} AS s FROM {slow_k})"
    middle, square = f"avg(close) OVER {_last(20)}", f"avg(close * close) OVER {_last(20)}"
    bands = f"(SELECT *, {_full(20, middle)} AS mid, {_full(20, f'{middle} - {deviations} * sqrt(greatest({square} - {middle} * {middle}, 0))')} AS lower FROM {source})"
    broken = f"(SELECT *, {_full(20, f'max(high) OVER {_last(20)}')} AS f, {_full(10, f'min(low) OVER {_last(10)}')} AS s FROM {wild})"
    parts = [
        sma_grid([(ids["sma_crossover"], 10, 50)], source, span),
        _signal(emas, ids["ema_crossover"], *crossings("f", "s"), 3, 6, span=span),
        _signal(macd, ids["macd_crossover"], *crossings("f", "s"), 3, 6, span=span),
        _signal(risen, ids["rsi_reversal"], f"coalesce(r < {oversold} AND r > r1, false)", f"coalesce(r > {overbought} AND r < r1, false)", 3, 6, span=span),
        _signal(stoch, ids["stoch_reversal"], *crossings("f", "s"), 3, 6, span=span),
        _signal(bands, ids["bb_reversal"], crossings("close", "lower")[1], crossings("close", "mid")[0], 2, 4, span=span),
        _signal(f"(SELECT *, lag(r) OVER {_W} AS r1 FROM (SELECT x.*, y.r FROM x JOIN {rsis} y USING (symbol, ts)))", ids["adx_trend_pullback"], f"coalesce(adx > {trend} AND r < {pullback} AND r > r1, false)", f"coalesce(adx < {trend}, false) OR coalesce(r > 70, false)", 4, 8, span=span),
        _signal(broken, ids["breakout"], crossings("close", "f")[0], crossings("close", "s")[1], 4, 12, "close - atr * 2", span),
    ]
    return " UNION ALL ".join(parts)


def loop(signals: str, name: str = "r") -> str:
    """A recursive table of the account after each bar, and of the trade that it closed."""
    # f: waiting orders; l: exit rules (what: the reason of an exit); d: decisions
    return f"""{name} AS (
  SELECT run, symbol, 0::BIGINT AS p, 0::BIGINT AS ts, 10000.0::DOUBLE AS cash, NULL::DOUBLE AS qty, NULL::DOUBLE AS ep, NULL::BIGINT AS ets, NULL::DOUBLE AS stop, NULL::DOUBLE AS target, NULL::DOUBLE AS hi, NULL::DOUBLE AS lo,
    0 AS ord, 0.0::DOUBLE AS stake, NULL::DOUBLE AS ostop, NULL::DOUBLE AS otarget, 10000.0::DOUBLE AS equity,
    NULL::DOUBLE AS t_qty, NULL::DOUBLE AS t_ep, NULL::BIGINT AS t_ets, NULL::DOUBLE AS t_xp, NULL::DOUBLE AS t_lo, NULL::DOUBLE AS t_hi, NULL::VARCHAR AS why
  FROM {signals} WHERE p = 1
  UNION ALL
  SELECT r.run, r.symbol, g.p, g.ts, l.cash, l.qty, l.ep, l.ets, l.stop, l.target, l.hi, l.lo,
    CASE WHEN g.ent AND l.qty IS NULL AND g.close > 0 THEN 1 WHEN g.lev AND NOT (g.ent AND l.qty IS NULL AND g.close > 0) AND l.qty IS NOT NULL THEN 2 ELSE 0 END,
    l.cash * 0.01, coalesce(g.stp, g.close * (100 - g.sl) / 100), g.close * (100 + g.tp) / 100, l.cash + coalesce(l.qty * g.close, 0),
    l.t_qty, l.t_ep, l.t_ets, l.t_xp, l.t_lo, l.t_hi, l.why
  FROM {name} r JOIN {signals} g ON g.run = r.run AND g.symbol = r.symbol AND g.p = r.p + 1,
  LATERAL (SELECT CASE WHEN r.ord = 2 AND g.open > 0 AND r.qty IS NOT NULL THEN 'counter_signal' END AS gone, r.ord = 1 AND r.qty IS NULL AND g.open > 0 AND r.stake > 0 AND r.cash >= r.stake AS opens) o,
  LATERAL (SELECT CASE WHEN o.gone IS NOT NULL THEN NULL WHEN o.opens THEN r.stake / g.open ELSE r.qty END AS qty, CASE WHEN o.opens THEN g.open ELSE r.ep END AS ep, CASE WHEN o.opens THEN g.ts ELSE r.ets END AS ets,
    CASE WHEN o.opens THEN r.ostop ELSE r.stop END AS stop, CASE WHEN o.opens THEN r.otarget ELSE r.target END AS target, CASE WHEN o.opens THEN g.open ELSE r.hi END AS hi, CASE WHEN o.opens THEN g.open ELSE r.lo END AS lo,
    CASE WHEN o.gone IS NOT NULL THEN r.cash + r.qty * r.ep + (g.open - r.ep) * r.qty WHEN o.opens THEN r.cash - r.stake ELSE r.cash END AS cash) f,
  LATERAL (SELECT CASE WHEN f.qty IS NULL THEN NULL WHEN g.low <= f.stop THEN 'stop_loss' WHEN g.high >= f.target THEN 'take_profit' END AS what) h,
  LATERAL (SELECT CASE WHEN h.what IS NULL THEN f.qty END AS qty, f.ep, f.ets, f.stop, f.target, greatest(f.hi, g.high) AS hi, least(f.lo, g.low) AS lo,
    CASE h.what WHEN 'stop_loss' THEN f.cash + f.qty * f.ep + (f.stop - f.ep) * f.qty WHEN 'take_profit' THEN f.cash + f.qty * f.ep + (f.target - f.ep) * f.qty ELSE f.cash END AS cash,
    CASE WHEN o.gone IS NOT NULL THEN r.qty WHEN h.what IS NOT NULL THEN f.qty END AS t_qty, CASE WHEN o.gone IS NOT NULL THEN r.ep ELSE f.ep END AS t_ep, CASE WHEN o.gone IS NOT NULL THEN r.ets ELSE f.ets END AS t_ets,
    CASE WHEN o.gone IS NOT NULL THEN g.open WHEN h.what = 'stop_loss' THEN f.stop ELSE f.target END AS t_xp, CASE WHEN o.gone IS NOT NULL THEN r.lo ELSE f.lo END AS t_lo, CASE WHEN o.gone IS NOT NULL THEN r.hi ELSE f.hi END AS t_hi,
    coalesce(o.gone, h.what) AS why) l)"""


def trades(signals: str, name: str = "r", into: str = "t") -> str:
    """Closed trades, with those that the end closes."""
    last = f"(SELECT g.* FROM {signals} g JOIN (SELECT run, symbol, max(p) AS p FROM {signals} GROUP BY 1, 2) USING (run, symbol, p))"
    return f"""{into} AS (SELECT *, (exit_price - entry_price) * qty AS pnl, (lo - entry_price) / entry_price AS mae, (hi - entry_price) / entry_price AS mfe, exit_p - entry_p AS bars_held FROM (
    SELECT r.run, r.symbol, t_qty AS qty, t_ep AS entry_price, t_ets AS entry_ts, t_xp AS exit_price, r.ts AS exit_ts, t_lo AS lo, t_hi AS hi, why AS exit_reason, r.p AS exit_p, b.p AS entry_p FROM {name} r JOIN {signals} b ON b.run = r.run AND b.symbol = r.symbol AND b.ts = t_ets WHERE why IS NOT NULL
    UNION ALL SELECT r.run, r.symbol, r.qty, r.ep, r.ets, g.close, r.ts, r.lo, r.hi, 'end_of_backtest', r.p, b.p FROM {name} r JOIN {last} g ON g.run = r.run AND g.symbol = r.symbol AND g.p = r.p JOIN {signals} b ON b.run = r.run AND b.symbol = r.symbol AND b.ts = r.ets WHERE r.qty IS NOT NULL))"""


def figures(name: str = "r", source: str = "t", into: str = "z", seconds: int = 3600) -> str:
    """Figures of each run and symbol from its curve and its trades."""
    year = round(31536000 / seconds)
    base, scale = repr(0.02 / year), repr(year**0.5)
    own = "(PARTITION BY run, symbol ORDER BY p)"
    far = "(PARTITION BY run, symbol ORDER BY p ROWS UNBOUNDED PRECEDING)"
    return f"""{into}_c AS (SELECT run, symbol, p, equity, CASE WHEN lag(equity) OVER {own} <> 0 THEN equity / lag(equity) OVER {own} - 1 END AS ret, equity <> lag(equity) OVER {own} AS moved, max(equity) OVER {far} AS peak FROM {name} WHERE p > 0),
  {into}_d AS (SELECT *, sum(CASE WHEN peak - equity <= 0 THEN 1 ELSE 0 END) OVER {far} AS island FROM {into}_c),
  {into}_l AS (SELECT run, symbol, max(len) AS max_drawdown_duration FROM (SELECT run, symbol, island, count(*) FILTER (WHERE peak > equity) AS len FROM {into}_d GROUP BY ALL) GROUP BY 1, 2),
  {into}_q AS (SELECT run, symbol, count(ret) AS n, avg(ret) AS m, stddev_samp(ret) AS sd, sqrt(avg(CASE WHEN ret < {base} THEN pow(ret - {base}, 2) WHEN ret IS NOT NULL THEN 0 END)) AS down, max(peak - equity) AS max_drawdown, max((peak - equity) / peak) AS max_drawdown_percent,
    count(ret) FILTER (WHERE moved) AS an, avg(ret) FILTER (WHERE moved) AS am, stddev_samp(ret) FILTER (WHERE moved) AS asd, sqrt(avg(CASE WHEN ret < {base} THEN pow(ret - {base}, 2) WHEN ret IS NOT NULL THEN 0 END) FILTER (WHERE moved)) AS adown,
    count(*) FILTER (WHERE moved AND ret IS NOT NULL) / count(ret) * 100 AS busy, coalesce(avg(peak - equity) FILTER (WHERE peak > equity), 0) AS avg_drawdown FROM {into}_c GROUP BY 1, 2),
  {into}_t AS (SELECT run, symbol, count(*) AS total_trades, sum(pnl) AS total_return, sum(pnl) / 10000 * 100 AS total_return_percent, count(*) FILTER (WHERE pnl > 0) AS winning_trades, count(*) FILTER (WHERE pnl < 0) AS losing_trades,
    count(*) FILTER (WHERE pnl > 0) / count(*) AS win_rate, coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) AS gross_profit, coalesce(sum(pnl) FILTER (WHERE pnl < 0), 0) AS gross_loss,
    coalesce(max(pnl) FILTER (WHERE pnl > 0), 0) AS largest_win, coalesce(min(pnl) FILTER (WHERE pnl < 0), 0) AS largest_loss, coalesce(avg(pnl) FILTER (WHERE pnl > 0), 0) AS average_win, coalesce(avg(pnl) FILTER (WHERE pnl < 0), 0) AS average_loss, avg(pnl) AS expectancy,
    avg(exit_ts - entry_ts) AS avg_trade_duration, median(exit_ts - entry_ts) AS median_trade_duration, min(exit_ts - entry_ts) AS min_trade_duration, max(exit_ts - entry_ts) AS max_trade_duration, (max(exit_ts) - min(entry_ts)) / 86400 AS trading_days FROM {source} GROUP BY 1, 2),
  {into}_s0 AS (SELECT *, sign(pnl) AS sg, CASE WHEN sign(pnl) = lag(sign(pnl)) OVER (PARTITION BY run, symbol ORDER BY entry_ts) THEN 0 ELSE 1 END AS fresh FROM {source}),
  {into}_s1 AS (SELECT *, sum(fresh) OVER (PARTITION BY run, symbol ORDER BY entry_ts ROWS UNBOUNDED PRECEDING) AS island FROM {into}_s0),
  {into}_s AS (SELECT run, symbol, coalesce(max(len) FILTER (WHERE sg = 1), 0) AS max_consecutive_wins, coalesce(max(len) FILTER (WHERE sg = -1), 0) AS max_consecutive_losses FROM (SELECT run, symbol, island, sg, count(*) AS len FROM {into}_s1 GROUP BY ALL) GROUP BY 1, 2),
  {into} AS (SELECT q.run, q.symbol, CASE WHEN n >= 10 AND sd > 1e-12 THEN (m - {base}) / sd * {scale} ELSE 0 END AS sharpe_ratio, CASE WHEN n >= 10 AND sd > 1e-12 AND down > 1e-12 THEN (m - {base}) / down * {scale} ELSE 0 END AS sortino_ratio,
    CASE WHEN an >= 10 AND asd > 1e-12 THEN (am - {base}) / asd * {scale} ELSE 0 END AS active_sharpe_ratio, CASE WHEN an >= 10 AND asd > 1e-12 AND adown > 1e-12 THEN (am - {base}) / adown * {scale} ELSE 0 END AS active_sortino_ratio, CASE WHEN n >= 10 THEN coalesce(sd, 0) * {scale} ELSE 0 END AS volatility,
    busy AS time_in_market_percent, 100 - busy AS idle_capital_percent, max_drawdown, max_drawdown_percent, CAST(max_drawdown_duration AS BIGINT) AS max_drawdown_duration, avg_drawdown, coalesce(total_trades, 0) AS total_trades, total_return, total_return_percent,
    CASE WHEN trading_days > 0 AND 10000 + total_return > 0 AND total_return <> 0 THEN pow((10000 + total_return) / 10000, 365 / trading_days) - 1 WHEN total_trades > 0 THEN 0 END AS cagr, winning_trades, losing_trades, win_rate, gross_profit, gross_loss,
    CASE WHEN gross_loss <> 0 THEN gross_profit / abs(gross_loss) WHEN gross_profit > 0 THEN 'infinity'::DOUBLE WHEN total_trades > 0 THEN 0 END AS profit_factor, largest_win, largest_loss, average_win, average_loss, expectancy,
    total_trades AS long_trades, CASE WHEN total_trades > 0 THEN 0 END AS short_trades, win_rate AS long_win_rate, CASE WHEN total_trades > 0 THEN 0.0 END AS short_win_rate, avg_trade_duration, CAST(median_trade_duration AS DOUBLE) AS median_trade_duration, min_trade_duration, max_trade_duration, trading_days, max_consecutive_wins, max_consecutive_losses
    FROM {into}_q q JOIN {into}_l l USING (run, symbol) LEFT JOIN {into}_t t USING (run, symbol) LEFT JOIN {into}_s s USING (run, symbol))"""


@dataclass(frozen=True)
class Rules:
    """What the account of :func:`account` does, in SQL; the defaults are those of a backtest.

    ``stake`` is of ``cash``, ``price``, ``stop`` and ``atr`` at the decision; exits are tried in order, each with a
    condition and a price over a position (``stop``, ``target``, ``hi``, ``lo``, ``age``) and a bar (``high``, ``low``, ``close``, ``atr``, ``lev``).
    """

    way: int = 1
    rate: float = 0.0
    minimum: float = 0.0
    stake: str = "cash * 0.01"
    exits: tuple[tuple[str, str, str], ...] = ()
    leverage: float = 1.0

    def all_exits(self) -> tuple[tuple[str, str, str], ...]:
        return self.exits or exits_of(self.way)


def exits_of(way: int, trail: float | None = None, bars: int | None = None, condition: bool = False) -> tuple[tuple[str, str, str], ...]:
    """Stop loss, trailing stop (percent of the close), take profit, exit signal and age, in this order, for a direction."""
    hit = lambda level, loss: f"low <= {level}" if (way > 0) == loss else f"high >= {level}"
    mark = f"(hi - close * {trail} / 100)" if way > 0 else f"(lo + close * {trail} / 100)"
    out = [("stop_loss", hit("stop", True), "stop")]
    out += [("trail", hit(mark, True), mark)] if trail else []
    out += [("take_profit", hit("target", False), "target")]
    out += [("condition", "lev", "close")] if condition else []
    out += [("age", f"age >= {bars}", "close")] if bars else []
    return tuple(out)


def account(signals: str, rules: Rules, name: str = "r") -> str:
    """A recursive table of the account after each bar, in either direction, with commission, any stake and any exits."""
    way, cost = rules.way, lambda value: f"greatest(({value}) * {rules.rate!r} / 100, {rules.minimum!r})"
    floor, target = f"coalesce(g.stp, g.close * (100 - {way} * g.sl) / 100)", f"g.close * (100 + {way} * g.tp) / 100"
    reasons = " ".join(f"WHEN {hit} THEN '{reason}'" for reason, hit, _ in rules.all_exits())
    prices = " ".join(f"WHEN '{reason}' THEN {price}" for reason, _, price in rules.all_exits())
    worth = "l.qty * g.close" if way > 0 else "l.qty * (2 * f.ep - g.close)"
    # f: waiting orders; s: what exit rules see; h: the rule that fires; l: after it; d: decisions
    return f"""{name} AS (
  SELECT run, symbol, 0::BIGINT AS p, 0::BIGINT AS ts, 10000.0::DOUBLE AS cash, NULL::DOUBLE AS qty, NULL::DOUBLE AS ep, NULL::BIGINT AS ets, NULL::BIGINT AS ep_at, NULL::DOUBLE AS paid, NULL::DOUBLE AS stop, NULL::DOUBLE AS target, NULL::DOUBLE AS hi, NULL::DOUBLE AS lo,
    0 AS ord, 0.0::DOUBLE AS stake, NULL::DOUBLE AS ostop, NULL::DOUBLE AS otarget, 10000.0::DOUBLE AS equity,
    NULL::DOUBLE AS t_qty, NULL::DOUBLE AS t_ep, NULL::BIGINT AS t_ets, NULL::BIGINT AS t_at, NULL::DOUBLE AS t_paid, NULL::DOUBLE AS t_xp, NULL::DOUBLE AS t_lo, NULL::DOUBLE AS t_hi, NULL::VARCHAR AS why
  FROM {signals} WHERE p = 1
  UNION ALL
  SELECT r.run, r.symbol, g.p, g.ts, l.cash, l.qty, f.ep, f.ets, f.ep_at, f.paid, f.stop, f.target, greatest(f.hi, g.high), least(f.lo, g.low),
    CASE WHEN g.ent AND l.qty IS NULL AND g.close > 0 THEN 1 WHEN g.lev AND NOT (g.ent AND l.qty IS NULL AND g.close > 0) AND l.qty IS NOT NULL THEN 2 ELSE 0 END,
    d.stake, {floor}, {target}, l.cash + coalesce({worth}, 0), l.t_qty, l.t_ep, l.t_ets, l.t_at, l.t_paid, l.t_xp, l.t_lo, l.t_hi, l.why
  FROM {name} r JOIN {signals} g ON g.run = r.run AND g.symbol = r.symbol AND g.p = r.p + 1,
  LATERAL (SELECT CASE WHEN r.ord = 2 AND g.open > 0 AND r.qty IS NOT NULL THEN 'counter_signal' END AS gone, {cost('r.stake')} AS fee, {cost('r.qty * g.open')} AS out_fee,
    r.ord = 1 AND r.qty IS NULL AND g.open > 0 AND r.stake > 0 AND ({'false' if way > 0 else 'true'} OR (r.cash >= r.stake + {cost('r.stake')} AND r.cash * {rules.leverage!r} >= r.stake)) AS opens) o,
  LATERAL (SELECT CASE WHEN o.gone IS NOT NULL THEN NULL WHEN o.opens THEN r.stake / g.open ELSE r.qty END AS qty, CASE WHEN o.opens THEN g.open ELSE r.ep END AS ep, CASE WHEN o.opens THEN g.ts ELSE r.ets END AS ets, CASE WHEN o.opens THEN g.p ELSE r.ep_at END AS ep_at,
    CASE WHEN o.opens THEN o.fee ELSE r.paid END AS paid, CASE WHEN o.opens THEN r.ostop ELSE r.stop END AS stop, CASE WHEN o.opens THEN r.otarget ELSE r.target END AS target, CASE WHEN o.opens THEN g.open ELSE r.hi END AS hi, CASE WHEN o.opens THEN g.open ELSE r.lo END AS lo,
    CASE WHEN o.gone IS NOT NULL THEN r.cash + r.qty * r.ep + {way} * (g.open - r.ep) * r.qty - o.out_fee WHEN o.opens THEN r.cash - r.stake - o.fee ELSE r.cash END AS cash) f,
  LATERAL (SELECT f.stop AS stop, f.target AS target, f.hi AS hi, f.lo AS lo, g.p - f.ep_at AS age, g.high AS high, g.low AS low, g.close AS close, g.lev AS lev) s,
  LATERAL (SELECT CASE WHEN f.qty IS NULL THEN NULL ELSE (SELECT CASE {reasons} END FROM (SELECT s.stop, s.target, s.hi, s.lo, s.age, s.high, s.low, s.close, s.lev)) END AS what) h,
  LATERAL (SELECT (SELECT CASE h.what {prices} END FROM (SELECT s.stop, s.target, s.hi, s.lo, s.age, s.high, s.low, s.close, s.lev)) AS xp) x,
  LATERAL (SELECT CASE WHEN h.what IS NULL THEN f.qty END AS qty, CASE WHEN h.what IS NULL THEN f.cash ELSE f.cash + f.qty * f.ep + {way} * (x.xp - f.ep) * f.qty - {cost('f.qty * x.xp')} END AS cash,
    CASE WHEN o.gone IS NOT NULL THEN r.qty WHEN h.what IS NOT NULL THEN f.qty END AS t_qty, CASE WHEN o.gone IS NOT NULL THEN r.ep ELSE f.ep END AS t_ep, CASE WHEN o.gone IS NOT NULL THEN r.ets ELSE f.ets END AS t_ets, CASE WHEN o.gone IS NOT NULL THEN r.ep_at ELSE f.ep_at END AS t_at,
    CASE WHEN o.gone IS NOT NULL THEN r.paid ELSE f.paid END AS t_paid, CASE WHEN o.gone IS NOT NULL THEN g.open ELSE x.xp END AS t_xp, CASE WHEN o.gone IS NOT NULL THEN r.lo ELSE f.lo END AS t_lo, CASE WHEN o.gone IS NOT NULL THEN r.hi ELSE f.hi END AS t_hi, coalesce(o.gone, h.what) AS why) l,
  LATERAL (SELECT stake FROM (SELECT {rules.stake} AS stake FROM (SELECT l.cash AS cash, g.close AS price, {floor} AS stop, g.atr AS atr))) d)"""


def account_trades(signals: str, rules: Rules, name: str = "r", into: str = "t") -> str:
    """Trades that :func:`account` closed, with those that the end closes."""
    way, cost = rules.way, lambda value: f"greatest(({value}) * {rules.rate!r} / 100, {rules.minimum!r})"
    worst, best = ("lo", "hi") if way > 0 else ("hi", "lo")
    return f"""{into}_last AS (SELECT run, symbol, max(p) AS p FROM {signals} GROUP BY 1, 2), {into}_all AS (
    SELECT run, symbol, t_qty AS qty, t_ep AS entry_price, t_ets AS entry_ts, t_at AS a, t_paid AS paid, t_xp AS exit_price, ts AS exit_ts, p AS z, t_lo AS lo, t_hi AS hi, why AS exit_reason FROM {name} WHERE why IS NOT NULL
    UNION ALL SELECT r.run, r.symbol, r.qty, r.ep, r.ets, r.ep_at, r.paid, g.close, r.ts, r.p, r.lo, r.hi, 'end_of_backtest' FROM {name} r JOIN {into}_last m ON m.run = r.run AND m.symbol = r.symbol AND m.p = r.p JOIN {signals} g ON g.run = r.run AND g.symbol = r.symbol AND g.p = r.p WHERE r.qty IS NOT NULL),
  {into} AS (SELECT *, paid + {cost('qty * exit_price')} AS commission, {way} * (exit_price - entry_price) * qty - paid - {cost('qty * exit_price')} AS pnl, {way} * ({worst} - entry_price) / entry_price AS mae, {way} * ({best} - entry_price) / entry_price AS mfe, z - a AS bars_held FROM {into}_all)"""
