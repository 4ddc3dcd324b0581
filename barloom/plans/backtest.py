"""Backtests: bars and runs in, trades and equity out.

A run is a strategy with parameters. Runs are dealt to a few buckets; bars are paired with
buckets, and each (bucket, symbol) is one grouped map that works through its runs: signals
by kernels, then the account bar by bar. So bars are shuffled once for each bucket, not for
each run. Searches ask for figures, one row per run and symbol, which the same map computes;
:func:`statistics` has the same figures from events, as native aggregations.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import atr as atr_kernel
from ..operators import statistics as S
from ..operators.orders import DEFAULT_RULES, NAN, Account, Bar, Commission, Order, Sizing, some
from .strategies import REGISTRY, Strategy

KEYS = ("run_id", "symbol")
EVENTS = (
    "run_id string, symbol string, kind string, ts long, equity double, direction string, qty double, entry_price double, entry_ts long, "
    "exit_price double, exit_ts long, pnl double, commission double, bars_held long, mae double, mfe double, exit_reason string"
)
TRADE = ["direction", "qty", "entry_price", "entry_ts", "exit_price", "exit_ts", "pnl", "commission", "bars_held", "mae", "mfe", "exit_reason"]


@dataclass(frozen=True)
class Settings:
    capital: float = 10_000.0
    sizing: Sizing = Sizing()
    commission: Commission = Commission()
    rules: tuple = DEFAULT_RULES
    direction: str = "long"
    atr_period: int = 14


@dataclass(frozen=True)
class Run:
    strategy: str
    params: dict = field(default_factory=dict)

    @property
    def run_id(self) -> str:
        return f"{self.strategy}:{json.dumps(REGISTRY[self.strategy].resolve(self.params), sort_keys=True)}"


def _arrays(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: frame[c].to_numpy(dtype=float) for c in ("open", "high", "low", "close", "volume")}


def _decide(account: Account, bar: Bar, entry: bool, leave: bool, stop: float, params: dict, settings: Settings) -> None:
    """Entry only while flat, exit only while in a position; both at the next bar."""
    way = 1 if settings.direction == "long" else -1
    if entry and account.position is None and not account.waiting and bar.close > 0:
        price = bar.close
        loss, gain = params.get("stopLossPercent"), params.get("takeProfitPercent")
        floor = stop if some(stop) else price * (100 - way * loss) / 100 if loss else NAN
        target = price * (100 + way * gain) / 100 if gain else NAN
        stake = settings.sizing.stake(account.equity(price), price, floor, bar.atr)
        account.waiting.append(Order(settings.direction, stake, stop=floor, target=target))
    elif leave and account.position is not None:
        account.waiting.append(Order("short" if way == 1 else "long", 0.0, closes=True))


def _rows(run: str, symbol: str, account: Account, curve: list[tuple[int, float]]) -> pd.DataFrame:
    trades = pd.DataFrame(account.trades, columns=TRADE).assign(kind="trade")
    equity = pd.DataFrame(curve, columns=["ts", "equity"]).assign(kind="equity")
    out = pd.concat([trades.assign(ts=trades["exit_ts"]), equity]).assign(run_id=run, symbol=symbol)
    names = [c.split()[0] for c in EVENTS.split(", ")]
    out = out.reindex(columns=names)
    kinds = dict(x.split() for x in EVENTS.split(", "))
    return out.astype({n: {"long": "Int64", "double": "float64"}.get(k, "object") for n, k in kinds.items()})


def _signals(strategy: Strategy, frame: pd.DataFrame, params: dict) -> dict[str, np.ndarray]:
    with np.errstate(invalid="ignore", divide="ignore"):
        found = strategy.signals(_arrays(frame), params)
    return {"stop": np.full(len(frame), NAN)} | found


def _played(frame: pd.DataFrame, strategy: Strategy, params: dict, settings: Settings) -> tuple[Account, list[tuple[int, float]]]:
    """The account and its curve after an ordered series."""
    found, ranges = _signals(strategy, frame, params), atr_kernel(_arrays(frame), settings.atr_period)["atr"]
    account, curve, bar = Account(settings.capital, settings.commission, settings.rules, settings.sizing.max_leverage), [], None
    for i, row in enumerate(zip(frame["ts"], frame["open"], frame["high"], frame["low"], frame["close"], strict=True)):
        bar = Bar(*row, index=i, exit=bool(found["exit"][i]), atr=ranges[i])
        account.fill(bar)
        account.leave(bar)
        account.mark(bar)
        _decide(account, bar, bool(found["entry"][i]), bool(found["exit"][i]), found["stop"][i], params, settings)
        curve.append((bar.ts, account.equity(bar.close)))
    if account.position is not None:
        account.close(bar.close, bar, "end_of_backtest")
        curve[-1] = (bar.ts, account.cash)
    return account, curve


def _ordered(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values("ts", kind="stable").reset_index(drop=True)


#: Runs that share a task, where there are many.
RUNS_TOGETHER = 4


def _bucketed(bars: DataFrame, runs: list[Run]) -> tuple[DataFrame, list[list[tuple[str, Strategy, dict]]]]:
    """Bars once for each bucket of runs (column ``bucket``), and the runs of each bucket."""
    known = {r.run_id: (r.run_id, REGISTRY[r.strategy], REGISTRY[r.strategy].resolve(r.params)) for r in runs}
    n = max(1, min(-(-len(known) // RUNS_TOGETHER), bars.sparkSession.sparkContext.defaultParallelism))
    buckets = [list(known.values())[i::n] for i in range(n)]
    dealt = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return bars.select(dealt.alias("bucket"), "symbol", "ts", "open", "high", "low", "close", "volume"), buckets


def backtest(bars: DataFrame, runs: list[Run], settings: Settings = Settings()) -> DataFrame:
    """Trades and equity points (column ``kind``) of every run over every symbol.

    Market orders fill at the next open. Within a bar: waiting orders, exits, water
    marks, decisions. A position left at the end is closed at the last close. Series
    with fewer bars than a strategy needs give no trades.
    """
    dealt, buckets = _bucketed(bars, runs)

    def simulate(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _ordered(frame)
        symbol = frame["symbol"].iat[0]
        return pd.concat([_rows(run, symbol, *_played(frame, strategy, params, settings)) for run, strategy, params in buckets[frame["bucket"].iat[0]]])

    return dealt.groupBy("bucket", "symbol").applyInPandas(simulate, EVENTS)


def _ratios(r: np.ndarray, base: float, scale: float) -> tuple[float, float, float]:
    """Sharpe and Sortino ratio and volatility of returns of an equity curve; 0 for fewer than ten."""
    if len(r) < 10:
        return 0.0, 0.0, 0.0
    sd, excess = r.std(ddof=1), r.mean() - base
    down = np.sqrt((np.minimum(r - base, 0) ** 2).mean())
    return excess / sd * scale if sd > 1e-12 else 0.0, excess / down * scale if sd > 1e-12 and down > 1e-12 else 0.0, sd * scale


def _curve_figures(equity: np.ndarray, per_year: int) -> dict[str, float]:
    before, after = equity[:-1], equity[1:]
    good = before != 0
    r, moved = after[good] / before[good] - 1, (after != before)[good]
    base, scale = S.RISK_FREE / per_year, per_year**0.5
    sharpe, sortino, volatility = _ratios(r, base, scale)
    active, active_sortino, _ = _ratios(r[moved], base, scale)
    peak = np.maximum.accumulate(equity)
    fall = peak - equity
    share = np.divide(fall, peak, out=np.zeros(len(fall)), where=peak != 0)
    ups = np.cumsum(fall <= 0)
    under = np.bincount(ups, weights=fall > 0)
    busy = moved.mean() * 100
    return {
        "sharpe_ratio": sharpe, "sortino_ratio": sortino, "active_sharpe_ratio": active, "active_sortino_ratio": active_sortino, "volatility": volatility,
        "time_in_market_percent": busy, "idle_capital_percent": 100 - busy, "max_drawdown": fall.max(), "max_drawdown_percent": share.max(),
        "max_drawdown_duration": under.max(), "avg_drawdown": fall[fall > 0].mean() if (fall > 0).any() else 0.0,
    }


def _streak(signs: np.ndarray, wanted: float) -> int:
    best = now = 0
    for s in signs:
        now = now + 1 if s == wanted else 0
        best = max(best, now)
    return best


def _trade_figures(trades: pd.DataFrame, capital: float) -> dict[str, float]:
    p = trades["pnl"].to_numpy(float)
    order = np.lexsort((np.arange(len(p)), trades["entry_ts"]))
    took = (trades["exit_ts"] - trades["entry_ts"]).to_numpy(float)
    wins, losses, total = p[p > 0], p[p < 0], p.sum()
    span, final = (trades["exit_ts"].max() - trades["entry_ts"].min()) / S.DAY, capital + total
    sides = {side: p[(trades["direction"] == side).to_numpy()] for side in ("long", "short")}
    lost = losses.sum()
    return {
        "total_trades": len(p), "total_return": total, "total_return_percent": total / capital * 100,
        "cagr": (final / capital) ** (365 / span) - 1 if span > 0 and final > 0 and capital > 0 and total != 0 else 0.0,
        "winning_trades": len(wins), "losing_trades": len(losses), "win_rate": len(wins) / len(p), "gross_profit": wins.sum(), "gross_loss": lost,
        "profit_factor": wins.sum() / abs(lost) if lost != 0 else np.inf if len(wins) else 0.0,
        "largest_win": wins.max(initial=0.0), "largest_loss": losses.min(initial=0.0), "average_win": wins.mean() if len(wins) else 0.0,
        "average_loss": losses.mean() if len(losses) else 0.0, "expectancy": p.mean(), "long_trades": len(sides["long"]), "short_trades": len(sides["short"]),
        **{f"{side}_win_rate": (x > 0).mean() if len(x) else 0.0 for side, x in sides.items()},
        "avg_trade_duration": took.mean(), "median_trade_duration": np.median(took), "min_trade_duration": int(took.min()), "max_trade_duration": int(took.max()),
        "trading_days": span, "max_consecutive_wins": _streak(np.sign(p[order]), 1), "max_consecutive_losses": _streak(np.sign(p[order]), -1),
    }


_WHOLE = (
    "max_drawdown_duration", "total_trades", "winning_trades", "losing_trades", "long_trades", "short_trades",
    "min_trade_duration", "max_trade_duration", "max_consecutive_wins", "max_consecutive_losses",
)
_CURVE = (
    "sharpe_ratio", "sortino_ratio", "active_sharpe_ratio", "active_sortino_ratio", "volatility", "time_in_market_percent",
    "idle_capital_percent", "max_drawdown", "max_drawdown_percent", "max_drawdown_duration", "avg_drawdown",
)
_TRADES = (
    "total_trades", "total_return", "total_return_percent", "cagr", "winning_trades", "losing_trades", "win_rate", "gross_profit", "gross_loss",
    "profit_factor", "largest_win", "largest_loss", "average_win", "average_loss", "expectancy", "long_trades", "short_trades", "long_win_rate",
    "short_win_rate", "avg_trade_duration", "median_trade_duration", "min_trade_duration", "max_trade_duration", "trading_days",
    "max_consecutive_wins", "max_consecutive_losses",
)


def evaluate(bars: DataFrame, runs: list[Run], settings: Settings = Settings(), seconds: int = 3600) -> DataFrame:
    """The figures of :func:`statistics` for every run and symbol, in one grouped map without events.

    Runs without trades have zero trades and nulls for what trades would tell; series of
    fewer than two bars give no row.
    """
    dealt, buckets = _bucketed(bars, runs)
    per_year = S.bars_per_year(seconds)
    names = [*KEYS, *_CURVE, *_TRADES]

    def figures(frame: pd.DataFrame) -> pd.DataFrame:
        frame, rows = _ordered(frame), []
        for run, strategy, params in buckets[frame["bucket"].iat[0]] if len(frame) > 1 else ():
            account, curve = _played(frame, strategy, params, settings)
            row = {"run_id": run, "symbol": frame["symbol"].iat[0], **_curve_figures(np.array([e for _, e in curve]), per_year), "total_trades": 0}
            if account.trades:
                row |= _trade_figures(pd.DataFrame(account.trades, columns=TRADE), settings.capital)
            rows.append(row)
        out = pd.DataFrame(rows).reindex(columns=names)
        return out.astype({n: "Int64" for n in _WHOLE})

    kinds = ", ".join(f"{n} {'long' if n in _WHOLE else 'double'}" for n in (*_CURVE, *_TRADES))
    return dealt.groupBy("bucket", "symbol").applyInPandas(figures, f"run_id string, symbol string, {kinds}")


def backtest_dual(bars: DataFrame, fine: DataFrame, seconds: int, runs: list[Run], settings: Settings = Settings()) -> DataFrame:
    """Signals from ``bars`` of ``seconds``, execution on the ``fine`` bars within each.

    The fine bars of a signal bar come before its own decision; those after the last
    signal bar still fill and exit. Both sides are cogrouped by bucket of runs and symbol.
    """
    left, buckets = _bucketed(bars, runs)
    right, _ = _bucketed(fine, runs)

    def play(signal: pd.DataFrame, exact: pd.DataFrame, strategy: Strategy, params: dict) -> tuple[Account, list]:
        found, ranges = _signals(strategy, signal, params), atr_kernel(_arrays(signal), settings.atr_period)["atr"]
        account, curve, bar, at = Account(settings.capital, settings.commission, settings.rules, settings.sizing.max_leverage), [], None, 0
        rows = list(zip(exact["ts"], exact["open"], exact["high"], exact["low"], exact["close"], strict=True))
        for i, start in enumerate(signal["ts"]):
            last = i == len(signal) - 1
            while at < len(rows) and (rows[at][0] < start + seconds or last):
                bar = Bar(*rows[at], index=i, exit=bool(found["exit"][i]), atr=ranges[i])
                account.fill(bar)
                account.leave(bar)
                account.mark(bar)
                curve.append((bar.ts, account.equity(bar.close)))
                at += 1
            own = Bar(start, *(signal[c].iat[i] for c in ("open", "high", "low", "close")), index=i, exit=bool(found["exit"][i]), atr=ranges[i])
            _decide(account, own, bool(found["entry"][i]), bool(found["exit"][i]), found["stop"][i], params, settings)
        if account.position is not None and bar is not None:
            account.close(bar.close, bar, "end_of_backtest")
            curve[-1] = (bar.ts, account.cash)
        return account, curve

    def simulate(signal: pd.DataFrame, exact: pd.DataFrame) -> pd.DataFrame:
        signal, exact = _ordered(signal), _ordered(exact)
        if signal.empty or exact.empty:
            return _rows("", "", Account(0.0), [])
        symbol = signal["symbol"].iat[0]
        return pd.concat([_rows(run, symbol, *play(signal, exact, strategy, params)) for run, strategy, params in buckets[signal["bucket"].iat[0]]])

    keys = ("bucket", "symbol")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(simulate, EVENTS)


def trades_of(events: DataFrame) -> DataFrame:
    return events.where("kind = 'trade'").select(*KEYS, *TRADE)


def equity_of(events: DataFrame) -> DataFrame:
    return events.where("kind = 'equity'").select(*KEYS, "ts", "equity")


def statistics(events: DataFrame, capital: float = 10_000.0, seconds: int = 3600) -> DataFrame:
    """One row of figures per run and symbol; runs without trades have zero trades."""
    keys = KEYS
    trades, curve = trades_of(events), equity_of(events)
    base = S.curve_ratios(curve, keys, "ts", S.bars_per_year(seconds)).join(S.drawdown_summary(curve, keys, "ts"), list(keys))
    own = S.trade_statistics(trades, keys, capital).join(S.streaks(trades, keys, ["entry_ts"]), list(keys))
    return base.join(own, list(keys), "left").fillna(0, ["total_trades"])
