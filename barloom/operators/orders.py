"""Orders, position sizes, exit rules and the account of one run."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

NAN = float("nan")


def some(x: float | None) -> bool:
    return x is not None and not math.isnan(x)


@dataclass(frozen=True)
class Commission:
    """Percent of the value, a rate per unit, or a flat rate; never under the minimum. ``kind`` may be a function of value and quantity."""

    kind: str | Callable[[float, float], float] = "percentage"  # per_unit, fixed
    rate: float = 0.0
    minimum: float = 0.0

    def of(self, value: float, qty: float = 0.0) -> float:
        if callable(self.kind):
            return max(self.kind(value, qty), self.minimum)
        own = {"percentage": value * self.rate / 100, "per_unit": qty * self.rate}.get(self.kind, self.rate)
        return max(own, self.minimum)


@dataclass(frozen=True)
class Sizing:
    """How much of the account an order takes; ``model`` may be a function of equity, price, stop and true range."""

    model: str | Callable[[float, float, float | None, float | None], float] = "percent_of_equity"  # fixed_dollar, risk_based, kelly, atr_volatility
    percent: float = 1.0
    fixed: float = 100.0
    max_leverage: float = 1.0
    win_rate: float = 0.5
    payoff: float = 1.0
    fraction: float = 0.5
    atr_multiplier: float = 2.0

    def stake(self, equity: float, price: float, stop: float | None, atr: float | None = None) -> float:
        if callable(self.model):
            return self.model(equity, price, stop, atr)
        if self.model == "fixed_dollar":
            return self.fixed
        if self.model == "risk_based":
            return risk_stake(equity, self.percent, price, stop, self.max_leverage)
        if self.model == "kelly":
            share = (self.win_rate - (1 - self.win_rate) / self.payoff) * self.fraction if self.payoff > 0 else 0.0
            return equity * min(max(share, 0.0), self.max_leverage)
        if self.model == "atr_volatility":
            return risk_stake(equity, self.percent, price, price - atr * self.atr_multiplier if some(atr) else None, self.max_leverage)
        return equity * self.percent / 100


def risk_stake(equity: float, percent: float, price: float, stop: float | None, max_leverage: float) -> float:
    """The stake that loses ``percent`` of equity at the stop; without a stop below the price, at 5 % under it."""
    distance = (price - stop) / price if some(stop) and price > stop else 0.05
    return min(equity * percent / 100 / distance, equity * max_leverage)


@dataclass(frozen=True)
class Bar:
    ts: int
    open: float
    high: float
    low: float
    close: float
    index: int
    exit: bool = False
    atr: float = NAN


@dataclass
class Position:
    direction: str
    qty: float
    price: float
    ts: int
    index: int
    commission: float
    stop: float
    target: float
    high: float
    low: float


ExitRule = Callable[[Position, Bar], float | None]


def static_stop(p: Position, bar: Bar) -> float | None:
    touched = some(p.stop) and (bar.low <= p.stop if p.direction == "long" else bar.high >= p.stop)
    return p.stop if touched else None


def static_target(p: Position, bar: Bar) -> float | None:
    touched = some(p.target) and (bar.high >= p.target if p.direction == "long" else bar.low <= p.target)
    return p.target if touched else None


@dataclass(frozen=True)
class TrailingStop:
    """A distance from the extreme of the bars before; percent of the close, or true ranges (2 % of the close while unknown)."""

    percent: float | None = None
    atr_multiplier: float | None = None

    def __call__(self, p: Position, bar: Bar) -> float | None:
        if self.percent is not None:
            distance = bar.close * self.percent / 100
        else:
            distance = bar.atr * self.atr_multiplier if some(bar.atr) else bar.close * 0.02
        if p.direction == "long":
            level = p.high - distance
            return level if bar.low <= level else None
        level = p.low + distance
        return level if bar.high >= level else None


def condition_exit(p: Position, bar: Bar) -> float | None:
    return bar.close if bar.exit else None


@dataclass(frozen=True)
class MaxBars:
    bars: int

    def __call__(self, p: Position, bar: Bar) -> float | None:
        return bar.close if bar.index - p.index >= self.bars else None


DEFAULT_RULES: tuple[tuple[str, ExitRule], ...] = (("stop_loss", static_stop), ("take_profit", static_target))


@dataclass
class Order:
    direction: str
    stake: float
    kind: str = "market"  # limit, stop, stop_limit
    limit: float = NAN
    trigger: float = NAN
    stop: float = NAN
    target: float = NAN
    tag: str = "counter_signal"
    closes: bool = False

    def fill_price(self, bar: Bar) -> float | None:
        """Market orders fill at the open, others at their level once the bar reaches it."""
        long = self.direction == "long"
        reaches = (lambda x: bar.low <= x) if long else (lambda x: bar.high >= x)
        breaks = (lambda x: bar.high >= x) if long else (lambda x: bar.low <= x)
        if self.kind == "market":
            return bar.open
        if self.kind == "limit":
            return self.limit if reaches(self.limit) else None
        if self.kind == "stop":
            return self.trigger if breaks(self.trigger) else None
        return self.limit if breaks(self.trigger) and reaches(self.limit) else None


@dataclass
class Account:
    """Cash, one position, waiting orders, and what came of them."""

    cash: float
    commission: Commission = Commission()
    rules: tuple[tuple[str, ExitRule], ...] = DEFAULT_RULES
    max_leverage: float = 1.0
    position: Position | None = None
    waiting: list[Order] = field(default_factory=list)
    trades: list[tuple] = field(default_factory=list)

    def equity(self, price: float) -> float:
        p = self.position
        if p is None:
            return self.cash
        return self.cash + p.qty * (price if p.direction == "long" else 2 * p.price - price)

    def fill(self, bar: Bar) -> None:
        still = []
        for order in self.waiting:
            price = order.fill_price(bar)
            if price is None or price <= 0:
                if price is None:
                    still.append(order)
                continue
            if order.closes or self.position is not None:
                if self.position is not None and order.direction != self.position.direction:
                    self.close(price, bar, order.tag)
                continue
            cost = self.commission.of(order.stake, order.stake / price)
            fits = self.cash >= order.stake + cost and self.equity(price) * self.max_leverage >= order.stake
            if order.stake > 0 and (fits or order.direction == "short"):
                self.cash -= order.stake + cost
                self.position = Position(order.direction, order.stake / price, price, bar.ts, bar.index, cost, order.stop, order.target, price, price)
        self.waiting = still

    def close(self, price: float, bar: Bar, reason: str) -> None:
        p = self.position
        cost = self.commission.of(p.qty * price, p.qty)
        gross = (price - p.price) * p.qty * (1 if p.direction == "long" else -1)
        self.cash += p.qty * p.price + gross - cost
        worst, best = (p.low, p.high) if p.direction == "long" else (p.high, p.low)
        sign = 1 if p.direction == "long" else -1
        mae, mfe = sign * (worst - p.price) / p.price, sign * (best - p.price) / p.price
        self.trades.append((p.direction, p.qty, p.price, p.ts, price, bar.ts, gross - cost - p.commission, cost + p.commission, bar.index - p.index, mae, mfe, reason))
        self.position = None

    def leave(self, bar: Bar) -> None:
        """The first exit rule that fires closes the position."""
        for reason, rule in self.rules:
            if self.position is None:
                return
            price = rule(self.position, bar)
            if price is not None:
                self.close(price, bar, reason)
                return

    def mark(self, bar: Bar) -> None:
        if self.position is not None:
            self.position.high, self.position.low = max(self.position.high, bar.high), min(self.position.low, bar.low)
