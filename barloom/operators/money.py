"""Exact money: fixed-point arithmetic with stated rounding.

Amounts, quantities and fees have ``SCALE`` digits after the point, stop and target prices have
``PRICE_SCALE``. Every product and quotient is cut off after its last digit, towards zero;
sums and differences are exact. A stake that is not divided evenly leaves its rest in cash.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_DOWN, Context, Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .orders import Commission, Sizing

SCALE, PRICE_SCALE = 12, 6
_EXACT = Context(prec=60, rounding=ROUND_DOWN)
AMOUNT = f"decimal(38,{SCALE})"


def exact(x) -> Decimal:
    """The shortest decimal that reads as the number; strings and decimals as they are."""
    return x if isinstance(x, Decimal) else Decimal(x) if isinstance(x, str) else Decimal(repr(x))


def cut(x: Decimal, scale: int = SCALE) -> Decimal:
    return x.quantize(Decimal(1).scaleb(-scale), rounding=ROUND_DOWN, context=_EXACT)


def times(a: Decimal, b: Decimal, scale: int = SCALE) -> Decimal:
    return cut(_EXACT.multiply(a, b), scale)


def over(a: Decimal, b: Decimal, scale: int = SCALE) -> Decimal:
    return cut(_EXACT.divide(a, b), scale)


def stop_loss(price, percent: float) -> Decimal:
    return times(exact(price), over(100 - exact(percent), Decimal(100), PRICE_SCALE), PRICE_SCALE)


def take_profit(price, percent: float) -> Decimal:
    return times(exact(price), over(100 + exact(percent), Decimal(100), PRICE_SCALE), PRICE_SCALE)


def fee(value: Decimal, commission: Commission, qty: Decimal = Decimal(0)) -> Decimal:
    """A commission on a value and a quantity; rates in percent are divided by 100 before they are applied."""
    if callable(commission.kind):
        raise ValueError("no exact form of a function")
    rate = exact(commission.rate)
    own = times(value, over(rate, Decimal(100))) if commission.kind == "percentage" else times(qty, rate) if commission.kind == "per_unit" else rate
    return cut(max(own, exact(commission.minimum)))


def risk_stake(equity: Decimal, percent: float, price: Decimal, stop: Decimal | None, leverage: float = 1.0) -> Decimal:
    """The stake that loses a percent of equity at the stop (5 % under the price if none lies below it), within the leverage."""
    risk = over(times(equity, exact(percent)), Decimal(100))
    distance = price - stop if stop is not None and price > stop else times(price, Decimal("0.05"))
    share = over(distance, price)
    return min(over(risk, share) if share > 0 else risk, times(equity, exact(leverage)))


def settled(trades: list[dict], capital, sizing: Sizing, commission: Commission) -> Iterator[dict]:
    """Trades in order with exact quantity, fees, profit and the cash after each.

    Sizes are a percent of equity, a fixed stake, or by risk from ``stop``; a trade that is not affordable is left out.
    """
    cash = cut(exact(capital))
    for t in trades:
        price, leaves, way = exact(t["entry_price"]), exact(t["exit_price"]), 1 if t["direction"] == "long" else -1
        stop = None if t.get("stop") is None or t["stop"] != t["stop"] else exact(t["stop"])
        if sizing.model == "fixed_dollar":
            stake = cut(exact(sizing.fixed))
        elif sizing.model == "risk_based":
            stake = risk_stake(cash, sizing.percent, price, stop, sizing.max_leverage)
        elif sizing.model == "percent_of_equity":
            stake = over(times(cash, exact(sizing.percent)), Decimal(100))
        else:
            raise ValueError(f"no exact form of {sizing.model}")
        qty = over(stake, price)
        paid = fee(stake, commission, qty)
        if stake <= 0 or (way > 0 and cash < stake + paid):
            continue
        value, worth = times(qty, price), times(qty, leaves)
        leaving = fee(worth, commission, qty)
        gross = way * (worth - value)
        cash = cash - stake - paid + stake + gross - leaving
        yield t | {"qty": qty, "stake": stake, "commission": paid + leaving, "pnl": gross - paid - leaving, "cash": cash}


def exact_ledger(trades: DataFrame, keys: tuple[str, ...] = ("run_id", "symbol"), capital: float = 10_000.0, sizing: Sizing = Sizing(), commission: Commission = Commission()) -> DataFrame:
    """The trades of each run settled anew in exact amounts: ``keys, direction, entry_ts, entry_price, exit_ts,
    exit_price, exit_reason, qty, stake, commission, pnl, cash``.

    When a trade opens and at which prices comes from ``trades`` (as ``backtest`` gives them, or with ``stop``).
    A run's trades, which are few, are settled in order of their entry by one task.
    """
    taken = ["direction", "entry_ts", "entry_price", "exit_ts", "exit_price", "exit_reason"]
    made = ["qty", "stake", "commission", "pnl", "cash"]
    stop = F.col("stop") if "stop" in trades.columns else F.lit(None).cast("double").alias("stop")
    shaped = trades.select(*keys, *taken, stop)
    kinds = dict(trades.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in (*keys, *taken)] + [f"{c} {AMOUNT}" for c in made])

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values(["entry_ts", "exit_ts"], kind="stable").to_dict("records")
        return pd.DataFrame(list(settled(rows, capital, sizing, commission)), columns=[*keys, *taken, *made])

    return shaped.groupBy(*keys).applyInPandas(settle, schema)


def exact_mean(c: Column | str) -> Column:
    """The mean of exact amounts (sums below 10 ** 14), cut off after its last digit."""
    mean = F.sum(c).cast(f"decimal(26,{SCALE})") / F.count(c).cast("decimal(10,0)")
    return F.when(mean < 0, F.ceil(mean, F.lit(SCALE))).otherwise(F.floor(mean, F.lit(SCALE))).cast(AMOUNT)
