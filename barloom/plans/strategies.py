"""Trading strategies: entry and exit conditions over the bars of one series.

A strategy is a function of arrays and parameters that gives boolean entries and exits
(and optionally a stop price at entry). Its parameters carry a default and a search
range. Users add their own with :func:`strategy`.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from ..functions import kernels as K
from ..functions.indicators import Spec

Arrays = dict[str, np.ndarray]


@dataclass(frozen=True)
class Parameter:
    default: float
    low: float
    high: float
    step: float

    @property
    def whole(self) -> bool:
        return all(float(x).is_integer() for x in (self.default, self.low, self.step))

    def coerce(self, value) -> float | int:
        return int(value) if self.whole else float(value)


@dataclass(frozen=True)
class Strategy:
    alias: str
    signals: Callable[..., Arrays]
    parameters: dict[str, Parameter] = field(default_factory=dict)
    min_bars: int = 2

    def resolve(self, given: dict | None) -> dict:
        unknown = set(given or {}) - set(self.parameters)
        if unknown:
            raise KeyError(f"{self.alias} has no parameters {sorted(unknown)}")
        return {n: p.coerce((given or {}).get(n, p.default)) for n, p in self.parameters.items()}


REGISTRY: dict[str, Strategy] = {}


def strategy(alias: str, min_bars: int = 2, **parameters: tuple[float, float, float, float]):
    """Register a strategy; a later one of the same alias replaces the earlier."""

    def wrap(f: Callable[..., Arrays]) -> Callable[..., Arrays]:
        REGISTRY[alias] = Strategy(alias, f, {n: Parameter(*p) for n, p in parameters.items()}, min_bars)
        return f

    return wrap


def parse_inputs(text: str | None) -> dict | None:
    """Inputs from a JSON object; empty if there is none, None if it is invalid."""
    if text is None:
        return {}
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _lag(x: np.ndarray, n: int = 1) -> np.ndarray:
    return np.concatenate([np.full(n, np.nan), x[:-n]]) if len(x) > n else np.full(len(x), np.nan)


def crosses_above(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_lag(a) <= _lag(b)) & (a > b)


def crosses_below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (_lag(a) >= _lag(b)) & (a < b)


def _crossover(fast: np.ndarray, slow: np.ndarray) -> Arrays:
    return {"entry": crosses_above(fast, slow), "exit": crosses_below(fast, slow)}


# Default, least, greatest and step of each parameter.
@strategy("sma_crossover", fastPeriod=(10, 5, 50, 5), slowPeriod=(50, 20, 200, 10), stopLossPercent=(5.0, 0.5, 20.0, 0.5), takeProfitPercent=(10.0, 1.0, 50.0, 2.0))
def sma_crossover(b: Arrays, p: dict) -> Arrays:
    return _crossover(K.sma_of(b["close"], p["fastPeriod"]), K.sma_of(b["close"], p["slowPeriod"]))


@strategy("ema_crossover", fastPeriod=(10, 3, 30, 2), slowPeriod=(30, 15, 100, 5), stopLossPercent=(3.0, 0.5, 20.0, 0.5), takeProfitPercent=(6.0, 1.0, 50.0, 2.0))
def ema_crossover(b: Arrays, p: dict) -> Arrays:
    return _crossover(K.ema_of(b["close"], p["fastPeriod"]), K.ema_of(b["close"], p["slowPeriod"]))


@strategy("macd_crossover", fastPeriod=(12, 5, 20, 1), slowPeriod=(26, 15, 40, 1), signalPeriod=(9, 5, 15, 1), stopLossPercent=(3.0, 0.5, 20.0, 0.5), takeProfitPercent=(6.0, 1.0, 50.0, 2.0))
def macd_crossover(b: Arrays, p: dict) -> Arrays:
    m = K.macd(b, p["fastPeriod"], p["slowPeriod"], p["signalPeriod"])
    return _crossover(m["macd"], m["signal"])


@strategy("rsi_reversal", rsiPeriod=(14, 5, 30, 1), oversoldThreshold=(30.0, 10, 40, 5), overboughtThreshold=(70.0, 60, 90, 5), stopLossPercent=(3.0, 0.5, 20.0, 0.5), takeProfitPercent=(6.0, 1.0, 50.0, 2.0))
def rsi_reversal(b: Arrays, p: dict) -> Arrays:
    r = K.rsi(b, p["rsiPeriod"])["rsi"]
    return {"entry": (r < p["oversoldThreshold"]) & (r > _lag(r)), "exit": (r > p["overboughtThreshold"]) & (r < _lag(r))}


def _stochastic(b: Arrays, fast_k: int, slow_k: int, slow_d: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(b["close"])
    k = np.full(n, np.nan)
    for i in range(fast_k - 1, n):
        top, bottom = b["high"][i - fast_k + 1 : i + 1].max(), b["low"][i - fast_k + 1 : i + 1].min()
        k[i] = (b["close"][i] - bottom) / (top - bottom) * 100 if top > bottom else 0.0
    slow = K.mean_by_type(k, slow_k)
    return slow, K.mean_by_type(slow, slow_d)


@strategy("stoch_reversal", fastKPeriod=(14, 5, 30, 1), slowKPeriod=(3, 1, 10, 1), slowDPeriod=(3, 1, 10, 1), stopLossPercent=(3.0, 0.5, 20.0, 0.5), takeProfitPercent=(6.0, 1.0, 50.0, 2.0))
def stoch_reversal(b: Arrays, p: dict) -> Arrays:
    k, d = _stochastic(b, p["fastKPeriod"], p["slowKPeriod"], p["slowDPeriod"])
    return _crossover(k, d)


@strategy("bb_reversal", period=(20, 10, 50, 5), stdDev=(2.0, 1.0, 4.0, 0.5), stopLossPercent=(2.0, 0.5, 20.0, 0.5), takeProfitPercent=(4.0, 1.0, 50.0, 2.0))
def bb_reversal(b: Arrays, p: dict) -> Arrays:
    middle = K.sma_of(b["close"], p["period"])
    square = K.sma_of(b["close"] ** 2, p["period"])
    lower = middle - p["stdDev"] * np.sqrt(np.maximum(square - middle**2, 0))
    return {"entry": crosses_below(b["close"], lower), "exit": crosses_above(b["close"], middle)}


@strategy("adx_trend_pullback", adxPeriod=(14, 10, 30, 2), adxThreshold=(25.0, 15, 40, 5), rsiPeriod=(14, 5, 30, 1), rsiPullbackLevel=(40.0, 20, 50, 5), rsiOverboughtLevel=(70.0, 60, 85, 5), stopLossPercent=(4.0, 0.5, 20.0, 0.5), takeProfitPercent=(8.0, 1.0, 50.0, 2.0))
def adx_trend_pullback(b: Arrays, p: dict) -> Arrays:
    a, r = K.adx(b, p["adxPeriod"])["adx"], K.rsi(b, p["rsiPeriod"])["rsi"]
    return {"entry": (a > p["adxThreshold"]) & (r < p["rsiPullbackLevel"]) & (r > _lag(r)), "exit": (a < p["adxThreshold"]) | (r > p["rsiOverboughtLevel"])}


@strategy("breakout", lookback=(20, 10, 60, 5), atrPeriod=(14, 5, 30, 1), atrMultiplier=(2.0, 1.0, 5.0, 0.5), stopLossPercent=(4.0, 0.5, 20.0, 0.5), takeProfitPercent=(12.0, 1.0, 50.0, 2.0))
def breakout(b: Arrays, p: dict) -> Arrays:
    """Close through the running extreme, this bar's own included; the stop lies some true ranges under the close."""
    n, m = p["lookback"], max(5, p["lookback"] // 2)
    top = np.array([b["high"][max(0, i - n + 1) : i + 1].max() if i >= n - 1 else np.nan for i in range(len(b["close"]))])
    bottom = np.array([b["low"][max(0, i - m + 1) : i + 1].min() if i >= m - 1 else np.nan for i in range(len(b["close"]))])
    return {"entry": crosses_above(b["close"], top), "exit": crosses_below(b["close"], bottom), "stop": b["close"] - K.atr(b, p["atrPeriod"])["atr"] * p["atrMultiplier"]}


@dataclass(frozen=True)
class Columnar:
    """A strategy over indicators that are columns: which, and signals from their values and those of the bar before."""

    specs: Callable[[dict], dict[str, Spec]]
    signals: Callable[[Arrays, dict], Arrays]


def _mean_pair(kind: str) -> Columnar:
    return Columnar(lambda p: {"f": Spec(kind, {"period": p["fastPeriod"]}), "s": Spec(kind, {"period": p["slowPeriod"]})}, lambda v, _: _crossover(v["f"], v["s"]))


#: Strategies that can run block by block, by alias; they give the signals of the functions above.
COLUMNAR: dict[str, Columnar] = {
    "sma_crossover": _mean_pair("sma"),
    "ema_crossover": _mean_pair("ema"),
    "macd_crossover": Columnar(lambda p: {"m": Spec("macd", {"fast": p["fastPeriod"], "slow": p["slowPeriod"], "signal": p["signalPeriod"]})}, lambda v, _: _crossover(v["m_macd"], v["m_signal"])),
    "stoch_reversal": Columnar(lambda p: {"k": Spec("stoch", {"fast_k": p["fastKPeriod"], "slow_k": p["slowKPeriod"], "slow_d": p["slowDPeriod"]})}, lambda v, _: _crossover(v["k_slowk"], v["k_slowd"])),
    "rsi_reversal": Columnar(
        lambda p: {"r": Spec("rsi", {"period": p["rsiPeriod"]})},
        lambda v, p: {"entry": (v["r"] < p["oversoldThreshold"]) & (v["r"] > _lag(v["r"])), "exit": (v["r"] > p["overboughtThreshold"]) & (v["r"] < _lag(v["r"]))},
    ),
    "bb_reversal": Columnar(
        lambda p: {"b": Spec("bbands", {"period": p["period"], "up": p["stdDev"], "down": p["stdDev"]})},
        lambda v, _: {"entry": crosses_below(v["close"], v["b_lower"]), "exit": crosses_above(v["close"], v["b_middle"])},
    ),
    "adx_trend_pullback": Columnar(
        lambda p: {"a": Spec("adx", {"period": p["adxPeriod"]}), "r": Spec("rsi", {"period": p["rsiPeriod"]})},
        lambda v, p: {"entry": (v["a"] > p["adxThreshold"]) & (v["r"] < p["rsiPullbackLevel"]) & (v["r"] > _lag(v["r"])), "exit": (v["a"] < p["adxThreshold"]) | (v["r"] > p["rsiOverboughtLevel"])},
    ),
    "breakout": Columnar(
        lambda p: {"t": Spec("max", {"period": p["lookback"]}, source="high"), "l": Spec("min", {"period": max(5, p["lookback"] // 2)}, source="low"), "a": Spec("atr", {"period": p["atrPeriod"]})},
        lambda v, p: {"entry": crosses_above(v["close"], v["t"]), "exit": crosses_below(v["close"], v["l"]), "stop": v["close"] - v["a"] * p["atrMultiplier"]},
    ),
}
