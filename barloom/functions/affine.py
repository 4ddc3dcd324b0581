"""Recursions over state vectors, in blocks of rows.

A state ``y`` (one or more smoothed values) goes on as ``y_t = A_t y_(t-1) + b_t``, with any
matrix per row. What a block does to a state is again such a map. It is found by running the
block from zero and from each unit vector at once; the maps of blocks are chained, and
each block is run from the state that enters it. Matrices may differ from row to row, as
those of the adaptive mean do. The first block begins as the kernel of the whole series does.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import kernels as K
from .blocks import ROWS, carried, with_halo

Arrays = dict[str, np.ndarray]
FIELDS = ("open", "high", "low", "close", "volume")


@dataclass(frozen=True)
class Recursion:
    """``first``: outputs and state after the first block; ``go``: outputs and state after a block
    with ``h`` rows before it, from states in columns; ``warm`` and ``halo``: rows that these need."""

    first: Callable[..., tuple[Arrays, list[float]]]
    go: Callable[..., tuple[Arrays, np.ndarray]]
    warm: Callable[..., int]
    halo: Callable[..., int] = lambda **_: 0


def _last(*series: np.ndarray) -> list[float]:
    return [float(x[-1]) if len(x) else np.nan for x in series]


def _smoothing(x: np.ndarray, state: np.ndarray, factors: list[np.ndarray | float], inputs: Callable[[int, float, np.ndarray], float]) -> np.ndarray:
    """Values after each row: level ``j`` moves by its factor towards ``inputs(j, x, values so far)``."""
    y, out = state.astype(float).copy(), np.empty((len(x), *state.shape))
    for t in range(len(x)):
        for j in range(len(y)):
            y[j] += (factors[j] if np.isscalar(factors[j]) else factors[j][t]) * (inputs(j, x[t], y) - y[j])
        out[t] = y
    return out


# chains of exponential means


def _chained(kernel: str, levels: int, combine: Callable[..., np.ndarray], period: int) -> Recursion:
    def first(b: Arrays, period: int = period, **params):
        e, chain = b["close"], []
        for _ in range(levels):
            e = K.ema_of(e, period)
            chain.append(e)
        return K.RECURSIVE[kernel](b, period, **params), _last(*chain)

    def go(b: Arrays, h: int, state: np.ndarray, period: int = period, **params):
        y = _smoothing(b["close"][h:], state, [2 / (period + 1)] * levels, lambda j, x, v: v[j - 1] if j else x)
        before = np.concatenate([state[None], y[:-1]])
        return {kernel: combine(y, before, **params)}, y[-1]

    return Recursion(first, go, lambda period=period, **_: levels * (period - 1) + 2)


def _t3(y: np.ndarray, _: np.ndarray, vfactor: float = 0.7) -> np.ndarray:
    v = vfactor
    return -(v**3) * y[:, 5] + (3 * v * v + 3 * v**3) * y[:, 4] + (-6 * v * v - 3 * v - 3 * v**3) * y[:, 3] + (1 + 3 * v + v**3 + 3 * v * v) * y[:, 2]


def _converging(name: str, fast: int, slow: int, a: float | None, s: float | None) -> Recursion:
    """Two means and the mean of their difference."""

    def periods(fast: int = fast, slow: int = slow, signal: int = 9) -> tuple[int, int, int]:
        return min(fast, slow), max(fast, slow), signal

    def first(b: Arrays, **params):
        quick, calm, signal = periods(**params)
        x, at = b["close"], calm - 1
        if at >= len(x):
            return K.RECURSIVE[name](b, **params), [np.nan] * 3
        low = K.recur(x, a or 2 / (quick + 1), float(x[at - quick + 1 : at + 1].mean()), at)
        high = K.recur(x, s or 2 / (calm + 1), float(x[:calm].mean()), at)
        return K.RECURSIVE[name](b, **params), _last(low, high, K.ema_of(low - high, signal))

    def go(b: Arrays, h: int, state: np.ndarray, **params):
        quick, calm, signal = periods(**params)
        factors = [a or 2 / (quick + 1), s or 2 / (calm + 1), 2 / (signal + 1)]
        y = _smoothing(b["close"][h:], state, factors, lambda j, x, v: v[0] - v[1] if j == 2 else x)
        line = y[:, 0] - y[:, 1]
        return {"macd": line, "signal": y[:, 2], "histogram": line - y[:, 2]}, y[-1]

    return Recursion(first, go, lambda **params: sum(periods(**params)[1:]) + 1)


# the adaptive mean: another factor in each row


def _kama_first(b: Arrays, period: int = 30):
    out = K.kama(b, period)
    return out, _last(out["kama"])


def _kama_go(b: Arrays, h: int, state: np.ndarray, period: int = 30):
    x = b["close"]
    moves = np.concatenate([[0.0], np.abs(np.diff(x))])
    factors = np.empty(len(x) - h)
    for t in range(h, len(x)):
        path, net = moves[t - period + 1 : t + 1].sum(), abs(x[t] - x[t - period])
        ratio = 1.0 if path <= net else net / path if path else 0.0
        factors[t - h] = (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2
    y = _smoothing(x[h:], state, [factors], lambda j, v, _: v)
    return {"kama": y[:, 0]}, y[-1]


# directional movement: three running sums, and a mean of what follows from them


def _sums(b: Arrays, n: int) -> list[np.ndarray]:
    up, down = K._moves(b)
    return [K.wilder_sum(x, n) for x in (up, down, K.true_range(b))]


def _indices(p: np.ndarray, m: np.ndarray, t: np.ndarray) -> Arrays:
    with np.errstate(invalid="ignore", divide="ignore"):
        plus, minus = np.where(t == 0, 0.0, 100 * p / t), np.where(t == 0, 0.0, 100 * m / t)
        dx = np.where(plus + minus == 0, 0.0, 100 * np.abs(plus - minus) / (plus + minus))
    return {"plus_dm": p, "minus_dm": m, "plus_di": plus, "minus_di": minus, "dx": dx}


def _directional(name: str) -> Recursion:
    def first(b: Arrays, period: int = 14):
        return K.RECURSIVE[name](b, period), _last(*_sums(b, period))

    def go(b: Arrays, h: int, state: np.ndarray, period: int = 14):
        up, down = K._moves(b)
        x = np.stack([up, down, K.true_range(b)], axis=1)[h:]
        y, s = np.empty((len(x), *state.shape)), state.astype(float).copy()
        for t in range(len(x)):
            s = s - s / period + x[t][:, None]
            y[t] = s
        return {name: _indices(y[:, 0], y[:, 1], y[:, 2])[name]}, s

    return Recursion(first, go, lambda period=14: period + 1, lambda period=14: 1)


def _mean_first(b: Arrays, period: int = 14, at: int = 0, lags: int = 0):
    y = K.wilder_of(b["close"], period, at)
    if not lags:
        return {"mean": y}, _last(y)
    paired = np.concatenate([np.full(min(lags, len(y)), np.nan), (y[lags:] + y[: max(len(y) - lags, 0)]) / 2])
    return {"mean": paired}, [float(v) for v in y[::-1][: lags + 1]] if len(y) > lags else [np.nan] * (lags + 1)


def _mean_go(b: Arrays, h: int, state: np.ndarray, period: int = 14, at: int = 0, lags: int = 0):
    """Wilder's mean; with lags the state holds earlier values, the newest first, and the output is the mean of both ends."""
    x, y = b["close"][h:], state.astype(float).copy()
    out = np.empty((len(x), state.shape[1]))
    for t in range(len(x)):
        new = y[0] + (x[t] - y[0]) / period
        out[t] = (new + y[lags - 1]) / 2 if lags else new
        y = np.concatenate([new[None], y[:-1]])
    return {"mean": out}, y


# running sums


def _oscillating_first(b: Arrays, fast: int = 3, slow: int = 10):
    line = np.cumsum(_flow(b))
    means = [K.recur(line, 2 / (n + 1), line[0], 0) for n in (fast, slow)] if len(line) else [line, line]
    return K.adosc(b, fast, slow), _last(line, *means)


def _flow(b: Arrays) -> np.ndarray:
    span = b["high"] - b["low"]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(span > 0, ((b["close"] - b["low"]) - (b["high"] - b["close"])) / span * b["volume"], 0.0)


def _oscillating_go(b: Arrays, h: int, state: np.ndarray, fast: int = 3, slow: int = 10):
    x, y = _flow(b)[h:], state.astype(float).copy()
    out = np.empty((len(x), *state.shape))
    for t in range(len(x)):
        y[0] += x[t]
        y[1] += 2 / (fast + 1) * (y[0] - y[1])
        y[2] += 2 / (slow + 1) * (y[0] - y[2])
        out[t] = y
    return {"adosc": out[:, 1] - out[:, 2]}, y


def _running(name: str, steps: Callable[[Arrays], np.ndarray], halo: int) -> Recursion:
    def first(b: Arrays):
        y = np.cumsum(steps(b))
        return {name: y}, _last(y)

    def go(b: Arrays, h: int, state: np.ndarray):
        y = state + np.cumsum(steps(b)[h:])[:, None]
        return {name: y}, y[-1:]

    return Recursion(first, go, lambda: 1, lambda: halo)


def _volume_steps(b: Arrays) -> np.ndarray:
    change = np.concatenate([[1.0], np.diff(b["close"])])  # the first volume counts
    return np.sign(change) * b["volume"]


# single means


def _ema_first(b: Arrays, period: int = 30):
    y = K.ema_of(b["close"], period)
    return {"ema": y}, _last(y)


def _ema_go(b: Arrays, h: int, state: np.ndarray, period: int = 30):
    y = _smoothing(b["close"][h:], state, [2 / (period + 1)], lambda j, x, _: x)
    return {"ema": y[:, 0]}, y[-1]


def _gains(x: np.ndarray) -> list[np.ndarray]:
    d = np.concatenate([[0.0], np.diff(x)]) if len(x) else x
    return [np.maximum(d, 0), np.maximum(-d, 0)]


def _wilders(name: str, steps: Callable[[Arrays], list[np.ndarray]], combine: Callable[..., np.ndarray]) -> Recursion:
    """Wilder's means of some series, and a value of them and the close."""

    def first(b: Arrays, period: int = 14):
        return K.RECURSIVE[name](b, period), _last(*[K.wilder_of(x, period) for x in steps(b)])

    def go(b: Arrays, h: int, state: np.ndarray, period: int = 14):
        x, y = np.stack(steps(b), axis=1)[h:], state.astype(float).copy()
        out = np.empty((len(x), *state.shape))
        for t in range(len(x)):
            y += (x[t][:, None] - y) / period
            out[t] = y
        return {name: combine(out, b["close"][h:, None])}, y

    return Recursion(first, go, lambda period=14: period + 1, lambda period=14: 1)


def _balance(g: np.ndarray, d: np.ndarray, top: np.ndarray) -> np.ndarray:
    return np.where(g + d == 0, 0.0, 100 * top / (g + d))


# the exponential mean of squared returns


def _returns(b: Arrays) -> np.ndarray:
    c, r = b["close"], np.zeros(len(b["close"]))
    good = np.flatnonzero((c[1:] > 0) & (c[:-1] > 0)) + 1
    r[good] = np.log(c[good] / c[good - 1])
    return r


def _spread_first(b: Arrays, lookback: int = 60):
    r, square = _returns(b), np.nan
    if len(r) >= lookback:
        square = float(r[:lookback].var())
        for x in r[lookback:]:
            square += 2 / (lookback + 1) * (x * x - square)
    return K.ewma_volatility(b, lookback), [square]


def _spread_go(b: Arrays, h: int, state: np.ndarray, lookback: int = 60):
    y = _smoothing(_returns(b)[h:] ** 2, state, [2 / (lookback + 1)], lambda j, x, _: x)
    return {"volatility": np.maximum(np.sqrt(y[:, 0]), 0.001)}, y[-1]


#: By name, as the kernels of the same names.
RECURSIONS: dict[str, Recursion] = {
    "ema": Recursion(_ema_first, _ema_go, lambda period=30: period + 1),
    "rsi": _wilders("rsi", lambda b: _gains(b["close"]), lambda y, _: _balance(y[:, 0], y[:, 1], y[:, 0])),
    "cmo": _wilders("cmo", lambda b: _gains(b["close"]), lambda y, _: _balance(y[:, 0], y[:, 1], y[:, 0] - y[:, 1])),
    "atr": _wilders("atr", lambda b: [K.true_range(b)], lambda y, _: y[:, 0]),
    "natr": _wilders("natr", lambda b: [K.true_range(b)], lambda y, close: np.where(close != 0, y[:, 0] / close * 100, 0.0)),
    "dema": _chained("dema", 2, lambda y, _: 2 * y[:, 0] - y[:, 1], 30),
    "tema": _chained("tema", 3, lambda y, _: 3 * y[:, 0] - 3 * y[:, 1] + y[:, 2], 30),
    "t3": _chained("t3", 6, _t3, 5),
    "trix": _chained("trix", 3, lambda y, before: (y[:, 2] / before[:, 2] - 1) * 100, 30),
    "macd": _converging("macd", 12, 26, None, None),
    "macdfix": _converging("macdfix", 12, 26, 0.15, 0.075),
    "kama": Recursion(_kama_first, _kama_go, lambda period=30: period + 1, lambda period=30: period),
    "adosc": Recursion(_oscillating_first, _oscillating_go, lambda fast=3, slow=10: max(fast, slow)),
    "ewma_volatility": Recursion(_spread_first, _spread_go, lambda lookback=60: lookback + 1, lambda lookback=60: 1),
    "ad": _running("ad", _flow, 0),
    "obv": _running("obv", _volume_steps, 1),
    **{n: _directional(n) for n in ("plus_dm", "minus_dm", "plus_di", "minus_di", "dx")},
}
#: Wilder's mean of a column, from place ``at`` on.
MEAN = Recursion(_mean_first, _mean_go, lambda period=14, at=0, lags=0: at + period + lags + 1)


def _reach(types: list[int], periods: list[int]) -> int | None:
    """Rows that moving means of these types look back; None if one of them has no end."""
    return sum(periods) if all(t in (0, 2, 5) for t in types) else None


#: Kernels with a bounded memory for these parameters, and how many rows they look back.
BOUNDED: dict[str, Callable[..., int | None]] = {
    "ma": lambda period=30, ma_type=0: _reach([ma_type], [period]),
    "mavp": lambda low=2, high=30, ma_type=0: _reach([ma_type], [high]),
    "macdext": lambda fast=12, fast_type=0, slow=26, slow_type=0, signal=9, signal_type=0: _reach([fast_type, slow_type, signal_type], [max(fast, slow), signal]),
    "apo": lambda fast=12, slow=26, ma_type=1: _reach([ma_type], [max(fast, slow)]),
    "ppo": lambda fast=12, slow=26, ma_type=1: _reach([ma_type], [max(fast, slow)]),
    "bbands": lambda period=5, up=2.0, down=2.0, ma_type=1: _reach([ma_type], [period]),
    "stoch": lambda fast_k=5, slow_k=3, slow_d=3, ma_type=1: _reach([ma_type], [fast_k, slow_k, slow_d]),
}


@dataclass(frozen=True)
class Wanted:
    """A recursion (or a kernel of bounded memory) with its parameters, the columns it reads and makes, and the names of its outputs."""

    kind: Recursion | Callable[..., Arrays]
    params: dict
    columns: list[str]
    outputs: tuple[str, ...]
    source: str | None = None
    halo: int = 0
    warm: int = 1
    states: int = 0  # values of a state

    @property
    def recursive(self) -> bool:
        return isinstance(self.kind, Recursion)

    def arrays(self, frame: pd.DataFrame) -> Arrays:
        own = {f: frame[f].to_numpy(dtype=float) for f in FIELDS if f in frame}
        return own | ({"close": frame[self.source].to_numpy(dtype=float)} if self.source else {})


def wanted(kind: Recursion, params: dict, columns: list[str], outputs: tuple[str, ...], source: str | None = None) -> Wanted:
    states = len(kind.first({f: np.zeros(0) for f in FIELDS}, **params)[1])
    return Wanted(kind, params, columns, outputs, source, kind.halo(**params), kind.warm(**params), states)


def rows_for(asked: list[Wanted], rows: int = ROWS) -> int:
    """Rows of a block that suffice for all halos and beginnings, at least ``rows``."""
    return max([rows, *(w.halo for w in asked), *(w.warm for w in asked)])


def run(df: DataFrame, asked: list[Wanted], rows: int = ROWS) -> DataFrame:
    """``df`` (from ``blocks.placed`` with these rows) with the outputs of all that is asked, in one pass over blocks.

    What reads the output of another one (by its ``source``) comes after it, and has a step of its own.
    """
    made = {c for w in asked for c in w.columns}
    steps = [[w for w in asked if w.source not in made], [w for w in asked if w.source in made]]
    steps = [s for s in steps if s]
    kept = list(df.schema.fields)
    schema = T.StructType([*kept, *(T.StructField(c, T.DoubleType()) for w in asked for c in w.columns)])

    def outputs(frame: pd.DataFrame, known: list) -> pd.DataFrame:
        """The rows of a block itself with the outputs of the steps whose states are known; the halo's are missing."""
        h, begins = int(frame["_halo"].sum()), frame["_block"].iat[0] == 0
        frame = frame.copy()
        for step, state in zip(steps, known, strict=False):
            at = 0
            for w in step:
                b = w.arrays(frame)
                with np.errstate(all="ignore"):
                    if not w.recursive:
                        outs = {n: v[h:] for n, v in w.kind(b, **w.params).items()}
                    elif begins:
                        outs = w.kind.first(b, **w.params)[0]
                    else:
                        k = w.states
                        outs = {n: v[:, 0] for n, v in w.kind.go(b, h, np.asarray(state[at : at + k], dtype=float)[:, None], **w.params)[0].items()}
                        at += k
                for c, o in zip(w.columns, w.outputs, strict=True):
                    frame[c] = np.concatenate([np.full(h, np.nan), outs[o]])
        return frame

    def change_of(step: list[Wanted]):
        def change(frame: pd.DataFrame, known: list) -> list[float]:
            """For each recursion the image of zero, then of the unit vectors less it; of the first block the state that it leaves."""
            h, begins, out = int(frame["_halo"].sum()), frame["_block"].iat[0] == 0, []
            if len(frame) - h < rows:  # the last block of its series: no other follows
                return out
            frame = outputs(frame, known)
            for w in step:
                if not w.recursive:
                    continue
                b, k = w.arrays(frame), w.states
                with np.errstate(all="ignore"):
                    if begins:
                        out += w.kind.first(b, **w.params)[1]
                    else:
                        end = w.kind.go(b, h, np.concatenate([np.zeros((k, 1)), np.eye(k)], axis=1), **w.params)[1]
                        out += [*end[:, 0], *(end[:, 1:] - end[:, :1]).ravel()]
            return out

        return change

    def enter_of(step: list[Wanted]):
        own = [w.states for w in step if w.recursive]

        def enter(blocks: list[int], maps: list) -> list[list[float]]:
            now = [np.full(k, np.nan) for k in own]
            states = []
            for block, packed in zip(blocks, maps, strict=True):
                states.append([float(v) for s in now for v in s])
                at, following = 0, []
                for k, s in zip(own, now, strict=True) if len(packed) else ():
                    end, at = np.asarray(packed[at : at + k], dtype=float), at + k
                    if block:
                        end, at = end + np.asarray(packed[at : at + k * k], dtype=float).reshape(k, k) @ s, at + k * k
                    following.append(end)
                now = following
            return states

        return enter

    def replay(frame: pd.DataFrame, known: list) -> pd.DataFrame:
        return outputs(frame, known).iloc[int(frame["_halo"].sum()) :][schema.names]

    return carried(with_halo(df, max(w.halo for w in asked), rows), [(change_of(s), enter_of(s)) for s in steps], replay, schema)
