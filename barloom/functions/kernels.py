"""Recursive indicators: kernels over one ordered series, run as grouped maps.

A kernel takes arrays ``open, high, low, close, volume`` and gives arrays of the same
length, NaN before the first defined bar. Only recursions that windows can't express
are here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Arrays = dict[str, np.ndarray]
NAN = float("nan")


def _empty(n: int) -> np.ndarray:
    return np.full(n, NAN)


def recur(x: np.ndarray, alpha: float, seed: float, begin: int) -> np.ndarray:
    """``y[begin] = seed`` and ``y += alpha * (x - y)`` after it."""
    out, y = _empty(len(x)), seed
    if begin >= len(x):
        return out
    out[begin] = y
    for i in range(begin + 1, len(x)):
        y += alpha * (x[i] - y)
        out[i] = y
    return out


def ema_of(x: np.ndarray, n: int, begin: int | None = None) -> np.ndarray:
    """Exponential mean seeded by the mean of the first n defined values (ending at ``begin``)."""
    first = int(np.argmax(~np.isnan(x))) if np.isnan(x).any() else 0
    at = first + n - 1 if begin is None else begin
    if at >= len(x) or np.isnan(x).all():
        return _empty(len(x))
    return recur(x, 2 / (n + 1), float(x[at - n + 1 : at + 1].mean()), at)


def wilder_of(x: np.ndarray, n: int, first: int = 1) -> np.ndarray:
    """Wilder's mean: seeded by the mean of n values from ``first`` on."""
    at = first + n - 1
    if at >= len(x):
        return _empty(len(x))
    return recur(x, 1 / n, float(x[first : at + 1].mean()), at)


def wilder_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's running sum, seeded by the n - 1 values after the first."""
    out = _empty(len(x))
    if n > len(x):
        return out
    s = float(x[1:n].sum())
    out[n - 1] = s
    for i in range(n, len(x)):
        s += x[i] - s / n
        out[i] = s
    return out


def sma_of(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of the last n values; NaN until n values are defined."""
    out = _empty(len(x))
    for i in range(n - 1, len(x)):
        out[i] = x[i - n + 1 : i + 1].mean()
    return out


def wma_of(x: np.ndarray, n: int) -> np.ndarray:
    out, w = _empty(len(x)), np.arange(1, n + 1) / (n * (n + 1) / 2)
    for i in range(n - 1, len(x)):
        out[i] = x[i - n + 1 : i + 1] @ w
    return out


def true_range(b: Arrays) -> np.ndarray:
    before = np.concatenate([[NAN], b["close"][:-1]])
    return np.maximum(b["high"] - b["low"], np.maximum(np.abs(b["high"] - before), np.abs(b["low"] - before)))


def ema(b: Arrays, period: int = 30) -> Arrays:
    return {"ema": ema_of(b["close"], period)}


def dema(b: Arrays, period: int = 30) -> Arrays:
    e = ema_of(b["close"], period)
    return {"dema": 2 * e - ema_of(e, period)}


def tema(b: Arrays, period: int = 30) -> Arrays:
    e1 = ema_of(b["close"], period)
    e2 = ema_of(e1, period)
    return {"tema": 3 * e1 - 3 * e2 + ema_of(e2, period)}


def t3(b: Arrays, period: int = 5, vfactor: float = 0.7) -> Arrays:
    e, chain = b["close"], []
    for _ in range(6):
        e = ema_of(e, period)
        chain.append(e)
    v = vfactor
    weights = (-(v**3), 3 * v * v + 3 * v**3, -6 * v * v - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v * v)
    return {"t3": sum(w * x for w, x in zip(weights, chain[:1:-1], strict=True))}


def kama(b: Arrays, period: int = 30) -> Arrays:
    x, n = b["close"], period
    out = _empty(len(x))
    if len(x) <= n:
        return {"kama": out}
    k, moves = x[n - 1], np.abs(np.diff(x))
    for i in range(n, len(x)):
        path, net = moves[i - n : i].sum(), abs(x[i] - x[i - n])
        ratio = 1.0 if path <= net else net / path if path else 0.0
        k += (ratio * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (x[i] - k)
        out[i] = k
    return {"kama": out}


def trix(b: Arrays, period: int = 30) -> Arrays:
    e = b["close"]
    for _ in range(3):
        e = ema_of(e, period)
    out = _empty(len(e))
    out[1:] = (e[1:] / e[:-1] - 1) * 100
    return {"trix": out}


def _macd(x: np.ndarray, fast: int, slow: int, signal: int, a: float | None = None, s: float | None = None) -> Arrays:
    if fast > slow:
        fast, slow = slow, fast
    n, at = len(x), slow - 1
    if at >= n:
        return {"macd": _empty(n), "signal": _empty(n), "histogram": _empty(n)}
    quick = recur(x, a or 2 / (fast + 1), float(x[at - fast + 1 : at + 1].mean()), at)
    calm = recur(x, s or 2 / (slow + 1), float(x[:slow].mean()), at)
    line = quick - calm
    mean = ema_of(line, signal)
    line = np.where(np.isnan(mean), NAN, line)
    return {"macd": line, "signal": mean, "histogram": line - mean}


def macd(b: Arrays, fast: int = 12, slow: int = 26, signal: int = 9) -> Arrays:
    return _macd(b["close"], fast, slow, signal)


def macdfix(b: Arrays, signal: int = 9) -> Arrays:
    """Periods 12 and 26 with the fixed factors 0.15 and 0.075."""
    return _macd(b["close"], 12, 26, signal, 0.15, 0.075)


def mean_by_type(x: np.ndarray, n: int, kind: int = 0) -> np.ndarray:
    """Moving mean by number: simple, exponential, weighted, double, triple, triangular, adaptive, MAMA, T3."""
    b = {"close": x}
    first = int(np.argmax(~np.isnan(x))) if len(x) else 0
    shift = lambda y: np.concatenate([_empty(first), y])
    part = {"close": x[first:]}
    if n <= 1:
        return x.copy()
    if kind == 0:
        return shift(sma_of(part["close"], n))
    if kind == 1:
        return ema_of(x, n)
    if kind == 2:
        return shift(wma_of(part["close"], n))
    if kind == 3:
        return dema(b, n)["dema"]
    if kind == 4:
        return tema(b, n)["tema"]
    if kind == 5:
        return shift(_trima(part["close"], n))
    if kind == 6:
        return shift(kama(part, n)["kama"])
    if kind == 7:
        return shift(mama(part)["mama"])
    if kind == 8:
        return t3(b, n)["t3"]
    raise ValueError(f"no moving mean of type {kind}")


def _trima(x: np.ndarray, n: int) -> np.ndarray:
    a, c = (n + 1) // 2, n // 2 + 1
    w = np.convolve(np.ones(a), np.ones(c)) / (a * c)
    out = _empty(len(x))
    for i in range(n - 1, len(x)):
        out[i] = x[i - len(w) + 1 : i + 1] @ w
    return out


def ma(b: Arrays, period: int = 30, ma_type: int = 0) -> Arrays:
    return {"ma": mean_by_type(b["close"], period, ma_type)}


def mavp(b: Arrays, low: int = 2, high: int = 30, ma_type: int = 0) -> Arrays:
    """Simple-type mean whose period is the volume column, within bounds."""
    periods = np.clip(np.nan_to_num(b["volume"], nan=low).astype(int), low, high)
    out = _empty(len(periods))
    for n in np.unique(periods):
        out = np.where(periods == n, mean_by_type(b["close"], int(n), ma_type), out)
    out[: high - 1] = NAN
    return {"mavp": out}


def macdext(b: Arrays, fast: int = 12, fast_type: int = 0, slow: int = 26, slow_type: int = 0, signal: int = 9, signal_type: int = 0) -> Arrays:
    line = mean_by_type(b["close"], fast, fast_type) - mean_by_type(b["close"], slow, slow_type)
    mean = mean_by_type(line, signal, signal_type)
    line = np.where(np.isnan(mean), NAN, line)
    return {"macd": line, "signal": mean, "histogram": line - mean}


def _gains(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    d = np.concatenate([[0.0], np.diff(x)])
    return wilder_of(np.maximum(d, 0), n), wilder_of(np.maximum(-d, 0), n)


def rsi(b: Arrays, period: int = 14) -> Arrays:
    g, d = _gains(b["close"], period)
    with np.errstate(invalid="ignore", divide="ignore"):
        return {"rsi": np.where(g + d == 0, 0.0, 100 * g / (g + d))}


def cmo(b: Arrays, period: int = 14) -> Arrays:
    g, d = _gains(b["close"], period)
    with np.errstate(invalid="ignore", divide="ignore"):
        return {"cmo": np.where(g + d == 0, 0.0, 100 * (g - d) / (g + d))}


def stochrsi(b: Arrays, period: int = 14, fast_k: int = 5, fast_d: int = 3) -> Arrays:
    r = rsi(b, period)["rsi"]
    k = _empty(len(r))
    for i in range(period + fast_k - 1, len(r)):
        part = r[i - fast_k + 1 : i + 1]
        top, bottom = part.max(), part.min()
        k[i] = (r[i] - bottom) / (top - bottom) * 100 if top > bottom else 0.0
    d = mean_by_type(k, fast_d) if (~np.isnan(k)).any() else _empty(len(r))
    return {"fastk": np.where(np.isnan(d), NAN, k), "fastd": d}


def atr(b: Arrays, period: int = 14) -> Arrays:
    return {"atr": wilder_of(true_range(b), period)}


def natr(b: Arrays, period: int = 14) -> Arrays:
    with np.errstate(invalid="ignore", divide="ignore"):
        return {"natr": np.where(b["close"] != 0, atr(b, period)["atr"] / b["close"] * 100, 0.0)}


def _moves(b: Arrays) -> tuple[np.ndarray, np.ndarray]:
    up = np.concatenate([[0.0], np.diff(b["high"])])
    down = np.concatenate([[0.0], -np.diff(b["low"])])
    return np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)


def plus_dm(b: Arrays, period: int = 14) -> Arrays:
    return {"plus_dm": wilder_sum(_moves(b)[0], period)}


def minus_dm(b: Arrays, period: int = 14) -> Arrays:
    return {"minus_dm": wilder_sum(_moves(b)[1], period)}


def _indices(b: Arrays, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """+DI, -DI and DX from bar n on."""
    up, down = _moves(b)
    p, m, t = wilder_sum(up, n), wilder_sum(down, n), wilder_sum(true_range(b), n)
    with np.errstate(invalid="ignore", divide="ignore"):
        pdi, mdi = np.where(t == 0, 0.0, 100 * p / t), np.where(t == 0, 0.0, 100 * m / t)
        dx = np.where(pdi + mdi == 0, 0.0, 100 * np.abs(pdi - mdi) / (pdi + mdi))
    for x in (pdi, mdi, dx):
        x[:n] = NAN
    return pdi, mdi, dx


def plus_di(b: Arrays, period: int = 14) -> Arrays:
    return {"plus_di": _indices(b, period)[0]}


def minus_di(b: Arrays, period: int = 14) -> Arrays:
    return {"minus_di": _indices(b, period)[1]}


def dx(b: Arrays, period: int = 14) -> Arrays:
    return {"dx": _indices(b, period)[2]}


def adx(b: Arrays, period: int = 14) -> Arrays:
    return {"adx": wilder_of(_indices(b, period)[2], period, period)}


def adxr(b: Arrays, period: int = 14) -> Arrays:
    a = adx(b, period)["adx"]
    out = _empty(len(a))
    out[period - 1 :] = (a[period - 1 :] + a[: len(a) - period + 1]) / 2 if len(a) >= period else NAN
    return {"adxr": out}


def sarext(b: Arrays, start: float = 0.0, reversal: float = 0.0, accel_long: float = 0.02, step_long: float = 0.02, max_long: float = 0.2, accel_short: float = 0.02, step_short: float = 0.02, max_short: float = 0.2, signed: bool = True) -> Arrays:
    """Parabolic stop and reverse; short positions carry a negative sign if ``signed``."""
    h, low = b["high"], b["low"]
    out = _empty(len(h))
    if len(h) < 2:
        return {"sarext": out}
    up, down = _moves(b)
    long = start > 0 or (start == 0 and down[1] <= up[1])
    stop = abs(start) if start else (low[0] if long else h[0])
    best, af = (h[1], accel_long) if long else (low[1], accel_short)
    for i in range(1, len(h)):
        if long:
            if low[i] <= stop and i > 1:
                long, stop = False, max(best, h[i], h[i - 1]) * (1 + reversal)
                out[i] = -stop if signed else stop
                best, af = low[i], accel_short
                stop = max(stop + af * (best - stop), h[i], h[i - 1])
                continue
            out[i] = stop
            if h[i] > best:
                best, af = h[i], min(af + step_long, max_long) if i > 1 else af
            stop = min(stop + af * (best - stop), low[i], low[i - 1])
        else:
            if h[i] >= stop and i > 1:
                long, stop = True, min(best, low[i], low[i - 1]) * (1 - reversal)
                out[i] = stop
                best, af = h[i], accel_long
                stop = min(stop + af * (best - stop), low[i], low[i - 1])
                continue
            out[i] = -stop if signed else stop
            if low[i] < best:
                best, af = low[i], min(af + step_short, max_short) if i > 1 else af
            stop = max(stop + af * (best - stop), h[i], h[i - 1])
    return {"sarext": out}


def sar(b: Arrays, acceleration: float = 0.02, maximum: float = 0.2) -> Arrays:
    a = min(acceleration, maximum)
    return {"sar": sarext(b, 0.0, 0.0, a, a, maximum, a, a, maximum, signed=False)["sarext"]}


def adosc(b: Arrays, fast: int = 3, slow: int = 10) -> Arrays:
    span = b["high"] - b["low"]
    with np.errstate(invalid="ignore", divide="ignore"):
        flow = np.where(span > 0, ((b["close"] - b["low"]) - (b["high"] - b["close"])) / span * b["volume"], 0.0)
    line = np.cumsum(flow)
    out = recur(line, 2 / (fast + 1), line[0], 0) - recur(line, 2 / (slow + 1), line[0], 0) if len(line) else line
    out[: slow - 1] = NAN
    return {"adosc": out}


def ewma_volatility(b: Arrays, lookback: int = 60) -> Arrays:
    """Sample deviation of log returns so far; from ``lookback`` on an exponential mean of squares."""
    c = b["close"]
    r = np.zeros(len(c))
    good = np.zeros(len(c), dtype=bool)
    good[1:] = (c[1:] > 0) & (c[:-1] > 0)
    r[good] = np.log(c[good] / c[np.flatnonzero(good) - 1])
    out = np.zeros(len(c))
    count, mean, m2 = 0, 0.0, 0.0
    decay = 1 - 2 / (lookback + 1)
    square = 0.0
    for i, x in enumerate(r):
        if i < lookback:
            count += 1
            delta = x - mean
            mean += delta / count
            m2 += delta * (x - mean)
            out[i] = (m2 / (count - 1)) ** 0.5 if count > 1 else 0.0
            square = m2 / count
        else:
            square = decay * square + (1 - decay) * x * x
            out[i] = square**0.5
    return {"volatility": np.maximum(out, 0.001)}


class _Hilbert:
    """Ehlers' discriminator: smoothed price, detrender, phase components and dominant period, bar by bar."""

    def __init__(self, x: np.ndarray) -> None:
        n = len(x)
        self.n = n
        self.smooth, self.period, self.inphase, self.quadrature, self.smooth_period = (np.zeros(n) for _ in range(5))
        detrender, q1, i1, ji, jq, i2, q2, re, im = (np.zeros(n) for _ in range(9))
        tap = lambda y, i: 0.0962 * y[i] + 0.5769 * y[i - 2] - 0.5769 * y[i - 4] - 0.0962 * y[i - 6]
        for i in range(n):
            if i < 3:
                continue
            self.smooth[i] = (4 * x[i] + 3 * x[i - 1] + 2 * x[i - 2] + x[i - 3]) / 10
            if i < 9:
                continue
            gain = 0.075 * self.period[i - 1] + 0.54
            detrender[i] = tap(self.smooth, i) * gain
            q1[i], i1[i] = tap(detrender, i) * gain, detrender[i - 3]
            ji[i], jq[i] = tap(i1, i) * gain, tap(q1, i) * gain
            i2[i] = 0.2 * (i1[i] - jq[i]) + 0.8 * i2[i - 1]
            q2[i] = 0.2 * (q1[i] + ji[i]) + 0.8 * q2[i - 1]
            re[i] = 0.2 * (i2[i] * i2[i - 1] + q2[i] * q2[i - 1]) + 0.8 * re[i - 1]
            im[i] = 0.2 * (i2[i] * q2[i - 1] - q2[i] * i2[i - 1]) + 0.8 * im[i - 1]
            before = self.period[i - 1]
            p = 2 * np.pi / np.arctan(im[i] / re[i]) if im[i] != 0 and re[i] != 0 else before
            p = min(max(p, 0.67 * before), 1.5 * before) if before else p
            p = 0.2 * min(max(p, 6), 50) + 0.8 * before
            self.period[i] = p
            self.smooth_period[i] = 0.33 * p + 0.67 * self.smooth_period[i - 1]
            self.inphase[i], self.quadrature[i] = i1[i], q1[i]

    def phase(self) -> np.ndarray:
        out = np.zeros(self.n)
        for i in range(self.n):
            cycle = int(self.smooth_period[i] + 0.5)
            k = np.arange(min(cycle, i + 1))
            part, angle = self.smooth[i - k], 2 * np.pi * k / max(cycle, 1)
            real, imag = (np.sin(angle) * part).sum(), (np.cos(angle) * part).sum()
            d = np.degrees(np.arctan(real / imag)) if abs(imag) > 0.01 else (90.0 if real > 0 else -90.0 if real < 0 else 0.0)
            d += 90.0 + (360.0 / self.smooth_period[i] if self.smooth_period[i] else 0.0)
            d += 180.0 if imag < 0 else 0.0
            out[i] = d - 360.0 if d > 315.0 else d
        return out

    def trendline(self, x: np.ndarray) -> np.ndarray:
        mean = np.zeros(self.n)
        for i in range(self.n):
            cycle = max(int(self.smooth_period[i] + 0.5), 1)
            mean[i] = x[max(0, i - cycle + 1) : i + 1].mean()
        out = mean.copy()
        out[3:] = (4 * mean[3:] + 3 * mean[2:-1] + 2 * mean[1:-2] + mean[:-3]) / 10
        return out


def _after(x: np.ndarray, bars: int) -> np.ndarray:
    out = np.array(x, dtype=float)
    out[:bars] = NAN
    return out


def ht_dcperiod(b: Arrays) -> Arrays:
    return {"ht_dcperiod": _after(_Hilbert(b["close"]).smooth_period, 32)}


def ht_dcphase(b: Arrays) -> Arrays:
    return {"ht_dcphase": _after(_Hilbert(b["close"]).phase(), 63)}


def ht_phasor(b: Arrays) -> Arrays:
    h = _Hilbert(b["close"])
    return {"inphase": _after(h.inphase, 32), "quadrature": _after(h.quadrature, 32)}


def ht_sine(b: Arrays) -> Arrays:
    p = np.radians(_Hilbert(b["close"]).phase())
    return {"sine": _after(np.sin(p), 63), "leadsine": _after(np.sin(p + np.pi / 4), 63)}


def ht_trendline(b: Arrays) -> Arrays:
    return {"ht_trendline": _after(_Hilbert(b["close"]).trendline(b["close"]), 63)}


def ht_trendmode(b: Arrays) -> Arrays:
    h = _Hilbert(b["close"])
    phase, line = h.phase(), h.trendline(b["close"])
    sine, lead = np.sin(np.radians(phase)), np.sin(np.radians(phase + 45))
    out, days = np.zeros(h.n), 0
    for i in range(1, h.n):
        trend = 1
        if (sine[i] > lead[i]) != (sine[i - 1] > lead[i - 1]):
            days, trend = 0, 0
        days += 1
        if days < 0.5 * h.smooth_period[i]:
            trend = 0
        step = phase[i] - phase[i - 1]
        if h.smooth_period[i] and 0.67 * 360 / h.smooth_period[i] < step < 1.5 * 360 / h.smooth_period[i]:
            trend = 0
        if line[i] and abs((h.smooth[i] - line[i]) / line[i]) >= 0.015:
            trend = 1
        out[i] = trend
    return {"ht_trendmode": _after(out, 63)}


def mama(b: Arrays, fast_limit: float = 0.5, slow_limit: float = 0.05) -> Arrays:
    x, h = b["close"], _Hilbert(b["close"])
    slow, fast = np.zeros(len(x)), np.zeros(len(x))
    m = f = before = 0.0
    for i in range(len(x)):
        angle = np.degrees(np.arctan(h.quadrature[i] / h.inphase[i])) if h.inphase[i] else 0.0
        alpha = max(min(fast_limit / max(before - angle, 1.0), fast_limit), slow_limit)
        before = angle
        m = alpha * x[i] + (1 - alpha) * m
        f = 0.5 * alpha * m + (1 - 0.5 * alpha) * f
        slow[i], fast[i] = m, f
    return {"mama": _after(slow, 32), "fama": _after(fast, 32)}


def apo_typed(b: Arrays, fast: int = 12, slow: int = 26, ma_type: int = 1) -> Arrays:
    """Difference of two means of any type."""
    return {"apo": mean_by_type(b["close"], fast, ma_type) - mean_by_type(b["close"], slow, ma_type)}


def ppo_typed(b: Arrays, fast: int = 12, slow: int = 26, ma_type: int = 1) -> Arrays:
    slow_mean = mean_by_type(b["close"], slow, ma_type)
    with np.errstate(invalid="ignore", divide="ignore"):
        return {"ppo": np.where(slow_mean == 0, 0.0, (mean_by_type(b["close"], fast, ma_type) - slow_mean) / slow_mean * 100)}


def bbands_typed(b: Arrays, period: int = 5, up: float = 2.0, down: float = 2.0, ma_type: int = 1) -> Arrays:
    """Bands around a mean of any type, as wide as the deviation from the simple mean."""
    x, middle = b["close"], mean_by_type(b["close"], period, ma_type)
    spread = _empty(len(x))
    for i in range(period - 1, len(x)):
        spread[i] = x[i - period + 1 : i + 1].std()
    return {"upper": middle + up * spread, "middle": middle, "lower": middle - down * spread}


def stoch_typed(b: Arrays, fast_k: int = 5, slow_k: int = 3, slow_d: int = 3, ma_type: int = 1) -> Arrays:
    k = _empty(len(b["close"]))
    for i in range(fast_k - 1, len(k)):
        top, bottom = b["high"][i - fast_k + 1 : i + 1].max(), b["low"][i - fast_k + 1 : i + 1].min()
        k[i] = (b["close"][i] - bottom) / (top - bottom) * 100 if top > bottom else 0.0
    slow = mean_by_type(k, slow_k, ma_type)
    d = mean_by_type(slow, slow_d, ma_type)
    return {"slowk": np.where(np.isnan(d), NAN, slow), "slowd": d}


#: Forms, with ``ma_type`` above 0, of indicators that are windowed with simple means.
TYPED: dict[str, Callable[..., Arrays]] = {"apo": apo_typed, "ppo": ppo_typed, "bbands": bbands_typed, "stoch": stoch_typed}

RECURSIVE: dict[str, Callable[..., Arrays]] = {
    f.__name__: f
    for f in (
        ema, dema, tema, t3, kama, trix, macd, macdfix, macdext, ma, mavp, mama, sar, sarext, rsi, cmo, stochrsi, atr, natr, plus_dm, minus_dm,
        plus_di, minus_di, dx, adx, adxr, adosc, ht_dcperiod, ht_dcphase, ht_phasor, ht_sine, ht_trendline, ht_trendmode, ewma_volatility,
    )
}
