"""Trade signals followed as bars arrive: signals and bars are two streams that meet in keyed state."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the session needs for keyed state of this kind.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTCOMES = (
    "signal_id string, symbol string, direction string, status string, exit_reason string, exit_price double, exit_ts long, "
    "pnl_percent double, high_water_mark double"
)
_SIGNAL = ["signal_id", "direction", "entry_price", "stop_loss", "take_profit", "trailing_percent", "high_water_mark"]
_BAR = ["high", "low", "close"]


def _number(x) -> float | None:
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x)


def step(signal: dict, high: float, low: float, close: float) -> tuple[str, float] | None:
    """Move the mark of an open signal by a bar; the reason and price of its exit, if it has one.

    The bar's own extreme moves the mark first; then the stop loss, the trailing stop and the
    take profit are tested in this order.
    """
    long = signal["direction"] == "long"
    signal["mark"] = max(signal["mark"], high) if long else min(signal["mark"], low)
    loss, gain, percent = signal["stop_loss"], signal["take_profit"], signal["trailing_percent"]
    against = lambda level: level is not None and (low <= level if long else high >= level)
    trail = None if percent is None else signal["mark"] - close * percent / 100 if long else signal["mark"] + close * percent / 100
    if against(loss):
        return "stop_loss", loss
    if against(trail):
        return "trailing_stop", trail
    if gain is not None and (high >= gain if long else low <= gain):
        return "take_profit", gain
    return None


class _Tracker(StatefulProcessor):
    """The open signals of a symbol; those that exit are told and leave the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "signal_id string", "body string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ts", "is_bar"], kind="stable")
        held = {k[0]: json.loads(v[0]) for k, v in self.open.iterator()} if self.open.exists() else {}
        before, done = set(held), []
        for r in frame.itertuples(index=False):
            if not r.is_bar:
                start = _number(r.high_water_mark)
                held[r.signal_id] = {
                    "direction": r.direction, "entry": _number(r.entry_price), "entry_ts": int(r.ts), "mark": _number(r.entry_price) if start is None else start,
                    "stop_loss": _number(r.stop_loss), "take_profit": _number(r.take_profit), "trailing_percent": _number(r.trailing_percent),
                }
                continue
            for name in list(held):
                s = held[name]
                found = step(s, r.high, r.low, r.close) if s["entry_ts"] <= r.ts else None
                if found:
                    reason, price = found
                    pnl = (1 if s["direction"] == "long" else -1) * (price - s["entry"]) / s["entry"] * 100 if s["entry"] else None
                    done.append((name, key[0], s["direction"], "winner" if pnl is not None and pnl > 0 else "loser", reason, price, int(r.ts), pnl, s["mark"]))
                    del held[name]
        for name in before - set(held):
            self.open.removeKey((name,))
        for name, s in held.items():
            self.open.updateValue((name,), (json.dumps(s),))
        yield pd.DataFrame(done, columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    def close(self) -> None:
        pass


def streamed_signals(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """Exits of signals, as soon as a bar brings them.

    ``signals`` and ``bars`` have the columns that ``operators.signals.evaluate`` takes. Bars of a symbol
    must arrive in order of time; a signal counts from its entry on, over the bars that arrive with or after it.
    A symbol's open signals, with their marks, are its state, and leave it with their exit.
    The session must use the state store of :data:`STATE_STORE`.
    """
    kinds = {c: "string" if c in ("signal_id", "direction") else "double" for c in (*_SIGNAL, *_BAR)}
    shape = lambda df, own: [F.col(c).cast(t).alias(c) if c in own else F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    given = signals.select("symbol", F.col("entry_ts").alias("ts"), F.lit(False).alias("is_bar"), *shape(signals, _SIGNAL))
    arriving = bars.select("symbol", "ts", F.lit(True).alias("is_bar"), *shape(bars, _BAR))
    return given.unionByName(arriving).groupBy("symbol").transformWithStateInPandas(_Tracker(), OUTCOMES, "append", "None")
