"""Backtests of long series, block by block.

What a position does depends on bars alone: when it opens, at which levels it closes. Only its
size depends on cash. So blocks of bars are simulated side by side without cash, each from
a flat account at first. A block whose predecessor ends otherwise (in a position, or with an
order waiting) is simulated again from there, and only such blocks are, until each begins as the one before ends.
A position that spans blocks makes as many rounds as it spans. Cash then runs over the trades
of a run, and equity over the bars, block by block.

A trade that the account cannot afford never opens, which changes what follows; such runs
are few, and are simulated from end to end by :func:`barloom.plans.backtest.backtest`.
"""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import KEYS, ROWS, placed, with_halo
from ..functions.indicators import Spec, compute
from ..operators.orders import NAN, Account, Bar, Order, Position, some
from ..sources.store import scratch_folder
from .backtest import EVENTS, Run, Settings, backtest
from .strategies import COLUMNAR, REGISTRY

BARS = ["symbol", "ts", "open", "high", "low", "close", "volume"]
ENDS = "symbol string, _block long, run int, entry string, ending string, trades string"
FLAT = json.dumps({"position": None, "waiting": [], "basis": None})


def supports(runs: list[Run]) -> bool:
    return all(r.strategy in COLUMNAR for r in runs)


class _Uncounted(Account):
    """An account with cash for everything, whose positions hold one unit of money; trades keep their places and what their size follows from."""

    def __init__(self, settings: Settings, state: dict) -> None:
        super().__init__(float("inf"), rules=settings.rules)
        self.position = Position(**state["position"]) if state["position"] else None
        self.waiting, self.basis = [Order(**o) for o in state["waiting"]], state["basis"]

    def state(self) -> str:
        return json.dumps({"position": asdict(self.position) if self.position else None, "waiting": [asdict(o) for o in self.waiting], "basis": self.basis})

    def close(self, price: float, bar: Bar, reason: str) -> None:
        p = self.position
        super().close(price, bar, reason)
        self.trades[-1] = [p.direction, p.price, p.ts, p.index, price, bar.ts, bar.index, *self.trades[-1][9:], *self.basis]


#: What a trade is before it is paid for.
LEGS = ["direction", "entry_price", "entry_ts", "entry_place", "exit_price", "exit_ts", "exit_place", "mae", "mfe", "exit_reason", "basis_price", "basis_stop", "basis_atr"]


def _simulate(frame: pd.DataFrame, i: int, params: dict, settings: Settings, entry: str) -> tuple[str, list]:
    """The state that a block leaves when ``entry`` enters it, and the trades that close in it."""
    account, way = _Uncounted(settings, json.loads(entry)), 1 if settings.direction == "long" else -1
    columns = [frame[c].to_numpy() for c in ("ts", "open", "high", "low", "close", "_place", "_range", f"_entry{i}", f"_exit{i}", f"_stop{i}")]
    for ts, o, h, low, c, place, span, enters, leaves, stop in zip(*(x.tolist() for x in columns), strict=True):
        bar = Bar(ts, o, h, low, c, index=place, exit=bool(leaves), atr=span)
        account.fill(bar)
        account.leave(bar)
        account.mark(bar)
        if enters and account.position is None and not account.waiting and c > 0:
            loss, gain = params.get("stopLossPercent"), params.get("takeProfitPercent")
            floor = stop if some(stop) else c * (100 - way * loss) / 100 if loss else NAN
            account.basis = [c, floor, span]
            account.waiting.append(Order(settings.direction, 1.0, stop=floor, target=c * (100 + way * gain) / 100 if gain else NAN))
        elif leaves and account.position is not None:
            account.waiting.append(Order("short" if way == 1 else "long", 0.0, closes=True))
    last = frame.iloc[-1]
    return json.dumps({"last": [int(last["ts"]), float(last["close"]), int(last["_place"])], "state": account.state()}), account.trades


def _signalled(bars: DataFrame, runs: list[Run], settings: Settings, seconds: int, rows: int) -> DataFrame:
    """Bars with their block, the true range, and entry, exit and stop of each run, all found in blocks."""
    specs, reads = [Spec("atr", {"period": settings.atr_period}, "_range")], []
    for i, run in enumerate(runs):
        own = COLUMNAR[run.strategy].specs(REGISTRY[run.strategy].resolve(run.params))
        named = {k: Spec(s.indicator, s.params, f"_{i}_{k}", s.source) for k, s in own.items()}
        specs += named.values()
        reads.append({f"{k}{c[len(s.prefix):]}": c for k, s in named.items() for c in s.columns()})
    df = with_halo(placed(compute(bars.select(*BARS), specs, seconds=seconds, rows=rows), seconds, rows), 1, rows)
    made = [f"_{kind}{i}" for i in range(len(runs)) for kind in ("entry", "exit", "stop")]

    def signals(frame: pd.DataFrame) -> pd.DataFrame:
        frame, found = frame.sort_values("_place"), {}
        for i, (run, columns) in enumerate(zip(runs, reads, strict=True)):
            values = {c: frame[c].to_numpy(dtype=float) for c in BARS[2:]} | {k: frame[c].to_numpy(dtype=float) for k, c in columns.items()}
            with np.errstate(invalid="ignore", divide="ignore"):
                told = {"stop": np.full(len(frame), NAN)} | COLUMNAR[run.strategy].signals(values, REGISTRY[run.strategy].resolve(run.params))
            found |= {f"_{kind}{i}": told[kind] for kind in ("entry", "exit", "stop")}
        own = frame[[*BARS, "_block", "_place", "_range"]].assign(**found)
        return own[~frame["_halo"]]

    kinds = ", ".join(f"{c} {'double' if '_stop' in c else 'boolean'}" for c in made)
    return df.groupBy(*KEYS).applyInPandas(signals, f"symbol string, ts long, open double, high double, low double, close double, volume double, _block long, _place long, _range double, {kinds}")


class _Scratch:
    """Tables of the rounds, in the shared folder."""

    def __init__(self, df: DataFrame) -> None:
        self.spark = df.sparkSession

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_folder(self.spark, label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def settle(signalled: DataFrame, runs: list[Run], settings: Settings, keep) -> DataFrame:
    """For every block and run the state that enters it, the state that it leaves and its trades, such that each enters as the one before left."""
    params = [REGISTRY[r.strategy].resolve(r.params) for r in runs]

    def rows(frame: pd.DataFrame, entries: list[tuple[int, str]]) -> pd.DataFrame:
        frame, out = frame.sort_values("_place"), []
        for run, entry in entries:
            ending, trades = _simulate(frame, run, params[run], settings, entry)
            out.append((frame["symbol"].iat[0], frame["_block"].iat[0], run, entry, ending, json.dumps(trades)))
        return pd.DataFrame(out, columns=["symbol", "_block", "run", "entry", "ending", "trades"])

    def begin(frame: pd.DataFrame) -> pd.DataFrame:
        return rows(frame, [(i, FLAT) for i in range(len(runs))])

    def again(frame: pd.DataFrame, changed: pd.DataFrame) -> pd.DataFrame:
        return rows(frame, list(zip(changed["run"], changed["entry"], strict=True))) if len(changed) and len(frame) else rows(frame, [])

    keys = [*KEYS, "run"]
    table = keep(signalled.groupBy(*KEYS).applyInPandas(begin, ENDS), "blocks")
    while True:
        left = table.select("symbol", (F.col("_block") + 1).alias("_block"), "run", F.get_json_object("ending", "$.state").alias("left"))
        changed = keep(table.join(left, keys).where("entry <> left").select(*keys, F.col("left").alias("entry")), "changed")
        if changed.isEmpty():
            return table
        blocks = signalled.join(changed.select(*KEYS).distinct(), KEYS, "left_semi")
        redone = blocks.groupBy(*KEYS).cogroup(changed.groupBy(*KEYS)).applyInPandas(again, ENDS)
        table = keep(table.join(changed, keys, "left_anti").unionByName(redone), "blocks")


PAID = EVENTS.replace("run_id string", "run int") + ", entry_place long, exit_place long, cash_in double, cash_out double"
_PAID = [c.split()[0] for c in PAID.split(", ")]


def _paid(table: DataFrame, settings: Settings) -> DataFrame:
    """Trades of each run and symbol with their size, in order; ``kind`` is ``refused`` where one is not affordable."""

    def account(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_block")
        legs = [t for blob in frame["trades"] for t in json.loads(blob)]
        end = json.loads(frame["ending"].iat[-1])
        left = _Uncounted(settings, json.loads(end["state"]))
        if left.position is not None:  # closed with the last bar
            ts, close, place = end["last"]
            left.close(close, Bar(ts, close, close, close, close, index=place), "end_of_backtest")
            legs += left.trades
        cash, out = settings.capital, []
        fixed = {"run": frame["run"].iat[0], "symbol": frame["symbol"].iat[0]}
        for leg in (dict(zip(LEGS, x, strict=True)) for x in legs):
            price, way = leg["entry_price"], 1 if leg["direction"] == "long" else -1
            stake = settings.sizing.stake(cash, leg["basis_price"], leg["basis_stop"], leg["basis_atr"])
            cost = settings.commission.of(stake, stake / price)
            fits = cash >= stake + cost and cash * settings.sizing.max_leverage >= stake
            if not (stake > 0 and (fits or way < 0)):
                return pd.DataFrame([dict.fromkeys(_PAID) | fixed | {"kind": "refused"}])
            qty, cash_in = stake / price, cash - stake - cost
            leaving = settings.commission.of(qty * leg["exit_price"], qty)
            gross = (leg["exit_price"] - price) * qty * way
            cash = cash_in + qty * price + gross - leaving
            kept = {k: leg[k] for k in ("direction", "entry_price", "entry_ts", "exit_price", "exit_ts", "mae", "mfe", "exit_reason", "entry_place", "exit_place")}
            out.append(dict.fromkeys(_PAID) | fixed | kept | {"kind": "trade", "ts": leg["exit_ts"], "qty": qty, "pnl": gross - leaving - cost, "commission": cost + leaving, "bars_held": leg["exit_place"] - leg["entry_place"], "cash_in": cash_in, "cash_out": cash})
        return pd.DataFrame(out, columns=_PAID)

    return table.groupBy("symbol", "run").applyInPandas(account, PAID)


def _curves(signalled: DataFrame, paid: DataFrame, n_runs: int, settings: Settings, rows: int) -> DataFrame:
    """Equity after every bar, block by block: a trade is sent to the blocks from its entry up to the next one's."""
    last = signalled.groupBy("symbol").agg(F.max("_block").alias("_last"))
    trades = paid.where("kind = 'trade'").withColumn("_first", F.floor(F.col("entry_place") / rows)).join(last, "symbol")
    following = F.lead("_first").over(Window.partitionBy("symbol", "run").orderBy("entry_place"))
    trades = trades.withColumn("_upto", F.coalesce(following, F.col("_last")))
    sent = trades.withColumn("_block", F.explode(F.sequence("_first", "_upto"))).select("run", *KEYS, "direction", "qty", "entry_price", "entry_place", "exit_place", "cash_in", "cash_out")

    def curve(frame: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame(columns=["run", "symbol", "ts", "equity"])
        frame = frame.sort_values("_place")
        place, close, out = frame["_place"].to_numpy(), frame["close"].to_numpy(), []
        for run in range(n_runs):
            mine = own[own["run"] == run].sort_values("entry_place")
            equity = np.full(len(place), settings.capital)
            for t in mine.itertuples(index=False):
                held, after = (place >= t.entry_place) & (place < t.exit_place), place >= t.exit_place
                worth = close if t.direction == "long" else 2 * t.entry_price - close
                equity[held] = t.cash_in + t.qty * worth[held]
                equity[after] = t.cash_out
            out.append(pd.DataFrame({"run": run, "symbol": frame["symbol"].iat[0], "ts": frame["ts"].to_numpy(), "equity": equity}))
        return pd.concat(out)

    slim = signalled.select(*KEYS, "_place", "ts", "close")
    return slim.groupBy(*KEYS).cogroup(sent.groupBy(*KEYS)).applyInPandas(curve, "run int, symbol string, ts long, equity double")


def backtest_blocks(bars: DataFrame, runs: list[Run], seconds: int, settings: Settings = Settings(), rows: int = ROWS) -> DataFrame:
    """Trades and equity points of every run over every symbol, as ``backtest`` gives them, in blocks of ``rows`` bars.

    ``seconds`` is the usual distance of bars. All strategies must be in ``COLUMNAR``, and
    exit rules must not look at a position's size. Rounds run when this is called; their
    tables are in the shared folder. An empty table of bars gives no rows.
    """
    if not supports(runs):
        raise ValueError("a strategy has no columnar form; use backtest")
    runs = list({r.run_id: r for r in runs}.values())
    scratch = _Scratch(bars)
    signalled = scratch.keep(_signalled(bars, runs, settings, seconds, rows), "signals")
    table = settle(signalled, runs, settings, scratch.keep)
    paid = scratch.keep(_paid(table, settings), "trades")
    names = F.create_map(*[x for i, r in enumerate(runs) for x in (F.lit(i), F.lit(r.run_id))])
    columns = [c.split()[0] for c in EVENTS.split(", ")]
    refused = paid.where("kind = 'refused'").select("symbol", "run")
    trades = paid.where("kind = 'trade'")
    curves = _curves(signalled, paid, len(runs), settings, rows).withColumn("kind", F.lit("equity"))
    events = trades.select(*trades.columns[:-4]).unionByName(curves, allowMissingColumns=True).join(refused, ["symbol", "run"], "left_anti")
    events = events.withColumn("run_id", names[F.col("run")]).select(*columns)
    if refused.isEmpty():
        return events
    whole = backtest(bars.join(refused.select("symbol").distinct(), "symbol", "left_semi"), runs, settings)
    return events.unionByName(whole.join(refused.select("symbol", names[F.col("run")].alias("run_id")), ["symbol", "run_id"], "left_semi").select(*columns))
