import json
from dataclasses import replace

import numpy as np
import pytest

from barloom.operators.orders import Commission, MaxBars, Sizing, TrailingStop, condition_exit, static_stop, static_target
from barloom.plans import blockwise
from barloom.plans.backtest import Run, Settings, backtest, trades_of
from barloom.plans.strategies import REGISTRY

RUNS = [Run(n) for n in sorted(REGISTRY)] + [Run("sma_crossover", {"fastPeriod": 5, "slowPeriod": 20}), Run("rsi_reversal", {"rsiPeriod": 5, "oversoldThreshold": 40, "overboughtThreshold": 60}), Run("bb_reversal", {"period": 10, "stdDev": 1.0})]


def walk(spark, n=700, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for symbol, scale in (("A", 0.02), ("B", 0.004)):
        price = 100.0
        for i in range(n if symbol == "A" else n // 2):
            o, price = price, price * float(np.exp(rng.normal() * scale))
            rows.append((symbol, i * 3600 + int(rng.integers(0, 900)), o, max(o, price) * 1.002, min(o, price) * 0.998, price, 1.0))
    return spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double")


def events(df):
    return {(r.run_id, r.symbol, r.kind, r.ts, r.entry_ts): r for r in df.collect()}


def same(one, many):
    assert one.keys() == many.keys()
    for k, r in one.items():
        for name, value in r.asDict().items():
            other = many[k][name]
            assert (value == other) or (isinstance(value, float) and other == pytest.approx(value, rel=1e-9, abs=1e-9)), (k, name, value, other)


RULES = (("stop_loss", static_stop), ("trail", TrailingStop(percent=4.0)), ("take_profit", static_target), ("condition", condition_exit), ("age", MaxBars(90)))


@pytest.mark.parametrize(
    ("rows", "settings"),
    [(100, Settings()), (257, replace(Settings(), direction="short", commission=Commission("percentage", 0.1, 1.0))), (160, replace(Settings(), sizing=Sizing("risk_based", percent=0.5), rules=RULES, commission=Commission("fixed", 2.0)))],
)
def test_blocks_equal_the_whole_series(spark, rows, settings):
    b = walk(spark)
    one = events(backtest(b, RUNS, settings))
    same(one, events(blockwise.backtest_blocks(b, RUNS, 3600, settings, rows)))
    assert sum(k[2] == "trade" for k in one) > 60


def test_positions_that_span_blocks(spark):
    """Slow strategies hold positions over several blocks; only blocks that begin otherwise than assumed are run again."""
    b, runs = walk(spark, 900), [Run("sma_crossover", {"fastPeriod": 5, "slowPeriod": 20, "stopLossPercent": 20, "takeProfitPercent": 50})]
    settings = replace(Settings(), rules=(("stop_loss", static_stop), ("take_profit", static_target)))
    one = events(backtest(b, runs, settings))
    held = [r.bars_held for k, r in one.items() if k[2] == "trade"]
    assert max(held) > 20
    same(one, events(blockwise.backtest_blocks(b, runs, 3600, settings, 70)))


def test_trades_that_cannot_be_paid(spark):
    """Where an order is refused the run is simulated from end to end."""
    settings = replace(Settings(), sizing=Sizing("fixed_dollar", fixed=9_990.0))
    b = walk(spark)
    one = events(backtest(b, RUNS[:4], settings))
    same(one, events(blockwise.backtest_blocks(b, RUNS[:4], 3600, settings, 120)))


def test_blocks_are_groups(spark):
    """One series is as many groups as it has blocks, and each begins as the one before left."""
    b, runs = walk(spark, 500).where("symbol = 'A'"), RUNS[:3]
    scratch = blockwise._Scratch(b)
    signalled = scratch.keep(blockwise._signalled(b, runs, Settings(), 3600, 100), "signals")
    table = blockwise.settle(signalled, runs, Settings(), scratch.keep).orderBy("run", "_block").collect()
    assert len(table) == 5 * len(runs)
    for a, z in zip(table, table[1:], strict=False):
        if a.run == z.run:
            assert json.loads(a.ending)["state"] == z.entry


def test_no_bars(spark):
    assert blockwise.backtest_blocks(walk(spark).where("false"), RUNS[:2], 3600).count() == 0
    assert trades_of(backtest(walk(spark).where("false"), RUNS[:2])).count() == 0
