import datetime as dt
import json
import math
import os
import random

import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from barloom.operators import montecarlo, opencross, regimes, signals
from barloom.operators import statistics as S
from barloom.operators.orders import Account, Bar, Commission, MaxBars, Order, Position, Sizing, TrailingStop, risk_stake
from barloom.plans import backtest as P
from barloom.plans import search as G
from barloom.plans import validation as V
from barloom.plans.strategies import REGISTRY, parse_inputs
from barloom.sources import export

import barloom.registry as registry


def walk(n, seed=1):
    rng, p, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o, p = p, p * math.exp(rng.gauss(0, 0.01))
        out.append((o, max(o, p) * 1.002, min(o, p) * 0.998, p))
    return out


def test_surface_matches_brute_force(spark):
    data = walk(400)
    config = opencross.SurfaceConfig(20, 0.01, 5)
    got = {(r.bucket, r.minutes_remaining): (r.samples, r.crosses) for r in opencross.surface(make_bars(spark, data), config).collect()}
    want = {}
    for a in range(0, 400, 20):
        block = data[a : a + 20]
        start = block[0][0]
        for i in range(19):
            later = block[i + 1 :]
            close = block[i][3]
            d = close - start
            crossed = False if abs(d) < 1e-7 else min(r[2] for r in later) < start if d > 0 else max(r[1] for r in later) > start
            k = (math.floor(d / start / 0.01), 19 - i)
            s, c = want.get(k, (0, 0))
            want[k] = (s + 1, c + crossed)
    assert got == want
    assert sum(s for s, _ in got.values()) == 20 * 19


def test_flagship_entry(spark, sf_dir):
    assert registry.queries()["opencross_surface"](spark, sf_dir).count() > 0


def test_statistics_of_a_known_series(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 10)], "x double")
    r = S.series_metrics(df, "x").first()
    assert (r.q1, r.q2, r.q3, r["count"], r.range) == (3, 5, 7, 9, 8)
    assert r.variance == pytest.approx(60 / 9)


@pytest.mark.parametrize("share", [0.0, 0.33, 0.5, 0.7, 1.0])
def test_order_statistic(spark, share):
    rng = random.Random(8)
    values = [rng.choice([rng.gauss(0, 1), 0.5, 7.0]) for _ in range(501)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = S.order_statistic(df, "v", share, 16).first().cut
    assert got == sorted(values[:-1])[min(int(501 * share), 500)]
    assert S.order_statistic(df.where("false"), "v", share).first().cut is None


def test_drawdown_and_streaks(spark):
    c = spark.createDataFrame([("A", i, e) for i, e in enumerate([10000.0, 11000.0, 10500.0, 11100.0])], "symbol string, ts long, equity double")
    r = S.drawdown_summary(c, ("symbol",), "ts").first()
    assert (r.max_drawdown, r.max_drawdown_duration) == (500, 1)
    t = spark.createDataFrame([("A", i, float(p)) for i, p in enumerate([1, 2, -1, -1, -1, 0, 4])], "symbol string, k int, pnl double")
    s = S.streaks(t, ("symbol",), ["k"]).first()
    assert (s.max_consecutive_wins, s.max_consecutive_losses) == (2, 3)


def test_time_in_market_and_short_curves(spark):
    curve = [10000.0, 10000.0, 10500.0, 10500.0, 11000.0, 11000.0]
    c = spark.createDataFrame([("A", i, e) for i, e in enumerate(curve)], "symbol string, ts long, equity double")
    r = S.curve_ratios(c, ("symbol",), "ts", 252).first()
    assert r.time_in_market_percent == pytest.approx(40)
    assert (r.sharpe_ratio, r.sortino_ratio) == (0, 0)  # fewer than ten observations


def test_trade_statistics(spark):
    rows = [("A", "long", 1000.0, 0, 14400), ("A", "long", -200.0, 0, 28800), ("A", "short", 0.0, 0, 7200), ("A", "long", 5.0, 0, None)]
    t = spark.createDataFrame(rows, "symbol string, direction string, pnl double, entry_ts long, exit_ts long")
    r = S.trade_statistics(t, ("symbol",), 10000.0).first()
    assert (r.total_trades, r.winning_trades, r.losing_trades, r.profit_factor) == (3, 1, 1, 5.0)
    assert (r.median_trade_duration, r.min_trade_duration, r.max_trade_duration) == (14400, 7200, 28800)
    only = S.trade_statistics(t.where("pnl > 0"), ("symbol",), 10000.0).first()
    assert only.profit_factor == float("inf")


def test_stability_by_day(spark):
    df = spark.createDataFrame([(0, 0.05), (60, -0.02), (86400, -0.01)], "ts long, pnl double")
    assert S.daily_stability(df, "ts", "pnl").first().stability == 0.5


def signal(spark, **k):
    base = {"signal_id": "s", "symbol": "A", "direction": "long", "entry_price": 50000.0, "stop_loss": None, "take_profit": None, "trailing_percent": None, "high_water_mark": None, "entry_ts": 0}
    cols = "signal_id string, symbol string, direction string, entry_price double, stop_loss double, take_profit double, trailing_percent double, high_water_mark double, entry_ts long"
    return spark.createDataFrame([tuple((base | k).values())], cols)


def test_trailing_stop_signal(spark):
    # the trail is 5 % of the bar's close under the highest high so far, 51000
    bars = make_bars(spark, [(50000, 51000, 49000, 50500), (50500, 50600, 47000, 48000)])
    r = signals.evaluate(signal(spark, trailing_percent=5.0), bars).first()
    assert (r.status, r.exit_reason, r.exit_price) == ("loser", "trailing_stop", pytest.approx(48600.0))


def test_stop_comes_before_target(spark):
    bars = make_bars(spark, [(50000, 60000, 40000, 50000)])
    r = signals.evaluate(signal(spark, stop_loss=45000.0, take_profit=55000.0), bars).first()
    assert (r.status, r.exit_reason) == ("loser", "stop_loss")


def test_signals_do_not_depend_on_blocks(spark):
    """Blocks of a few bars, of many, and one of all: the same exits and marks."""
    b = make_bars(spark, walk(400, 8)).unionByName(make_bars(spark, walk(300, 9), "B"))
    rows = []
    for k, r in enumerate(b.where("ts % 1260 = 0").collect()):
        way = 1 if k % 2 else -1
        rows.append((f"s{k}", r.symbol, "long" if way > 0 else "short", r.close, r.close * (1 - 0.02 * way) if k % 3 else None, r.close * (1 + 0.03 * way) if k % 4 else None, [None, 0.5, 1.5][k % 3], r.close * 1.001 if k % 5 == 0 else None, r.ts))
    given = spark.createDataFrame(rows, "signal_id string, symbol string, direction string, entry_price double, stop_loss double, take_profit double, trailing_percent double, high_water_mark double, entry_ts long")
    key = lambda n: sorted(map(tuple, signals.evaluate(given, b, n).collect()))
    whole = key(10**7)
    assert {r[4] for r in whole} >= {"stop_loss", "trailing_stop"} and key(300) == whole and key(3600) == whole
    assert all(sorted(map(tuple, signals.evaluate(given, b, 60, levels).collect())) == whole for levels in (0, 1, 2))


def test_open_signal_keeps_its_mark(spark):
    bars = make_bars(spark, [(50000, 52000, 49900, 51000)])
    r = signals.evaluate(signal(spark, stop_loss=45000.0), bars).first()
    assert (r.status, r.high_water_mark, r.exit_price) == ("open", 52000, None)
    assert signals.evaluate(signal(spark, entry_ts=10**9), bars).first().status == "open"


def bar(i, o, h, low, c, **k):
    return Bar(i * 60, o, h, low, c, i, **k)


def test_account_charges_commission_once():
    a = Account(10000.0, Commission("percentage", 0.1))
    a.waiting.append(Order("long", 1000.0))
    a.fill(bar(0, 100, 101, 99, 100))
    assert a.cash == pytest.approx(8999.0)
    a.close(110, bar(1, 110, 110, 110, 110), "x")
    assert a.cash == pytest.approx(10000 + a.trades[0][6])


@pytest.mark.parametrize(
    ("order", "price"),
    [
        (Order("long", 1, "limit", limit=95), None),
        (Order("long", 1, "limit", limit=99.5), 99.5),
        (Order("short", 1, "limit", limit=100.5), 100.5),
        (Order("long", 1, "stop", trigger=100.5), 100.5),
        (Order("short", 1, "stop", trigger=98), None),
        (Order("long", 1, "stop_limit", trigger=100.5, limit=99.5), 99.5),
        (Order("long", 1), 100),
    ],
)
def test_fill_rules(order, price):
    assert order.fill_price(bar(0, 100, 101, 99, 100)) == price


def test_exit_rules_and_sizes():
    p = Position("long", 1, 100, 0, 0, 0, 90, 120, 110, 100)
    assert TrailingStop(percent=5)(p, bar(1, 100, 101, 99, 100)) == 105
    assert TrailingStop(atr_multiplier=2)(p, bar(1, 100, 109, 109, 100)) is None
    assert MaxBars(3)(p, bar(3, 1, 1, 1, 7)) == 7 and MaxBars(3)(p, bar(2, 1, 1, 1, 7)) is None
    assert risk_stake(10000, 1, 100, 95, 1) == pytest.approx(2000)
    assert risk_stake(10000, 1, 100, None, 1) == pytest.approx(2000)
    assert Sizing("kelly", win_rate=0.6, payoff=2).stake(1000, 1, None) == pytest.approx(200)
    assert Sizing("fixed_dollar", fixed=55).stake(1000, 1, None) == 55


def test_backtest_conserves_money(spark):
    b = make_bars(spark, walk(300, 3), step=3600)
    runs = [P.Run(n) for n in sorted(REGISTRY)] + [P.Run("sma_crossover", {"fastPeriod": 5, "slowPeriod": 20})]
    events = P.backtest(b, runs, P.Settings(commission=Commission("percentage", 0.1), sizing=Sizing(percent=50))).cache()
    final = {r.run_id: r.e for r in P.equity_of(events).groupBy("run_id").agg(F.max_by("equity", "ts").alias("e")).collect()}
    gained = {r.run_id: r.p for r in P.trades_of(events).groupBy("run_id").agg(F.sum("pnl").alias("p")).collect()}
    assert gained and len(final) == 9
    for run, equity in final.items():
        assert equity == pytest.approx(10000 + gained.get(run, 0.0))
    stats = P.statistics(events).collect()
    assert len(stats) == 9 and all(r.max_drawdown >= 0 for r in stats)
    # the figures of the grouped map are those of the events
    direct = {r.run_id: r.asDict() for r in P.evaluate(b, runs, P.Settings(commission=Commission("percentage", 0.1), sizing=Sizing(percent=50))).collect()}
    assert set(direct) == {r.run_id for r in stats}
    for r in stats:
        for name, value in r.asDict().items():
            own = direct[r.run_id][name]
            assert own == value or own == pytest.approx(value, rel=1e-9, abs=1e-9), (r.run_id, name, own, value)


def test_plans_of_searches(spark):
    """Bars are simulated once and shuffled once for each bucket of runs."""
    b = make_bars(spark, walk(60, 3), step=3600)
    sets = list(G.grid({"fastPeriod": G.Dimension(5, 15, 5, True), "slowPeriod": G.Dimension(20, 40, 10, True)}))
    for df in (G.optimise(b, "sma_crossover", sets), P.evaluate(b, [P.Run(n) for n in sorted(REGISTRY)])):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
    assert len(P._bucketed(b, [P.Run("sma_crossover", s) for s in sets])[1]) == 3


def test_sizing_by_a_function():
    assert Sizing(lambda equity, price, stop, atr: equity / 4).stake(1000, 1, None) == 250


def test_dual_timeframe(spark):
    fine = make_bars(spark, walk(400, 5), step=900)
    from barloom.operators.bars import aggregate

    t = P.trades_of(P.backtest_dual(aggregate(fine, 3600), fine, 3600, [P.Run("sma_crossover", {"fastPeriod": 5, "slowPeriod": 20})]))
    assert t.count() > 0
    assert t.where("exit_ts < entry_ts").count() == 0


def test_generators():
    space = {"a": G.Dimension(1, 3, 1, True), "b": G.Dimension(0, 0.5, 0.25)}
    sets = list(G.grid(space))
    assert len(sets) == 9 and sets[1] == {"a": 1, "b": 0.25}
    drawn = list(G.random_sets(space, 100))
    assert len({json.dumps(s) for s in drawn}) == len(drawn) <= 9
    g = G.Genetic(space, 10, seed=3)
    state = g.state()
    first = g.evolve([float(m["a"]) for m in g.members])
    h = G.Genetic(space, 10)
    h.restore(state)
    assert h.evolve([float(m["a"]) for m in h.members]) == first
    assert all(m["a"] in (1, 2, 3) for m in first)


def test_walk_forward_split():
    s = G.split_dates(dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    assert s.is_end % 86400 == 86399 and s.oos_start == s.is_end + 1
    with pytest.raises(ValueError):
        G.split_dates(dt.date(2024, 1, 1), dt.date(2024, 1, 2), 1.0)


def test_optimise_and_genetic(spark):
    b = make_bars(spark, walk(200, 7), step=3600)
    space = {"fastPeriod": G.Dimension(3, 9, 3, True), "slowPeriod": G.Dimension(15, 25, 10, True)}
    top = G.optimise(b, "sma_crossover", list(G.grid(space)), "total_return_percent", 3).collect()
    assert [r.score for r in top] == sorted((r.score for r in top), reverse=True)
    best, score = G.optimise_genetic(b, "sma_crossover", space, "total_return_percent", 4, 2)
    assert set(best) == set(space) and score <= top[0].score + 1e-9


def test_grade_is_capped():
    s = {"spearman": 0.9, "efficiency": 90, "robust_percent": 90, "tier": "excellent"}
    assert G.grade(s, None, -1)["points"] <= 19
    assert G.grade(s, 100.0, 10.0)["points"] <= 39
    assert G.grade(s, 5.0, 20.0)["stars"] == 5


def test_sensitivity(spark):
    rows = [({"a": float(a), "b": float(b)}, float(10 * a + b % 2)) for a in range(3) for b in range(4)]
    runs = spark.createDataFrame(rows, "params map<string,double>, score double")
    shares = {r.name: r.importance for r in G.importance(runs).collect()}
    assert shares["a"] > 95 and sum(shares.values()) == pytest.approx(100)
    assert G.score_surface(runs, "a", "b").count() == 12
    assert G.interactions(runs).first().interaction == pytest.approx(0, abs=1e-9)


def test_draws_reach_every_trade(spark):
    """More trades than 15 bits: places of all parts are drawn, evenly; the curve in blocks is the plain one."""
    n = 100_000
    places = spark.range(n).select(montecarlo.draw(F.lit(3), F.col("id"), F.lit(n), 42).cast("long").alias("p"))
    counts = [r["count"] for r in places.groupBy(F.floor(F.col("p") / 10_000)).count().collect()]
    assert len(counts) == 10 and min(counts) > 9_000 and max(counts) < 11_000
    t = spark.range(9000).select(F.col("id").alias("place"), ((F.col("id") * 7919) % 101 - 50).cast("double").alias("pnl"))
    values = {r.place: r.pnl for r in t.collect()}
    got = montecarlo.bootstrap(t, 2, 5, 1000.0).where("iteration = 1").first()
    drawn = [values[r.p] for r in spark.range(9000).select("id", montecarlo.draw(F.lit(1), F.col("id"), F.lit(9000), 5).cast("long").alias("p")).orderBy("id").collect()]
    equity = peak = 1000.0
    fall = 0.0
    for x in drawn:
        equity += x
        peak = max(peak, equity)
        fall = max(fall, peak - equity)
    assert got.total_return == pytest.approx(sum(drawn)) and got.max_drawdown == pytest.approx(fall)
    mean = sum(drawn) / 9000
    assert got.sharpe_ratio == pytest.approx(mean / (sum((x - mean) ** 2 for x in drawn) / 8999) ** 0.5)


def test_bootstrap(spark):
    t = spark.createDataFrame([(i, float(p)) for i, p in enumerate([5, -2, 3, 1])], "place long, pnl double")
    a, b = (montecarlo.bootstrap(t, 50, 7, 100.0).orderBy("iteration").collect() for _ in range(2))
    assert a == b and len(a) == 50
    assert all(-8 <= r.total_return <= 20 for r in a)
    assert montecarlo.bootstrap(t.where("false"), 5).count() == 0
    assert montecarlo.summary(montecarlo.bootstrap(t, 50)).count() == 6


def test_validation_suite(spark):
    b = make_bars(spark, walk(3000, 11))
    s = V.Splits(0, 1500 * 60 - 1, 1500 * 60, 3000 * 60)
    report = V.validate(b, s, opencross.SurfaceConfig(20, 0.01, 20), iterations=2, months=1)
    assert set(report["checks"]) == {"calibration", "stability", "regime", "baseline", "simulation"}
    assert "Overall" in export.report_markdown(report)
    with pytest.raises(ValueError):
        V.Splits(0, 10, 5, 20)
    real, fake = b, V.shuffled(b, 20, [3, 4])
    for seed in (3, 4):
        one = fake.where(F.col("seed") == seed)
        assert one.agg(F.sum("close")).first()[0] == pytest.approx(real.agg(F.sum("close")).first()[0])
        assert one.select("ts").exceptAll(real.select("ts")).isEmpty() and not one.select("ts", "close").exceptAll(real.select("ts", "close")).isEmpty()


def test_regimes(spark):
    b = make_bars(spark, walk(120, 2))
    out = regimes.combined(b, 30, 10).orderBy("ts").collect()
    assert out[0].regime is None and out[-1].regime.split("_", 1)[0] in ("bull", "bear")
    assert regimes.adx(b, 10, 20, 20).where("regime is not null").count() > 0


def test_inputs():
    assert parse_inputs(None) == {} and parse_inputs("{") is None and parse_inputs('{"a": 1}') == {"a": 1}
    with pytest.raises(KeyError):
        REGISTRY["sma_crossover"].resolve({"nope": 1})


def test_a_stopped_search_resumes(spark, tmp_path, monkeypatch):
    """Stopped after two generations and resumed, a search ends as one that was not stopped."""
    space = {"fastPeriod": G.Dimension(3, 12, 1, True), "slowPeriod": G.Dimension(14, 30, 2, True)}
    b = make_bars(spark, [100 + 10 * math.sin(i / 7) + 5 * math.sin(i / 3) for i in range(200)], step=3600)
    search = lambda journal, n: G.optimise_genetic(b, "sma_crossover", space, "total_return_percent", 5, n, seed=4, journal=journal)
    whole, parts = G.Journal(spark, str(tmp_path / "whole")), G.Journal(spark, str(tmp_path / "parts"))
    want = search(whole, 4)
    calls = []
    plain = G.evaluate
    monkeypatch.setattr(G, "evaluate", lambda *a, **k: calls.append(1) or plain(*a, **k))

    class Stopped(Exception):
        pass

    record = parts.record

    def stopping(told, entry):
        record(told, entry)
        if entry["generation"] == 2:
            raise Stopped

    monkeypatch.setattr(parts, "record", stopping)
    with pytest.raises(Stopped):
        search(parts, 4)
    monkeypatch.setattr(parts, "record", record)
    assert search(parts, 4) == want and len(calls) == 4
    files = [sorted(f for f in os.listdir(d) if f.endswith(".json") and not f.startswith(".")) for p in ("whole", "parts") for d in [tmp_path / p / os.listdir(tmp_path / p)[0]]]
    assert files[0] == files[1] and len(files[0]) == 4
    text = [[open(next((tmp_path / p).iterdir()) / f).read() for f in files[0]] for p in ("whole", "parts")]
    assert text[0] == text[1]
    assert search(parts, 4) == want and len(calls) == 4  # nothing is left to do
    other = G.optimise_genetic(b, "sma_crossover", space, "total_return_percent", 4, 1, seed=5, journal=parts)
    assert other[1] > float("-inf") and len(list((tmp_path / "parts").iterdir())) == 2
