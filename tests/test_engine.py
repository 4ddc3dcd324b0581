import json

import pytest
from conftest import make_bars
from test_analysis import walk

from barloom import cli
from barloom.engine import Engine
from barloom.plans import backtest as P
from barloom.plans.runs import Ledger


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store") / "bars"))
    e.store.write(make_bars(spark, walk(2000), "A", step=60), "local", "1m")
    return e


def test_derives_missing_timeframes(engine):
    assert engine.bars("A", "1h").count() == 34
    with pytest.raises(LookupError):
        engine.bars("A", "1s")


def test_cascade_equals_a_full_rebuild(spark, engine):
    engine.store.write(engine.bars("A", "15m"), "local", "15m")
    fresh = make_bars(spark, walk(50, 9), "A", step=60, start=2000 * 60 - 600)
    engine.update(fresh, "1m", ["15m"])
    from barloom.operators.bars import aggregate

    keys = ["symbol", "ts", "open", "high", "low", "close", "volume"]
    want = aggregate(engine.store.read("local", "A", "1m"), 900).select(*keys)
    got = engine.store.read("local", "A", "15m").select(*keys)
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_derived_bars_follow_an_update(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "bars"))
    e.store.write(make_bars(spark, walk(60), "A", step=60).unionByName(make_bars(spark, walk(40, 4), "B", step=60)), "local", "1m")
    e.update(make_bars(spark, walk(20, 5), "A", step=60, start=3600), "1m", derived={"heikenashi": {}, "renko": {"size": 0.5}})
    assert e.store.read("local", "A", "1m", "heikenashi").count() == 80 and e.store.read("local", "B", "1m", "heikenashi").count() == 0
    assert e.store.read("local", "A", "1m", "renko").count() == e.derived("renko", "A", "1m", size=0.5).count() > 0


def test_repair_of_the_catalogue(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "bars"))
    e.store.write(make_bars(spark, walk(30), "A", step=60), "local", "1m")
    assert e.store.save_catalogue().count() == 1 and e.store.repair().count() == 0
    e.store.write(make_bars(spark, walk(20), "A", step=60).unionByName(make_bars(spark, walk(5), "B", step=60)), "local", "1m")
    for dry in (True, False):
        assert {(r.symbol, r.saved, r.records) for r in e.store.repair(dry).collect()} == {("A", 30, 20), ("B", None, 5)}
    assert e.store.repair().count() == 0


def test_saved_runs(spark, engine, capsys):
    base = ["--store", engine.store.path, "--symbol", "A", "--timeframe", "15m"]
    small = ["--params", '{"fastPeriod": [5, 10, 5], "slowPeriod": [20, 20, 10]}', "--method", "grid"]

    def answer(*args):
        assert cli.main([*args, *base]) == 0
        return json.loads(capsys.readouterr().out)["data"]

    saved = answer("optimise", *small, "--save")
    assert [r["run_id"] for r in answer("runs")] == [saved["run_id"]]
    shown = answer("run-show", "--run", saved["run_id"])
    assert shown["statistics"]["answer"] == saved["answer"] and shown["status"] == "completed"
    assert answer("backtest-debug")[0]["records"] > 100


def test_derived_bars_and_dual_backtest(engine):
    assert engine.derived("heikenashi", "A", "1h").count() == engine.bars("A", "1h").count()
    assert engine.derived("renko", "A", "1h", size=0.5).count() > 0
    assert engine.backtest([P.Run("sma_crossover", {"fastPeriod": 5, "slowPeriod": 20})], "A", "15m", "1m").count() > 0
    with pytest.raises(ValueError):
        Engine.check_coverage(engine.bars("A", "1h"), engine.bars("A", "1m").where("ts > 600"))


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "runs"))
    run = ledger.start("backtest", "s", ["B", "A"], {"x": 1, "y": 2})
    assert ledger.same("backtest", "s", ["A", "B"], {"y": 2, "x": 1}).count() == 0
    ledger.finish(run, statistics={"n": 1})
    assert ledger.same("backtest", "s", ["A", "B"], {"y": 2, "x": 1}).first().run_id == run
    assert ledger.same("backtest", "s", ["A"], {"y": 2, "x": 1}).count() == 0
    assert ledger.listed(status="completed").count() == 1 and ledger.listed(status="running").count() == 0


def test_command_line(engine, capsys):
    assert cli.main(["strategies"]) == 0
    assert len(json.loads(capsys.readouterr().out)["data"]) == 8
    assert cli.main(["data-list", "--store", engine.store.path]) == 0
    assert json.loads(capsys.readouterr().out)["success"]
    assert cli.main(["opencross", "--store", engine.store.path, "--symbol", "A", "--min-samples", "5"]) == 0
    assert json.loads(capsys.readouterr().out)["data"]
    assert cli.main(["backtest", "--store", engine.store.path, "--symbol", "A", "--inputs", "{"]) == 1
    assert json.loads(capsys.readouterr().out)["error"]


def test_download_fetches_only_what_is_missing(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "bars"))
    walk_ = "barloom.sources.exchange.RandomWalk"
    assert e.download(walk_, ["a/b"], "1m", 0, 5999, 20) == 1
    assert e.store.read("local", "A_B", "1m").count() == 100
    assert e.download(walk_, ["a/b"], "1m", 0, 5999, 20) == 0
    assert e.download(walk_, ["a/b"], "1m", 0, 8999, 20) == 1
    assert e.store.read("local", "A_B", "1m").count() == 150
    assert e.store.missing("local", "1m", 0, 8999).count() == 0


def test_kinds():
    from barloom.operators.bricks import resolve_kind

    assert resolve_kind("renko", period=14) == ("atr_renko", {"period": 14})
    assert resolve_kind("renko", 2.0) == ("renko", {"size": 2.0})
    for bad in (("renko",), ("atr_renko",), ("nope",)):
        with pytest.raises(ValueError):
            resolve_kind(*bad)


def test_typed_means(spark):
    from barloom.functions import indicators as I
    from barloom.functions.indicators import Spec

    b = make_bars(spark, walk(60))
    specs = [Spec(n, {"ma_type": t}, f"{n}{t}") for n in ("apo", "ppo", "bbands", "stoch") for t in (0, 1, 2)]
    out = I.compute(b, specs).orderBy("ts").collect()
    for spec in specs:
        columns = [c for c in out[0].asDict() if c == spec.prefix or c.startswith(f"{spec.prefix}_")]
        assert columns and all(out[-1][c] is not None and out[0][c] is None for c in columns)
