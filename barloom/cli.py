"""A thin command line over the engine: ``python -m barloom.cli COMMAND ...``; every answer is one JSON object."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from .operators.opencross import SurfaceConfig
from .plans import backtest as P
from .plans import search as G
from .plans import validation as V
from .plans.strategies import REGISTRY, parse_inputs
from .sources import export

LIMIT = 1000


def _rows(df, limit: int = LIMIT) -> list[dict] | dict:
    """Rows as dictionaries; where more than the default limit are there, the answer says where it was cut."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    return {"rows": rows[:limit], "cut_at": limit} if limit == LIMIT and len(rows) > limit else rows[:limit]


def _ledger(e, a):
    from .plans.runs import Ledger

    return Ledger(e.spark, a.ledger or f"{a.store}_runs")


def _kept(e, a, kind: str, answer):
    """The answer, saved as a run of the ledger if that was asked for."""
    if a.save:
        ledger = _ledger(e, a)
        run = ledger.start(kind, a.strategy, [a.symbol] if a.symbol else [], {"timeframe": a.timeframe, "objective": a.objective, "params": a.params, "method": a.method, "iterations": a.iterations, "seed": a.seed})
        ledger.finish(run, "completed", {"answer": answer})
        return {"run_id": run, "answer": answer}
    return answer


def runs(e, a):
    return _rows(_ledger(e, a).listed(None, None, a.top).drop("statistics"))


def run_show(e, a):
    """A saved run, with its answer; written to a file if ``--output`` is given."""
    from pyspark.sql import functions as F

    found = _ledger(e, a).latest().where(F.col("run_id") == a.run).first()
    if found is None:
        raise LookupError(f"no run {a.run}")
    row = found.asDict() | {"statistics": json.loads(found["statistics"] or "null")}
    if a.output:
        with open(a.output, "w", encoding="utf-8") as out:
            json.dump(row, out)
        return {"written": a.output}
    return row


def backtest_debug(e, a):
    """What a backtest would read: records, and the first and last bar of each symbol."""
    from .operators.bars import catalogue

    return _rows(catalogue(e.bars(a.symbol, a.timeframe)))


def data_repair(e, a):
    return _rows(e.store.repair(a.dry_run))


def _space(a):
    return G.space_of(a.strategy, {k: tuple(v) for k, v in json.loads(a.params).items()} if a.params else None)


def _sets(a) -> list[dict]:
    space = _space(a)
    return list(G.grid(space)) if a.method == "grid" else list(G.random_sets(space, a.iterations, a.seed))


def _day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def _at(text: str, last: bool = False) -> int:
    """Epoch seconds of a day or a moment; a day as an end is its last second."""
    if len(text) > 10:
        return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC).timestamp())
    return int(dt.datetime.combine(_day(text), dt.time(), dt.UTC).timestamp()) + 86399 * last


def data_list(e, a):
    return _rows(e.store.catalogue())


def data_export(e, a):
    export.write(e.bars(a.symbol, a.timeframe), a.output, a.format)
    return {"written": a.output}


def data_aggregate(e, a):
    e.store.write(e.bars(a.symbol, a.timeframe), e.exchange, a.timeframe)
    return _rows(e.store.catalogue())


def data_delete(e, a):
    e.store.delete(e.exchange, a.symbol, a.timeframe)
    return {"deleted": [a.symbol, a.timeframe]}


def derive(e, a):
    df = e.derived(a.kind, a.symbol, a.timeframe, **({"size": a.size} if a.kind == "renko" else {"period": a.period}))
    e.store.write(df.dropDuplicates(["symbol", "ts"]) if a.kind == "heikenashi" else df, e.exchange, a.timeframe, a.kind)
    return _rows(e.store.catalogue())


def strategies(e, a):
    return {n: {k: vars(p) for k, p in s.parameters.items()} for n, s in sorted(REGISTRY.items())}


def backtest(e, a):
    inputs = parse_inputs(a.inputs)
    if inputs is None:
        raise ValueError("inputs are not a JSON object")
    events = e.backtest([P.Run(a.strategy, inputs)], a.symbol, a.timeframe, a.execution)
    return {"statistics": _rows(P.statistics(events)), "trades": _rows(export.trades_table(P.trades_of(events)), a.trades)}


def optimise(e, a):
    return _kept(e, a, "optimisation", _rows(export.ranked_runs(e.optimise(a.strategy, _sets(a), a.symbol, a.timeframe, goal=a.objective, top=a.top), a.top)))


def walk_forward(e, a):
    split = G.split_dates(_day(a.start), _day(a.end), a.split)
    results = G.walk_forward(e.bars(a.symbol, a.timeframe), a.strategy, _sets(a), split, a.objective, a.top)
    summary = G.walk_forward_summary(results).first().asDict()
    return _kept(e, a, "walk_forward", {"results": _rows(results, a.top), "summary": summary, "conclusion": G.conclusion(summary)})


def monte_carlo(e, a):
    events = e.backtest([P.Run(a.strategy, parse_inputs(a.inputs) or {})], a.symbol, a.timeframe)
    return _rows(e.monte_carlo(P.trades_of(events), a.iterations, a.seed))


def opencross(e, a):
    config = SurfaceConfig(a.block, a.bucket, a.min_samples, a.symmetric, a.lookback if a.normalised else None)
    return _rows(export.surface_rows(e.opencross(a.symbol, config, _at(a.start) if a.start else None, _at(a.end, True) if a.end else None), a.bucket))


def data_import(e, a):
    return {"ranges": e.download(a.adapter, a.symbol.split(","), a.timeframe, _at(a.start), _at(a.end, True))}


def data_missing(e, a):
    return _rows(e.store.missing(e.exchange, a.timeframe, _at(a.start), _at(a.end, True)))


def data_check(e, a):
    from .operators.bars import TIMEFRAMES, irregularities

    return _rows(irregularities(e.bars(a.symbol, a.timeframe, derive=False), TIMEFRAMES[a.timeframe]))


def sensitivity(e, a):
    from pyspark.sql import functions as F

    stats = e.optimise(a.strategy, _sets(a), a.symbol, a.timeframe, goal=a.objective, top=a.iterations)
    runs = stats.select(F.from_json(F.regexp_replace("run_id", "^[^:]+:", ""), "map<string,double>").alias("params"), "score")
    return {"importance": _rows(G.importance(runs)), "interactions": _rows(G.interactions(runs))}


def portfolio(e, a):
    bars = e.bars(None, a.timeframe)
    n = bars.select("symbol").distinct().count()
    return _rows(G.portfolio(G.evaluate(bars, a.strategy, _sets(a)), n).orderBy("score", ascending=False), a.top)


def signal_evaluate(e, a):
    """Signals from a JSON-lines file."""
    cols = "signal_id string, symbol string, direction string, entry_price double, stop_loss double, take_profit double, trailing_percent double, high_water_mark double, entry_ts long"
    return _rows(e.evaluate(e.spark.read.schema(cols).json(a.inputs), a.timeframe))


def validate(e, a):
    splits = V.Splits(_at(a.train_start), _at(a.train_end, True), _at(a.test_start), _at(a.test_end, True))
    return e.validate(splits, a.symbol, SurfaceConfig(a.block, a.bucket, a.min_samples))


COMMANDS = {
    "data-list": data_list, "data-export": data_export, "data-aggregate": data_aggregate, "data-delete": data_delete, "derive": derive, "strategies": strategies, "backtest": backtest,
    "optimise": optimise, "walk-forward": walk_forward, "monte-carlo": monte_carlo, "opencross": opencross, "opencross-validate": validate,
    "data-import": data_import, "data-missing": data_missing, "data-check": data_check, "sensitivity": sensitivity, "portfolio": portfolio, "signal-evaluate": signal_evaluate,
    "runs": runs, "run-show": run_show, "backtest-debug": backtest_debug, "data-repair": data_repair,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barloom")
    p.add_argument("command", choices=[*COMMANDS, "schema"])
    add = p.add_argument
    add("--store", default="bars")
    add("--exchange", default="local")
    for name in ("symbol", "execution", "inputs", "params", "start", "end", "output", "train-start", "train-end", "test-start", "test-end", "adapter", "ledger", "run"):
        add(f"--{name}")
    add("--strategy", choices=sorted(REGISTRY), default="sma_crossover")
    add("--timeframe", default="1h")
    add("--format", choices=["csv", "json", "parquet"], default="csv")
    add("--kind", choices=["heikenashi", "renko", "atr_renko"], default="heikenashi")
    add("--method", choices=["grid", "random"], default="random")
    add("--objective", default="sharpe_ratio")
    for name, default in (("iterations", 500), ("seed", 0), ("top", 50), ("trades", 5), ("period", 14), ("block", 15), ("min-samples", 100), ("lookback", 60)):
        add(f"--{name}", type=int, default=default)
    for name, default in (("size", 1.0), ("split", 0.75), ("bucket", 0.001)):
        add(f"--{name}", type=float, default=default)
    add("--symmetric", action="store_true")
    add("--normalised", action="store_true")
    add("--save", action="store_true")
    add("--dry-run", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "schema":
        print(export.envelope("schema", {x.dest: {"default": x.default, "choices": list(x.choices) if x.choices else None} for x in parser()._actions if x.dest != "help"}))
        return 0
    if a.command == "strategies":
        print(export.envelope(a.command, strategies(None, a)))
        return 0
    from pyspark.sql import SparkSession

    from .engine import Engine

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(export.envelope(a.command, COMMANDS[a.command](Engine(spark, a.store, a.exchange), a)))
        return 0
    except (ValueError, LookupError) as error:
        print(export.envelope(a.command, error=str(error)))
        return 1


if __name__ == "__main__":
    sys.exit(main())
