"""The engine as one object: a bar store and what can be asked of it.

Methods take and return DataFrames; nothing runs until a result is written or read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.indicators import Spec, compute
from .operators import bars as B
from .operators import bricks, montecarlo, regimes, signals
from .operators.opencross import SurfaceConfig, surface
from .plans import backtest as P
from .plans import blockwise
from .plans import search as G
from .plans import validation as V
from .sources.exchange import ExchangeBars
from .sources.store import BarStore


class Engine:
    def __init__(self, spark: SparkSession, path: str, exchange: str = "local") -> None:
        self.spark, self.exchange, self.store = spark, exchange, BarStore(spark, path)

    def bars(self, symbol: str | None = None, timeframe: str = "1h", data_type: str = "ohlcv", start: int | None = None, stop: int | None = None, derive: bool = True) -> DataFrame:
        """Stored bars; if there are none of the timeframe, those built from the coarsest that divides it."""
        found = self.store.read(self.exchange, symbol, timeframe, data_type, start, stop)
        if not derive or not found.isEmpty():
            return found
        have = [r["timeframe"] for r in self.store.read(self.exchange, symbol, None, "ohlcv").select("timeframe").distinct().collect()]
        source = B.coarsest_source(have, timeframe)
        if source is None:
            raise LookupError(f"no bars that {timeframe} could be built from")
        return B.aggregate(self.store.read(self.exchange, symbol, source, "ohlcv", start, stop), B.TIMEFRAMES[timeframe])

    def derived(self, kind: str, symbol: str | None = None, timeframe: str = "1h", only: DataFrame | None = None, **options) -> DataFrame:
        """Heiken-Ashi, Renko (``size``) or ATR-Renko (``period``) bars; of the symbols of ``only``, if it is given."""
        base, seconds = self.bars(symbol, timeframe), B.TIMEFRAMES[timeframe]
        base = base if only is None else base.join(only, "symbol", "left_semi")
        if kind == "heikenashi":
            return bricks.heiken_ashi(base, seconds)
        if kind == "renko":
            return bricks.renko(base, options["size"], seconds)
        if kind == "atr_renko":
            return bricks.atr_renko(base, options.get("period", 14), seconds)
        raise ValueError(f"no bars of kind {kind}")

    def update(self, fresh: DataFrame, timeframe: str, dependents: list[str] = (), derived: dict[str, dict] | None = None) -> None:
        """Merge new bars, then rebuild the open and later bars of dependent timeframes, and
        the derived bars (kind and options) of the symbols that changed."""
        fresh = fresh.withColumn("symbol", B.sanitise_symbol(F.col("symbol")))
        self.store.merge(fresh, self.exchange, timeframe)
        for target in dependents:
            B.check_ratio(B.TIMEFRAMES[timeframe], B.TIMEFRAMES[target])
            stored = self.store.read(self.exchange, None, target, "ohlcv").select("symbol", "ts", "open", "high", "low", "close", "volume")
            self.store.merge(B.upsert_open_bar(stored, self.bars(None, timeframe), B.TIMEFRAMES[target], fresh), self.exchange, target)

        for kind, options in (derived or {}).items():
            changed = fresh.select("symbol").distinct()
            for frame in (timeframe, *dependents):
                self.store.write(self.derived(kind, None, frame, changed, **options), self.exchange, frame, kind)

    def download(self, adapter: str, symbols: list[str], timeframe: str, start: int, stop: int, limit: int = 1000) -> int:
        """Fetch what is missing of ``[start, stop]`` and merge it; gives the number of ranges fetched.

        Ranges are planned by Spark; each range of pages is a partition of the exchange
        source, so fetching runs on the executors. ``adapter`` is a dotted name.
        """
        self.spark.dataSource.register(ExchangeBars)
        names = [r["n"] for r in self.spark.createDataFrame([(s,) for s in symbols], "s string").select(B.sanitise_symbol(F.col("s")).alias("n")).collect()]
        have = self.store.read(self.exchange, None, timeframe, "ohlcv") if self.store.exists() else self.spark.createDataFrame([], "symbol string, ts long")
        known = {r["symbol"] for r in have.select("symbol").distinct().collect()}
        gaps = B.missing_ranges(have, B.TIMEFRAMES[timeframe], start, stop).collect() if known else []
        wanted = [(s, g["start"], g["stop"]) for s, n in zip(symbols, names, strict=True) for g in gaps if g["symbol"] == n]
        wanted += [(s, start, stop) for s, n in zip(symbols, names, strict=True) if n not in known]
        fetched = None
        for symbol, a, b in wanted:
            part = self.spark.read.format("exchange_bars").options(adapter=adapter, symbols=symbol, seconds=B.TIMEFRAMES[timeframe], start=a, stop=b, limit=limit).load()
            fetched = part if fetched is None else fetched.unionByName(part)
        if fetched is not None:
            (self.store.merge if known else self.store.write)(fetched, self.exchange, timeframe)
        return len(wanted)

    def indicators(self, specs: list[Spec], symbol: str | None = None, timeframe: str = "1h") -> DataFrame:
        return compute(self.bars(symbol, timeframe), specs, seconds=B.TIMEFRAMES[timeframe])

    def regime(self, symbol: str | None = None, timeframe: str = "1h", kind: str = "trend", **options) -> DataFrame:
        return {"trend": regimes.trend, "adx": regimes.adx, "volatility": regimes.volatility, "combined": regimes.combined}[kind](self.bars(symbol, timeframe), **options)

    def backtest(self, runs: list[P.Run], symbol: str | None = None, timeframe: str = "1h", execution: str | None = None, settings: P.Settings = P.Settings(), in_blocks: bool = False) -> DataFrame:
        """Trades and equity points; ``in_blocks`` deals each series to many tasks, which pays off for long ones."""
        base = self.bars(symbol, timeframe)
        if in_blocks and execution is None:
            return blockwise.backtest_blocks(base, runs, B.TIMEFRAMES[timeframe], settings)
        if execution is None:
            return P.backtest(base, runs, settings)
        fine = self.bars(symbol, execution)
        self.check_coverage(base, fine)
        return P.backtest_dual(base, fine, B.TIMEFRAMES[timeframe], runs, settings)

    @staticmethod
    def check_coverage(base: DataFrame, fine: DataFrame) -> None:
        """Execution bars must span the signal bars."""
        a, b = (x.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first() for x in (base, fine))
        if a["lo"] is not None and (b["lo"] is None or b["lo"] > a["lo"] or b["hi"] < a["hi"]):
            raise ValueError("the execution bars do not cover the signal bars")

    def optimise(self, strategy: str, sets: list[dict], symbol: str | None = None, timeframe: str = "1h", **options) -> DataFrame:
        return G.optimise(self.bars(symbol, timeframe), strategy, sets, seconds=B.TIMEFRAMES[timeframe], **options)

    def monte_carlo(self, trades: DataFrame, iterations: int = 1000, seed: int = 42, capital: float = 10_000.0) -> DataFrame:
        """Resampled figures of one run's trades, numbered in order of exit."""
        places = F.row_number().over(Window.orderBy("exit_ts", "entry_ts", "pnl")) - 1
        return montecarlo.summary(montecarlo.bootstrap(trades.select(places.cast("long").alias("place"), "pnl"), iterations, seed, capital))

    def evaluate(self, requests: DataFrame, timeframe: str = "1h") -> DataFrame:
        return signals.evaluate(requests, self.bars(None, timeframe))

    def opencross(self, symbol: str | None = None, config: SurfaceConfig = SurfaceConfig(), start: int | None = None, stop: int | None = None) -> DataFrame:
        bars = self.bars(symbol, "1m", start=start, stop=stop)
        return surface(V.with_volatility(bars, config.volatility_lookback) if config.volatility_lookback else bars, config)

    def validate(self, splits: V.Splits, symbol: str | None = None, config: SurfaceConfig = SurfaceConfig()) -> dict:
        return V.validate(self.bars(symbol, "1m"), splits, config)
