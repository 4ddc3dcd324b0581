"""Exchange bars as a Spark data source, read in parallel by time ranges.

``spark.read.format("exchange_bars")`` with an adapter that fetches one page; a page is
a bounded number of bars, and each range of pages is a partition.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "symbol string, ts long, open double, high double, low double, close double, volume double"


class Adapter(Protocol):
    """What an exchange must offer."""

    def fetch(self, symbol: str, timeframe_seconds: int, since: int, limit: int) -> list[tuple]:
        """Up to ``limit`` bars ``(ts, open, high, low, close, volume)`` from ``since`` on, in order."""


class Range(InputPartition):
    def __init__(self, symbol: str, start: int, stop: int) -> None:
        self.symbol, self.start, self.stop = symbol, start, stop


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.seconds, self.limit = int(options["seconds"]), int(options.get("limit", 1000))

    def partitions(self) -> list[Range]:
        start, stop = int(self.options["start"]), int(self.options["stop"])
        span = self.seconds * self.limit * int(self.options.get("pages", 10))
        return [Range(s, a, min(a + span - 1, stop)) for s in self.options["symbols"].split(",") for a in range(start, stop + 1, span)]

    def read(self, part: Range) -> Iterator[tuple]:
        module, name = self.options["adapter"].rsplit(".", 1)
        adapter: Adapter = getattr(importlib.import_module(module), name)()
        since = part.start
        while since <= part.stop:
            page = adapter.fetch(part.symbol, self.seconds, since, self.limit)
            for row in page:
                if part.start <= row[0] <= part.stop:
                    yield (part.symbol, int(row[0]), *map(float, row[1:6]))
            if not page or page[-1][0] < since:
                return
            since = page[-1][0] + self.seconds


class ExchangeBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "exchange_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


class RandomWalk:
    """An adapter without a network: a walk that depends on symbol and time alone."""

    def fetch(self, symbol: str, timeframe_seconds: int, since: int, limit: int) -> list[tuple]:
        import math

        start = -(-since // timeframe_seconds) * timeframe_seconds
        out = []
        for i in range(limit):
            t = start + i * timeframe_seconds
            base = 100 + 10 * math.sin(t / 86400 + len(symbol)) + 3 * math.sin(t / 5000)
            out.append((t, base, base + 1, base - 1, base + 0.5 * math.sin(t / 700), 10.0))
        return out


def active_markets(markets: DataFrame, futures: bool = False) -> DataFrame:
    """Symbols ``base/quote`` of active markets, distinct and in order."""
    kind = F.col("type").isin("swap", "future") if futures else F.col("type") == "spot"
    return markets.where(F.col("active") & kind).select(F.concat_ws("/", "base", "quote").alias("symbol")).distinct().orderBy("symbol")
