"""Bootstrap resampling of trade results."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .statistics import profit_factor

# A linear congruential step that any SQL engine can do in 64 bits.
_A, _C, _M = 1103515245, 12345, 2147483648


#: Draws of an iteration whose curve one task follows.
BLOCK = 4096
#: Trades that are sent to all tasks (8 MB); more are joined with the draws.
HELD = 1 << 20


def draw(iteration: Column, k: Column, n: Column, seed: int) -> Column:
    """An index below ``n`` for draw ``k`` of an iteration: the high bits of three congruential steps, 45 in all."""
    step = lambda x: (x * _A + _C) % _M
    high = lambda x: F.floor(x / 65536)
    a = step(step((iteration * 7919 + k * 104729 + seed * 31 + 17) % _M))
    b = step(a)
    return ((high(a) * 32768 + high(b)) * 32768 + high(step(b))) % n


def bootstrap(pnl: DataFrame, iterations: int = 1000, seed: int = 42, capital: float = 10_000.0) -> DataFrame:
    """Figures of each iteration: as many trades as there are, drawn with replacement.

    ``pnl``: ``place`` (from 0, without gaps) and ``pnl``. Draws are a range over
    iterations and places and joined with the trades by place. An iteration's curve is
    followed in blocks of draws: each has its sum, its peak, its trough and its deepest
    fall, and the blocks, few to an iteration, are put together. Without trades there are
    no rows.
    """
    spark = pnl.sparkSession
    n = pnl.count()
    if 0 < n <= HELD:
        return _figures(_drawn_in_tasks(pnl, n, iterations, seed), capital)
    draws = spark.range(iterations * n).select(F.floor(F.col("id") / max(n, 1)).alias("iteration"), (F.col("id") % max(n, 1)).alias("k"), F.lit(n).alias("n"))
    drawn = draws.withColumn("place", draw(F.col("iteration"), F.col("k"), F.col("n"), seed).cast("long")).join(pnl, "place")
    keys = ["iteration", "block"]
    w = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    p = F.col("pnl")
    inside = drawn.withColumn("block", F.floor(F.col("k") / BLOCK)).withColumn("run", F.sum("pnl").over(w)).withColumn("top", F.max("run").over(w))
    blocks = inside.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(p).alias("sum"), F.var_pop(p).alias("var"), F.sum((p > 0).cast("long")).alias("wins"),
        F.sum(F.when(p > 0, p).otherwise(0.0)).alias("gain"), F.sum(F.when(p < 0, p).otherwise(0.0)).alias("loss"),
        F.max("top").alias("peak"), F.min("run").alias("trough"), F.max(F.col("top") - F.col("run")).alias("fall"),
    )
    return _figures(blocks, capital)


BLOCKS = "iteration long, block long, n long, sum double, var double, wins long, gain double, loss double, peak double, trough double, fall double"


def _drawn_in_tasks(pnl: DataFrame, n: int, iterations: int, seed: int) -> DataFrame:
    """The blocks of all iterations, each drawn and followed where it is asked for: the trades are sent along, no draw is shuffled."""
    spark = pnl.sparkSession
    rows = pnl.select(F.col("place").cast("long"), F.col("pnl").cast("double")).toPandas()  # at most HELD rows
    held = np.empty(n)
    held[rows["place"].to_numpy()] = rows["pnl"].to_numpy()
    shared, per = spark.sparkContext.broadcast(held), -(-n // BLOCK)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trades = shared.value
        step = lambda x: (x * _A + _C) % _M
        for batch in batches:
            out = []
            for i in batch.column(0).to_numpy():
                iteration, block = int(i) // per, int(i) % per
                k = np.arange(block * BLOCK, min((block + 1) * BLOCK, n), dtype=np.int64)
                a = step(step((iteration * 7919 + k * 104729 + seed * 31 + 17) % _M))
                b = step(a)
                p = trades[((a // 65536 * 32768 + b // 65536) * 32768 + step(b) // 65536) % n]
                run = np.cumsum(p)
                top = np.maximum.accumulate(run)
                out.append((iteration, block, len(p), run[-1], p.var(), int((p > 0).sum()), p[p > 0].sum(), p[p < 0].sum(), top[-1], run.min(), (top - run).max()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    tasks = min(iterations * per, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, iterations * per, 1, tasks).mapInArrow(follow, BLOCKS)


def _figures(blocks: DataFrame, capital: float) -> DataFrame:
    """Figures of iterations from their blocks."""
    before = Window.partitionBy("iteration").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("iteration")
    base = blocks.withColumn("base", capital + F.coalesce(F.sum("sum").over(before), F.lit(0.0))).withColumn("mean", F.sum("sum").over(whole) / F.sum("n").over(whole))
    base = base.withColumn("peak_before", F.greatest(F.lit(float(capital)), F.max(F.col("base") + F.col("peak")).over(before)))
    total, count = F.sum("sum"), F.sum("n")
    spread = F.sum(F.col("n") * (F.col("var") + F.pow(F.col("sum") / F.col("n") - F.col("mean"), 2)))
    sd = F.when(count > 1, F.sqrt(spread / (count - 1)))
    return base.groupBy("iteration").agg(
        total.alias("total_return"),
        (total / capital * 100).alias("total_return_percent"),
        (F.sum("wins") / count).alias("win_rate"),
        profit_factor(F.sum("gain"), F.sum("loss")).alias("profit_factor"),
        F.max(F.greatest("fall", F.col("peak_before") - F.col("base") - F.col("trough"))).alias("max_drawdown"),
        F.when(sd > 0, total / count / sd).otherwise(0.0).alias("sharpe_ratio"),
    )


METRICS = ("total_return", "total_return_percent", "win_rate", "profit_factor", "max_drawdown", "sharpe_ratio")


def summary(runs: DataFrame) -> DataFrame:
    """Percentiles of each figure, the chance that it is negative (under 1 for the profit factor), and whether it is significant."""
    stacked = runs.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x")).select("x.*")
    q = F.percentile("v", F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    bad = F.avg(F.when(F.col("metric") == "profit_factor", F.col("v") < 1).otherwise(F.col("v") < 0).cast("double"))
    out = stacked.groupBy("metric").agg(q.alias("q"), bad.alias("p_negative"))
    cols = [F.col("q")[i].alias(n) for i, n in enumerate(("p5", "p25", "p50", "p75", "p95"))]
    return out.select("metric", *cols, "p_negative").withColumn("significant", (F.col("p_negative") < 0.05) & (F.col("p5") > 0))


def interpret(row: dict, trades: int) -> list[str]:
    """A summary row of the return percent, in words."""
    out = ["fewer than 30 trades: take the figures with care"] if trades < 30 else []
    risk = row["p_negative"] * 100
    out.append("no loss in any draw" if risk == 0 else "losses are rare" if risk < 5 else "losses are possible" if risk < 20 else "losses are likely")
    width = row["p95"] - row["p5"]
    out.append("the spread is tight" if width < 2 else "the spread is wide" if width > 5 else "the spread is moderate")
    out.append("the median gain is small" if row["p50"] < 1 else "the median gain is meaningful" if row["p50"] >= 5 else "the median gain is moderate")
    return out
