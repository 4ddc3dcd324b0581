"""Statistics of series, returns, trades and equity curves, as aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BARS_PER_YEAR = 252
RISK_FREE = 0.02
DAY = 86400


def correlation(a: Column | str, b: Column | str, over=None) -> Column:
    """Pearson correlation; null where either side does not vary."""
    parts = F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)
    cov, x, y = parts if over is None else (p.over(over) for p in parts)
    return F.when((x > 0) & (y > 0), cov / (x * y))


def order_statistic(df: DataFrame, column: str, share: float, buckets: int = 4096) -> DataFrame:
    """One row ``cut``: the value of rank ``floor(n * share)`` from 0, without interpolation.

    Counts of equal-width buckets tell which one holds the rank; only its values are
    then put in order, so no task sorts them all.
    """
    c = F.col(column)
    bounds = df.agg(F.min(c).alias("_lo"), F.max(c).alias("_hi"), F.count(c).alias("_n"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / buckets)
    placed = df.where(c.isNotNull()).join(F.broadcast(bounds), F.col("_n") > 0).withColumn("_b", F.coalesce(F.floor((c - F.col("_lo")) / width), F.lit(0)))
    counts = placed.groupBy("_b").agg(F.count("*").alias("_k"), F.first("_n").alias("_n"))
    upto = F.sum("_k").over(Window.orderBy("_b"))
    rank = F.least(F.floor(F.col("_n") * share), F.col("_n") - 1)
    chosen = counts.withColumn("_upto", upto).withColumn("_rest", rank - (F.col("_upto") - F.col("_k"))).where("_rest >= 0 and _rest < _k").select("_b", "_rest")
    inside = placed.select(c.alias("_v"), "_b").join(F.broadcast(chosen), "_b").groupBy("_v").agg(F.count("*").alias("_t"), F.first("_rest").alias("_rest"))
    return inside.withColumn("_upto", F.sum("_t").over(Window.orderBy("_v"))).where("_upto > _rest").agg(F.min("_v").alias("cut"))


def bars_per_year(seconds: int) -> int:
    return round(31536000 / seconds)


def series_metrics(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, extremes, mean, population spread, quartiles (interpolated), skewness and excess kurtosis."""
    c = F.col(column)
    q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*keys).agg(F.count(c).alias("count"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std_dev"), F.var_pop(c).alias("variance"), F.sum(c).alias("sum"), q.alias("_q"), F.skewness(c).alias("_s"), F.kurtosis(c).alias("_k"))
    known = lambda x, n: F.when((F.col("count") >= n) & (F.col("variance") > 0), F.col(x)).otherwise(0.0)
    return out.select(*keys, "count", "min", "max", "mean", F.col("_q")[1].alias("median"), "std_dev", "variance", "sum", (F.col("max") - F.col("min")).alias("range"), F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q2"), F.col("_q")[2].alias("q3"), known("_s", 3).alias("skewness"), known("_k", 4).alias("kurtosis"))


def return_ratios(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sharpe and Sortino ratio of returns, not annualised; 0 where undefined."""
    r = F.col(column)
    out = df.groupBy(*keys).agg(F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"), F.sqrt(F.avg(F.when(r.isNotNull(), F.pow(F.least(r, F.lit(0.0)), 2)))).alias("_d"), F.count(r).alias("n"))
    ratio = lambda d: F.when((F.col("n") >= 2) & (F.col(d) > 0), F.col("_m") / F.col(d)).otherwise(0.0)
    return out.select(*keys, "n", ratio("_s").alias("sharpe"), ratio("_d").alias("sortino"))


def daily_stability(df: DataFrame, ts: str, pnl: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of days with a positive sum."""
    days = df.groupBy(*keys, F.floor(F.col(ts) / DAY).alias("_day")).agg(F.sum(pnl).alias("_p"))
    return days.groupBy(*keys).agg(F.count("*").alias("days"), F.avg((F.col("_p") > 0).cast("double")).alias("stability"))


def win_loss(df: DataFrame, pnl: str, keys: tuple[str, ...] = ()) -> DataFrame:
    p = F.col(pnl)
    n = lambda c: F.sum(c.cast("long"))
    return df.groupBy(*keys).agg(F.count(p).alias("total"), n(p > 0).alias("winning"), n(p < 0).alias("losing"), F.avg((p > 0).cast("double")).alias("win_rate"), F.avg(p).alias("expected_value"))


def profit_factor(gross_profit: Column, gross_loss: Column) -> Column:
    """Infinite without a loss, 0 without either."""
    return F.when(gross_loss != 0, gross_profit / F.abs(gross_loss)).when(gross_profit > 0, F.lit(float("inf"))).otherwise(0.0)


def streaks(trades: DataFrame, keys: tuple[str, ...], order: list[str], pnl: str = "pnl") -> DataFrame:
    """Longest runs of wins and of losses: islands between changes of the sign."""
    w = Window.partitionBy(*keys).orderBy(*order)
    sign = F.signum(F.col(pnl))
    marked = trades.select(*keys, *order, sign.alias("_s"), F.coalesce((sign != F.lag(sign).over(w)).cast("int"), F.lit(1)).alias("_new"))
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("_i", island).groupBy(*keys, "_i", "_s").agg(F.count("*").alias("_n"))
    longest = lambda s: F.coalesce(F.max(F.when(F.col("_s") == s, F.col("_n"))), F.lit(0)).cast("long")
    return runs.groupBy(*keys).agg(longest(1).alias("max_consecutive_wins"), longest(-1).alias("max_consecutive_losses"))


def drawdowns(curve: DataFrame, keys: tuple[str, ...], order: str, equity: str = "equity") -> DataFrame:
    """Each point with its running peak and the fall from it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(equity).over(w)
    return curve.withColumn("peak", peak).withColumn("drawdown", F.col("peak") - F.col(equity)).withColumn("drawdown_percent", F.when(F.col("peak") != 0, F.col("drawdown") / F.col("peak")).otherwise(0.0))


def drawdown_summary(curve: DataFrame, keys: tuple[str, ...], order: str, equity: str = "equity") -> DataFrame:
    """Largest and mean fall, and the longest stretch under the peak, in bars."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    fallen = drawdowns(curve, keys, order, equity).withColumn("_above", F.sum((F.col("drawdown") <= 0).cast("int")).over(w))
    stretches = fallen.groupBy(*keys, "_above").agg(F.sum((F.col("drawdown") > 0).cast("long")).alias("_len"), F.max("drawdown").alias("_d"), F.max("drawdown_percent").alias("_p"), F.sum(F.when(F.col("drawdown") > 0, F.col("drawdown"))).alias("_sum"))
    under = F.sum("_len")
    return stretches.groupBy(*keys).agg(F.max("_d").alias("max_drawdown"), F.max("_p").alias("max_drawdown_percent"), F.max("_len").alias("max_drawdown_duration"), F.when(under > 0, F.sum("_sum") / under).otherwise(0.0).alias("avg_drawdown"))


def running_balance(trades: DataFrame, keys: tuple[str, ...], order: list[str], capital: float, pnl: str = "pnl") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("balance", F.lit(float(capital)) + F.sum(pnl).over(w))


def exit_reasons(trades: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count and share of each exit reason."""
    counted = trades.groupBy(*keys, "exit_reason").agg(F.count("*").alias("trades"))
    return counted.withColumn("share", F.col("trades") / F.sum("trades").over(Window.partitionBy(*keys)))


def expected_streaks(win_rate: Column, trades: Column) -> tuple[Column, Column]:
    """Mean length of win and loss streaks of a coin with this win rate; null for fewer than two trades."""
    enough = trades >= 2
    return F.when(enough & (win_rate < 1), 1 / (1 - win_rate)), F.when(enough & (win_rate > 0), 1 / win_rate)


def curve_ratios(curve: DataFrame, keys: tuple[str, ...], order: str, per_year: int, equity: str = "equity", risk_free: float = RISK_FREE) -> DataFrame:
    """Annualised Sharpe and Sortino ratio, volatility, and the same over bars whose equity changed."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(equity).over(w)
    r = curve.select(*keys, F.when(before != 0, F.col(equity) / before - 1).alias("r"), (F.col(equity) != before).alias("moved")).where("r is not null")
    base = risk_free / per_year
    scale = per_year**0.5

    def ratios(x: Column, tag: str) -> list[Column]:
        n, sd, excess = F.count(x), F.stddev_samp(x), F.avg(x) - base
        down = F.sqrt(F.avg(F.when(x.isNotNull(), F.pow(F.least(x - base, F.lit(0.0)), 2))))  # least() skips nulls
        good = n >= 10
        return [
            F.when(good & (sd > 1e-12), excess / sd * scale).otherwise(0.0).alias(f"{tag}sharpe_ratio"),
            F.when(good & (sd > 1e-12) & (down > 1e-12), excess / down * scale).otherwise(0.0).alias(f"{tag}sortino_ratio"),
        ]

    x = F.col("r")
    return r.groupBy(*keys).agg(
        *ratios(x, ""),
        *ratios(F.when(F.col("moved"), x), "active_"),
        F.when(F.count(x) >= 10, F.coalesce(F.stddev_samp(x), F.lit(0.0)) * scale).otherwise(0.0).alias("volatility"),
        (F.sum(F.col("moved").cast("long")) / F.count("*") * 100).alias("time_in_market_percent"),
        (100 - F.sum(F.col("moved").cast("long")) / F.count("*") * 100).alias("idle_capital_percent"),
    )


def trade_statistics(trades: DataFrame, keys: tuple[str, ...], capital: float) -> DataFrame:
    """Returns, win and loss figures, durations and growth of closed trades.

    ``trades``: keys, ``direction, pnl, entry_ts, exit_ts``; open ones (no exit) do not count.
    """
    closed = trades.where("exit_ts is not null")
    p, dur = F.col("pnl"), F.col("exit_ts") - F.col("entry_ts")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    long, short = F.col("direction") == "long", F.col("direction") == "short"
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    wins, losses = F.when(p > 0, p), F.when(p < 0, p)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    span = (F.max("exit_ts") - F.min("entry_ts")) / DAY
    final = capital + F.sum(p)
    growth = F.when((span > 0) & (final > 0) & (F.lit(capital) > 0) & (F.sum(p) != 0), F.pow(final / capital, 365 / span) - 1).otherwise(0.0)
    return closed.groupBy(*keys).agg(
        F.count("*").alias("total_trades"),
        F.sum(p).alias("total_return"),
        (F.sum(p) / capital * 100).alias("total_return_percent"),
        growth.alias("cagr"),
        n(p > 0).alias("winning_trades"),
        n(p < 0).alias("losing_trades"),
        rate(n(p > 0), F.count("*")).alias("win_rate"),
        zero(F.sum(wins)).alias("gross_profit"),
        zero(F.sum(losses)).alias("gross_loss"),
        profit_factor(zero(F.sum(wins)), zero(F.sum(losses))).alias("profit_factor"),
        zero(F.max(wins)).alias("largest_win"),
        zero(F.min(losses)).alias("largest_loss"),
        zero(F.avg(wins)).alias("average_win"),
        zero(F.avg(losses)).alias("average_loss"),
        F.avg(p).alias("expectancy"),
        n(long).alias("long_trades"),
        n(short).alias("short_trades"),
        rate(n(long & (p > 0)), n(long)).alias("long_win_rate"),
        rate(n(short & (p > 0)), n(short)).alias("short_win_rate"),
        F.avg(dur).alias("avg_trade_duration"),
        F.percentile(dur, 0.5).alias("median_trade_duration"),
        F.min(dur).alias("min_trade_duration"),
        F.max(dur).alias("max_trade_duration"),
        span.alias("trading_days"),
    )


def buy_and_hold(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Return, deepest fall and annualised Sharpe ratio of holding through, in percent, rounded to 2."""
    w = Window.partitionBy(*keys).orderBy("ts")
    before = F.lag("close").over(w)
    fallen = drawdowns(bars.where("close > 0").select(*keys, "ts", F.col("close").alias("equity")), keys, "ts")
    falls = fallen.groupBy(*keys).agg(F.max("drawdown_percent").alias("_dd"))
    steps = bars.select(*keys, "ts", "close", F.when(before > 0, F.col("close") / before - 1).alias("r"), (F.col("ts") - F.lag("ts").over(w)).alias("gap"))
    held = steps.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("close", "ts").alias("a"), F.max_by("close", "ts").alias("b"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.min("gap").alias("gap"))
    year = F.sqrt(31536000 / F.col("gap"))
    return held.where("n >= 2 and a > 0").join(falls, list(keys)).select(*keys, F.round((F.col("b") / F.col("a") - 1) * 100, 2).alias("return_percent"), F.round(F.col("_dd") * 100, 2).alias("max_drawdown_percent"), F.round(F.when(F.col("sd") > 0, F.col("m") / F.col("sd") * year).otherwise(0.0), 2).alias("sharpe_ratio"))
