"""Market regimes: labels of each bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import Spec, compute
from ..functions.windowed import Series

S = Series()


def _mean(bars: DataFrame, period: int, ma_type: int) -> DataFrame:
    spec = Spec("sma", {"period": period}, "_ma") if ma_type == 0 else Spec("ma", {"period": period, "ma_type": ma_type}, "_ma")
    return compute(bars, [spec])


def trend(bars: DataFrame, period: int = 200, ma_type: int = 0) -> DataFrame:
    """Bull over the moving mean, else bear; null for the first ``period + 1`` bars."""
    label = F.when(F.col("close") > F.col("_ma"), "bull").when(F.col("_ma").isNotNull(), "bear")
    return _mean(bars, period, ma_type).withColumn("regime", S.ready(label, period + 1)).drop("_ma")


def adx(bars: DataFrame, period: int = 14, threshold: float = 20.0, ma_period: int = 50, ma_type: int = 0) -> DataFrame:
    """Sideways under the threshold of ADX, else bull or bear by the moving mean."""
    df = compute(_mean(bars, ma_period, ma_type), [Spec("adx", {"period": period}, "_adx")])
    label = F.when(F.col("_adx").isNull() | F.col("_ma").isNull(), None).when(F.col("_adx") < threshold, "sideways").when(F.col("close") > F.col("_ma"), "bull").otherwise("bear")
    return df.withColumn("regime", S.ready(label, 2 * period)).drop("_adx", "_ma")


def volatility(bars: DataFrame, period: int = 14, low: float = 0.33, high: float = 0.67, seconds: int | None = None) -> DataFrame:
    """Low, normal or high by the average true range, cut at order statistics of the series.

    The cut is the value of rank ``floor(n q)``, without interpolation: ranks come from
    counts of distinct values, so no list of the series is gathered.
    """
    df = compute(bars, [Spec("atr", {"period": period}, "_atr")], seconds=seconds)
    values = df.where("_atr is not null").groupBy("symbol", "_atr").agg(F.count("*").alias("times"))
    up_to = F.sum("times").over(Window.partitionBy("symbol").orderBy("_atr"))
    ranked = values.withColumn("upto", up_to).withColumn("n", F.sum("times").over(Window.partitionBy("symbol")))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col("_atr")))
    cuts = ranked.groupBy("symbol").agg(at(low).alias("_lo"), at(high).alias("_hi"))
    label = F.when(F.col("_atr").isNull(), None).when(F.col("_lo") == F.col("_hi"), "low_vol").when(F.col("_atr") >= F.col("_hi"), "high_vol").when(F.col("_atr") >= F.col("_lo"), "normal_vol").otherwise("low_vol")
    return df.join(cuts, "symbol", "left").withColumn("regime", label).drop("_atr", "_lo", "_hi")


def combined(bars: DataFrame, trend_period: int = 200, atr_period: int = 14, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """``trend_volatility``; null where either is."""
    both = trend(bars, trend_period).withColumnRenamed("regime", "_trend")
    return volatility(both, atr_period, low, high).withColumn("regime", F.concat("_trend", F.lit("_"), "regime")).drop("_trend")


def labels(df: DataFrame) -> DataFrame:
    return df.where("regime is not null").select("regime").distinct().orderBy("regime")
