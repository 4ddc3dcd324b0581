"""Statistical validation of an open-cross surface: eight tests and a verdict.

Surfaces are joined on (bucket index, minutes remaining). A surface has as many rows as
buckets times the block's minutes, whatever the number of bars.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import Spec, compute
from ..operators.opencross import SurfaceConfig, observations, surface_of
from ..operators.statistics import correlation, order_statistic

CELL = ["bucket", "minutes_remaining"]
MONTH = 30 * 86400
# Two-sided normal quantiles of usual confidence levels.
Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


@dataclass(frozen=True)
class Splits:
    """Inclusive epoch seconds; the training part comes first and ends before the test part begins."""

    train_start: int
    train_end: int
    test_start: int
    test_end: int

    def __post_init__(self) -> None:
        if not self.train_start <= self.train_end < self.test_start <= self.test_end:
            raise ValueError("training and test ranges must be in order and must not overlap")


def split(bars: DataFrame, s: Splits) -> tuple[DataFrame, DataFrame]:
    return bars.where(F.col("ts").between(s.train_start, s.train_end)), bars.where(F.col("ts").between(s.test_start, s.test_end))


def looked_up(seen: DataFrame, points: DataFrame) -> DataFrame:
    """Observations with the probability of their cell; those without a cell are left out."""
    return seen.join(points.select(*CELL, "probability"), CELL)


def train_test(bars: DataFrame, s: Splits, config: SurfaceConfig = SurfaceConfig()) -> DataFrame:
    """Mean predicted and realised crossing on each part, and their difference."""
    train, test = (observations(x, config) for x in split(bars, s))
    points = surface_of(train, config.min_samples)
    both = looked_up(train, points).withColumn("part", F.lit("train")).unionByName(looked_up(test, points).withColumn("part", F.lit("test")))
    hit = F.col("crossed").cast("double")
    return both.groupBy("part").agg(F.count("*").alias("observations"), F.avg("probability").alias("predicted"), F.avg(hit).alias("realised")).withColumn("difference", F.abs(F.col("predicted") - F.col("realised")))


def calibration_bins(predicted: DataFrame, width: float = 0.05) -> DataFrame:
    """Mean prediction and observed frequency in bins of the prediction."""
    y = F.col("crossed").cast("double")
    place = F.floor(F.round(F.col("probability") / width, 9)).cast("long")
    return predicted.groupBy(place.alias("bin")).agg(F.count("*").alias("samples"), F.avg("probability").alias("predicted"), F.avg(y).alias("observed"), F.avg(F.pow(F.col("probability") - y, 2)).alias("brier")).withColumn("error", F.abs(F.col("predicted") - F.col("observed")))


def calibration(predicted: DataFrame, width: float = 0.05) -> DataFrame:
    """Brier score, mean and largest calibration error, and whether the errors are one-sided."""
    side = F.col("predicted") - F.col("observed")
    n = F.sum("samples")
    out = calibration_bins(predicted, width).agg(
        n.alias("samples"),
        (F.sum(F.col("brier") * F.col("samples")) / n).alias("brier"),
        (F.sum(F.col("error") * F.col("samples")) / n).alias("mace"),
        F.max("error").alias("max_error"),
        F.sum((side > 0.01).cast("long")).alias("over"),
        F.sum((side < -0.01).cast("long")).alias("under"),
        F.count("*").alias("bins"),
    )
    one_sided = ((F.col("over") == F.col("bins")) | (F.col("under") == F.col("bins"))) & (F.col("bins") > 0)
    return out.withColumn("calibrated", (F.col("mace") <= 0.05) & ~one_sided)


def rolling_windows(seen: DataFrame, months: int = 6, step: int = 1) -> DataFrame:
    """Observations of each window of 30-day months that lies within the data."""
    bounds = seen.agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    first = seen.join(F.broadcast(bounds), F.col("ts") >= F.col("_a"))  # one row of bounds
    size, move = months * MONTH, step * MONTH
    last = F.floor((F.col("_b") - F.col("_a") - size) / move)
    high = F.least(F.floor((F.col("ts") - F.col("_a")) / move), last)
    low = F.greatest(F.floor((F.col("ts") - F.col("_a") - size) / move) + 1, F.lit(0))
    return first.where(low <= high).withColumn("window", F.explode(F.sequence(low, high))).drop("_a", "_b")


def compared(a: DataFrame, b: DataFrame, keys: list[str], pair: list[Column]) -> DataFrame:
    """Agreement of surfaces on common cells: mean and largest difference, and correlation (0 for fewer than 3 cells)."""
    left = a.select(*keys, F.col("probability").alias("p"), *[c for c in a.columns if c.startswith("left_")])
    right = b.select(*keys, F.col("probability").alias("q"), *[c for c in b.columns if c.startswith("right_") or c == "iteration"])
    d = F.abs(F.col("p") - F.col("q"))
    return left.join(right, keys).groupBy(*pair).agg(F.count("*").alias("cells"), F.avg(d).alias("mean_difference"), F.max(d).alias("max_difference"), F.when(F.count("*") >= 3, F.coalesce(correlation("p", "q"), F.lit(0.0))).otherwise(0.0).alias("correlation"))


def rolling_stability(bars: DataFrame, config: SurfaceConfig = SurfaceConfig(), months: int = 6, step: int = 1) -> DataFrame:
    """Each window's surface against the next one's."""
    points = surface_of(rolling_windows(observations(bars, config), months, step), config.min_samples, ("window",))
    a = points.withColumn("left_window", F.col("window"))
    b = points.withColumn("window", F.col("window") - 1).withColumn("right_window", F.col("window") + 1)
    return compared(a, b, ["window", *CELL], [F.col("window")])


def stability_verdict(steps: DataFrame) -> DataFrame:
    return steps.agg(F.count("*").alias("steps"), F.avg("correlation").alias("mean_correlation"), F.max("mean_difference").alias("drift")).withColumn("stable", (F.col("steps") >= 1) & (F.col("mean_correlation") >= 0.85) & (F.col("drift") <= 0.15))


def regimes_of(bars: DataFrame, config: SurfaceConfig, classifier: str = "volatility_percentile", threshold: float = 0.7) -> DataFrame:
    """Regime of each block by the sample deviation of its log returns: low, high, or left out between."""
    seen = observations(bars, config)
    w = Window.partitionBy("symbol", "block").orderBy("ts")
    r = F.when((F.col("close") > 0) & (F.lag("close").over(w) > 0), F.log(F.col("close") / F.lag("close").over(w)))
    steps = seen.select("symbol", "block", r.alias("r"))
    vol = steps.groupBy("symbol", "block").agg(F.stddev_samp("r").alias("v")).where("v is not null")
    if classifier == "volatility_percentile":
        cut = order_statistic(vol, "v", threshold)
    elif classifier == "volatility_fixed":
        cut = vol.agg(F.lit(threshold).alias("cut"))
    else:
        cut = vol.agg((F.avg("v") + threshold * F.stddev_pop("v")).alias("cut"))
    label = F.when(F.col("v") <= 0.8 * F.col("cut"), "low").when(F.col("v") >= 1.2 * F.col("cut"), "high")
    return vol.join(F.broadcast(cut), F.col("cut").isNotNull()).select("symbol", "block", label.alias("regime")).where("regime is not null")


def regime_sensitivity(bars: DataFrame, config: SurfaceConfig = SurfaceConfig(), classifier: str = "volatility_percentile", threshold: float = 0.7) -> DataFrame:
    """Surfaces in calm and in lively blocks, and the distance between them."""
    seen = observations(bars, config).join(regimes_of(bars, config, classifier, threshold), ["symbol", "block"])
    points = surface_of(seen, config.min_samples, ("regime",))
    low, high = points.where("regime = 'low'"), points.where("regime = 'high'")
    d = compared(low, high, CELL, [F.lit(1).alias("_one")]).drop("_one")
    off = points.groupBy().agg(F.avg(F.when(F.col("regime") == "low", F.abs(F.col("probability") - 0.5))).alias("low_offset"), F.avg(F.when(F.col("regime") == "high", F.abs(F.col("probability") - 0.5))).alias("high_offset"))
    return d.withColumn("_k", F.lit(1)).join(off.withColumn("_k", F.lit(1)), "_k").drop("_k").withColumn("explainable", (F.col("mean_difference") <= 0.2) & (F.col("low_offset") <= 0.3) & (F.col("high_offset") <= 0.3))


def shuffled(bars: DataFrame, minutes: int, seeds: list[int]) -> DataFrame:
    """For each seed (column ``seed``) the bars dealt anew within each block: the order of a
    congruential mix of seed and time, at the times of the block."""
    a, c, m = 1103515245, 12345, 2147483648  # fixed values: steps that any SQL engine can do in 64 bits
    b = bars.withColumn("_block", (F.floor(F.col("ts") / (60 * minutes)) * 60 * minutes).cast("long"))
    own = Window.partitionBy("symbol", "_block").orderBy("ts")
    placed = b.withColumn("_n", F.row_number().over(own)).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    step = lambda x: (x * a + c) % m
    mix = step(step(step((F.pmod(F.col("ts"), F.lit(m)) + F.col("seed") * 7919) % m)))
    order = Window.partitionBy("seed", "symbol", "_block").orderBy(mix, "ts")
    times = Window.partitionBy("seed", "symbol", "_block").orderBy("_n")
    mixed = placed.withColumn("_m", F.row_number().over(order))
    # the n-th time of the block goes to the bar of place n in the mixed order
    when = F.element_at(F.collect_list("ts").over(times.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.col("_m"))
    return mixed.withColumn("ts", when).select("seed", *bars.columns)


def structure(points: DataFrame) -> DataFrame:
    """Entropy of the cells, and mean steps to the next bucket and the next minute (equal keys, not neighbours in order)."""
    p = F.col("probability")
    binary = F.when((p > 0) & (p < 1), -(p * F.log(p) + (1 - p) * F.log(1 - p))).otherwise(0.0)
    up = points.select((F.col("bucket") - 1).alias("bucket"), "minutes_remaining", p.alias("pb"))
    later = points.select("bucket", (F.col("minutes_remaining") - 1).alias("minutes_remaining"), p.alias("pm"))
    near = points.select(*CELL, "probability").join(up, CELL, "left").join(later, CELL, "left")
    return near.agg(F.sum(binary).alias("entropy"), F.avg(F.abs(p - F.col("pb"))).alias("bucket_gradient"), F.avg(F.abs(p - F.col("pm"))).alias("minute_gradient"), F.count("*").alias("cells"))


def random_baseline(bars: DataFrame, config: SurfaceConfig = SurfaceConfig(), iterations: int = 10, seed: int = 1) -> DataFrame:
    """The surface against those of bars shuffled within blocks; all iterations in one plan."""
    real = surface_of(observations(bars, config), config.min_samples)
    dealt = shuffled(bars, config.block_minutes, [seed + i for i in range(iterations)])
    # a seed's bars are a series of their own
    apart = dealt.withColumn("symbol", F.concat_ws("|", F.col("seed").cast("string"), "symbol"))
    seen = observations(apart, config).withColumn("iteration", F.split("symbol", r"\|")[0].cast("int") - seed)
    fake = surface_of(seen, config.min_samples, ("iteration",))
    return compared(real, fake, CELL, [F.col("iteration")])


def baseline_verdict(steps: DataFrame) -> DataFrame:
    return steps.agg(F.avg("mean_difference").alias("difference"), (1 - F.avg("correlation")).alias("structure")).withColumn("significant", (F.col("structure") > 0.1) & (F.col("difference") > 0.05))


def cross_period(bars: DataFrame, config: SurfaceConfig = SurfaceConfig(), period: str = "year") -> DataFrame:
    """Every pair of periods: agreement of their surfaces."""
    at = F.timestamp_seconds("ts")
    name = {"year": F.year(at).cast("string"), "quarter": F.concat(F.year(at), F.lit("-Q"), F.quarter(at)), "month": F.date_format(at, "yyyy-MM"), "week": F.date_format(F.date_trunc("WEEK", at), "yyyy-MM-dd")}[period]
    points = surface_of(observations(bars, config).withColumn("period", name), config.min_samples, ("period",))
    a, b = points.withColumn("left_period", F.col("period")), points.withColumn("right_period", F.col("period"))
    left = a.select(*CELL, F.col("probability").alias("p"), "left_period")
    right = b.select(*CELL, F.col("probability").alias("q"), "right_period")
    d = F.abs(F.col("p") - F.col("q"))
    pairs = left.join(right, CELL).where("left_period < right_period").groupBy("left_period", "right_period")
    return pairs.agg(F.count("*").alias("cells"), F.avg(d).alias("mean_difference"), F.when(F.count("*") >= 3, F.coalesce(correlation("p", "q"), F.lit(0.0))).otherwise(0.0).alias("correlation"))


def matrix(pairs: DataFrame, value: str = "correlation", diagonal: float = 1.0) -> DataFrame:
    """Pairs of periods as a full matrix in long form: both ways, and the diagonal."""
    one = pairs.select(F.col("left_period").alias("period"), F.col("right_period").alias("other"), F.col(value))
    other = one.select(F.col("other").alias("period"), F.col("period").alias("other"), value)
    own = one.select("period").unionAll(other.select("period")).distinct().select("period", F.col("period").alias("other"), F.lit(diagonal).alias(value))
    return one.unionAll(other).unionAll(own)


def persistence(pairs: DataFrame) -> DataFrame:
    """For each period its mean agreement with the others (the off-diagonal of its row)."""
    both = matrix(pairs).where("period <> other").join(matrix(pairs, "mean_difference", 0.0), ["period", "other"])
    return both.groupBy("period").agg(F.count("*").alias("others"), F.avg("correlation").alias("persistence"), F.avg("mean_difference").alias("mean_difference"), F.min("correlation").alias("least_correlation"))


def monotonicity(points: DataFrame) -> DataFrame:
    """Share of neighbouring cells of high confidence whose probability moves one way, per remaining time."""
    w = Window.partitionBy("minutes_remaining").orderBy("bucket")
    step = points.where("confidence = 'high'").withColumn("step", F.signum(F.col("probability") - F.lag("probability").over(w)))
    same = step.withColumn("same", (F.col("step") == F.lag("step").over(w)).cast("double"))
    return same.groupBy("minutes_remaining").agg(F.avg("same").alias("monotonicity"), F.count("*").alias("cells"))


def uncertainty(points: DataFrame, level: float = 0.95, margin: float = 0.05) -> DataFrame:
    """Standard error and Wald, Wilson and Agresti-Coull intervals of each cell, and the samples that a margin needs."""
    z, p, n = Z[level], F.col("probability"), F.col("samples").cast("double")
    se = F.sqrt(p * (1 - p) / n)
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    nt = n + z * z
    pt = (F.col("crosses") + z * z / 2) / nt
    ac = z * F.sqrt(pt * (1 - pt) / nt)
    need = -(-z * z / 4 // (margin * margin))
    return points.withColumns(
        {
            "standard_error": se,
            "wald_low": clip(p - z * se),
            "wald_high": clip(p + z * se),
            "wilson_low": clip(centre - half),
            "wilson_high": clip(centre + half),
            "agresti_low": clip(pt - ac),
            "agresti_high": clip(pt + ac),
            "needed": F.lit(int(need)),
            "enough": n >= need,
        }
    )


def simulate(bars: DataFrame, points: DataFrame, config: SurfaceConfig = SurfaceConfig(), threshold: float = 0.7) -> DataFrame:
    """Trades on the surface: one position a block, entered at an extreme probability, left at
    the block's open or at its end.

    A bar with a probability of crossing over the threshold bets on the cross, one
    under its complement against it. The entry is the first such bar of a block; the
    exit the first later bar that crosses the open, else the last bar.
    """
    seen = looked_up(observations(bars, config), points)
    away = F.col("close") > F.col("block_open")
    bet = F.when(F.col("probability") > threshold, F.when(away, "short").otherwise("long")).when(F.col("probability") < 1 - threshold, F.when(away, "long").otherwise("short"))
    entered = seen.withColumn("side", bet).where("side is not null").groupBy("symbol", "block").agg(F.min_by(F.struct("ts", "close", "side", "block_open"), "ts").alias("e"))
    block = (F.floor(F.col("ts") / (60 * config.block_minutes)) * 60 * config.block_minutes).cast("long")
    later = bars.select("symbol", block.alias("block"), "ts", "high", "low", "close").join(entered, ["symbol", "block"]).where("ts > e.ts")
    open_ = F.col("e.block_open")
    crossed = F.when(F.col("e.close") > open_, F.col("low") < open_).otherwise(F.col("high") > open_)
    out = later.groupBy("symbol", "block", "e").agg(F.min(F.when(crossed, F.col("ts"))).alias("cross_ts"), F.max("ts").alias("last_ts"), F.max_by("close", "ts").alias("last"))
    exit_ = F.when(F.col("cross_ts").isNotNull(), open_).otherwise(F.col("last"))
    sign = F.when(F.col("e.side") == "long", 1).otherwise(-1)
    return out.select("symbol", "block", F.col("e.ts").alias("entry_ts"), F.col("e.side").alias("side"), F.col("e.close").alias("entry_price"), exit_.alias("exit_price"), F.coalesce("cross_ts", "last_ts").alias("exit_ts"), (sign * (exit_ - F.col("e.close"))).alias("pnl"))


def monthly(trades: DataFrame) -> DataFrame:
    """Trades, wins and profit of each month of exit."""
    month = F.date_format(F.timestamp_seconds("exit_ts"), "yyyy-MM")
    return trades.groupBy(month.alias("month")).agg(F.count("*").alias("trades"), F.sum((F.col("pnl") > 0).cast("long")).alias("wins"), F.sum("pnl").alias("total_pnl"), F.avg("pnl").alias("avg_pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"))


def with_volatility(bars: DataFrame, lookback: int = 60, seconds: int = 60) -> DataFrame:
    """Bars with the volatility that a normalised surface needs; ``seconds`` is the usual distance of two bars."""
    return compute(bars, [Spec("ewma_volatility", {"lookback": lookback}, "volatility")], seconds=seconds)


def validate(bars: DataFrame, s: Splits, config: SurfaceConfig = SurfaceConfig(), iterations: int = 3, months: int = 6, threshold: float = 0.7) -> dict:
    """All tests and the verdict; a test that has too little data is None and counts neither way."""
    train, test = split(bars, s)
    points = surface_of(observations(train, config), config.min_samples)
    row = lambda df: (df.first() or None) and df.first().asDict()
    cal = row(calibration(looked_up(observations(test, config), points)))
    cal = cal if cal and cal["samples"] else None
    stable = row(stability_verdict(rolling_stability(bars, config, months)))
    stable = stable if stable and stable["steps"] else None
    regime, base = row(regime_sensitivity(bars, config)), row(baseline_verdict(random_baseline(train, config, iterations)))
    trades = simulate(test, points, config, threshold).agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"), F.avg("pnl").alias("m"), F.stddev_samp("pnl").alias("sd")).first()
    profitable = bool(trades["n"] and trades["pnl"] > 0 and trades["sd"] and trades["m"] / trades["sd"] * trades["n"] ** 0.5 > 1)
    checks = {
        "calibration": None if cal is None else cal["mace"] < 0.05,
        "stability": None if stable is None else stable["stable"],
        "regime": None if regime is None else regime["explainable"],
        "baseline": None if base is None or base["difference"] is None else base["significant"],
        "simulation": None if not trades["n"] else profitable,
    }
    return {"train_test": [r.asDict() for r in train_test(bars, s, config).collect()], "calibration": cal, "stability": stable, "regime": regime, "baseline": base, "checks": checks, "passed": all(v is not False for v in checks.values())}
