"""Parameter search: generators, objectives, evaluation, portfolios and walk-forward."""

from __future__ import annotations

import datetime as dt
import itertools
import hashlib
import json
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import statistics as S
from . import backtest as P
from .backtest import Run, Settings
from .strategies import REGISTRY

Params = dict[str, float]


@dataclass(frozen=True)
class Dimension:
    """Values from ``low`` to ``high`` by ``step``; the end counts with a small tolerance."""

    low: float
    high: float
    step: float
    whole: bool = False

    def values(self) -> list[float]:
        out, k = [], 0
        while (v := self.low + k * self.step) <= self.high + self.step * 0.001:
            out.append(int(round(v)) if self.whole else round(v, 10))
            k += 1
        return out

    def snap(self, x: float) -> float:
        k = round((min(max(x, self.low), self.high) - self.low) / self.step)
        return self.values()[min(k, len(self.values()) - 1)]


Space = dict[str, Dimension]


def space_of(strategy: str, given: dict[str, tuple[float, float, float]] | None = None) -> Space:
    """The search space of a strategy's parameters, or of given ranges."""
    own = REGISTRY[strategy].parameters
    if given is not None:
        return {n: Dimension(*r, whole=own[n].whole) for n, r in given.items()}
    return {n: Dimension(p.low, p.high, p.step, p.whole) for n, p in own.items()}


def grid(space: Space) -> Iterator[Params]:
    """All combinations, the last dimension fastest."""
    for values in itertools.product(*(d.values() for d in space.values())):
        yield dict(zip(space, values, strict=True))


def random_sets(space: Space, n: int, seed: int = 0, retries: int = 10) -> Iterator[Params]:
    """Up to n combinations without repeats; ends when retries find nothing new."""
    rng, seen = random.Random(seed), set()
    for _ in range(n):
        for _ in range(retries):
            picked = {k: rng.choice(d.values()) for k, d in space.items()}
            key = json.dumps(picked, sort_keys=True)
            if key not in seen:
                seen.add(key)
                yield picked
                break
        else:
            return


@dataclass
class Genetic:
    """Generations by elites, tournaments, uniform crossover and bounded mutation; its state can be saved."""

    space: Space
    population: int = 50
    generations: int = 20
    seed: int = 0
    crossover: float = 0.7
    mutation: float = 0.15
    tournament: int = 3

    def __post_init__(self) -> None:
        self.rng, self.generation = random.Random(self.seed), 0
        self.members = [{k: self.rng.choice(d.values()) for k, d in self.space.items()} for _ in range(self.population)]

    def evolve(self, scores: list[float]) -> list[Params]:
        """The next generation, given the scores of the present one."""
        ranked = [m for _, m in sorted(zip(scores, self.members, strict=True), key=lambda x: -x[0])]
        scored = list(zip(scores, self.members, strict=True))
        pick = lambda: max(self.rng.sample(scored, min(self.tournament, len(scored))), key=lambda x: x[0])[1]
        after = [dict(m) for m in ranked[: max(2, self.population // 10)]]
        while len(after) < self.population:
            a, b = pick(), pick()
            child = {k: (a if self.rng.random() < 0.5 else b)[k] for k in self.space} if self.rng.random() < self.crossover else dict(a)
            for k, d in self.space.items():
                if self.rng.random() < self.mutation:
                    child[k] = d.snap(child[k] + self.rng.randint(-2, 2) * d.step)
            after.append(child)
        self.members, self.generation = after, self.generation + 1
        return after

    def state(self) -> str:
        return json.dumps({"members": self.members, "generation": self.generation, "rng": self.rng.getstate()})

    def restore(self, text: str) -> None:
        found = json.loads(text)
        self.members, self.generation = found["members"], found["generation"]
        version, inner, gauss = found["rng"]
        self.rng.setstate((version, tuple(inner), gauss))


Objective = Callable[[], Column]


def single(metric: str) -> Objective:
    """A metric as it is; falls count against a run."""
    return lambda: -F.abs(F.col(metric)) if "drawdown" in metric else F.col(metric)


def composite(weights: dict[str, tuple[float, float | None, float | None]]) -> Objective:
    """Weighted sum of metrics, each clamped where a bound is given."""

    def build() -> Column:
        out = F.lit(0.0)
        for metric, (weight, low, high) in weights.items():
            value = F.coalesce(F.col(metric), F.lit(0.0))
            value = value if low is None else F.greatest(value, F.lit(float(low)))
            value = value if high is None else F.least(value, F.lit(float(high)))
            out = out + weight * value
        return out

    return build


# Metric, weight, lower and upper clamp.
PRESETS: dict[str, Objective] = {
    "sharpe_focused": composite({"sharpe_ratio": (1.0, -3, 3), "max_drawdown_percent": (-0.3, None, None)}),
    "balanced": composite({"total_return_percent": (2.0, None, 100), "max_drawdown_percent": (-0.5, None, None), "sharpe_ratio": (1.0, -3, 3), "win_rate": (0.5, None, 1)}),
    "conservative": composite({"max_drawdown_percent": (-2.0, None, None), "profit_factor": (1.0, None, 10), "sortino_ratio": (1.0, -3, 3)}),
    "aggressive": composite({"total_return_percent": (3.0, None, 100), "sharpe_ratio": (1.0, -3, 3), "max_drawdown_percent": (-0.2, None, None)}),
}


def objective(name: str) -> Objective:
    return PRESETS.get(name) or single(name)


def score(stats: DataFrame, goal: Objective, min_trades: int = 1) -> DataFrame:
    """Runs with trades enough, their score and rank, best first among equals by run id."""
    kept = stats.where(F.col("total_trades") >= min_trades).withColumn("score", goal())
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "run_id", "symbol")))


def evaluate(bars: DataFrame, strategy: str, sets: list[Params], settings: Settings = Settings(), seconds: int = 3600) -> DataFrame:
    return P.evaluate(bars, [Run(strategy, p) for p in sets], settings, seconds)


def optimise(bars: DataFrame, strategy: str, sets: list[Params], goal: str = "sharpe_ratio", top: int = 50, settings: Settings = Settings(), seconds: int = 3600) -> DataFrame:
    """The best parameter sets by a goal; a bounded sort, not a full one."""
    stats = evaluate(bars, strategy, sets, settings, seconds).where("total_trades > 0").withColumn("score", objective(goal)())
    return stats.orderBy(F.desc("score"), "run_id", "symbol").limit(top)


def optimise_genetic(bars: DataFrame, strategy: str, space: Space, goal: str = "sharpe_ratio", population: int = 20, generations: int = 5, seed: int = 0, settings: Settings = Settings(), seconds: int = 3600, journal: Journal | None = None) -> tuple[Params, float]:
    """Best set and score; one Spark job per generation, of which one score per member reaches the driver.

    With a ``journal`` each generation is recorded when its scores are known. A search that
    finds generations of the same search there goes on after the last of them, with the same random
    stream, and ends as one that was never stopped.
    """
    search, best = Genetic(space, population, generations, seed), ({}, float("-inf"))
    told = {"strategy": strategy, "goal": goal, "population": population, "seed": seed, "space": {k: [d.low, d.high, d.step] for k, d in sorted(space.items())}}
    last = journal.last(told) if journal else None
    if last:
        search.restore(last["state"])
        best = (last["best"], last["score"])
    bars = bars.persist()
    try:
        while search.generation < generations:
            members = search.members
            runs = [Run(strategy, m) for m in members]
            stats = evaluate(bars, strategy, members, settings, seconds).where("total_trades > 0").withColumn("score", objective(goal)())
            found = {r["run_id"]: r["score"] for r in stats.groupBy("run_id").agg(F.avg("score").alias("score")).collect()}
            scores = [found.get(r.run_id) for r in runs]
            scores = [float("-inf") if s is None or s != s else s for s in scores]
            top = max(range(len(members)), key=lambda i: scores[i])
            best = (dict(members[top]), scores[top]) if scores[top] > best[1] else best
            search.evolve(scores)
            if journal:
                journal.record(told, {"generation": search.generation, "state": search.state(), "best": best[0], "score": best[1], "scores": scores})
        return best
    finally:
        bars.unpersist()


class Journal:
    """Generations of searches, as small files in a folder that outlives the driver.

    A generation's file gets its name when it is complete, so a search that is stopped at any
    time leaves whole generations only. Searches of other parameters have folders of their own.
    """

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, told: dict) -> str:
        return f"{self.path}/{hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()[:32]}"

    def record(self, told: dict, entry: dict) -> None:
        folder = self._folder(told)
        hidden, name = (self._hadoop.Path(f"{folder}/{n}{entry['generation']:06d}.json") for n in (".", ""))
        out = self._fs.create(hidden, True)
        try:
            out.write(json.dumps({"search": told} | entry).encode())
        finally:
            out.close()
        self._fs.delete(name, False)
        self._fs.rename(hidden, name)

    def generations(self, told: dict) -> list[int]:
        folder = self._hadoop.Path(self._folder(told))
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def last(self, told: dict) -> dict | None:
        """The last whole generation of a search; None if there is none."""
        found = self.generations(told)
        if not found:
            return None
        stream = self._fs.open(self._hadoop.Path(f"{self._folder(told)}/{found[-1]:06d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()


def portfolio(stats: DataFrame, symbols: int, min_trades: int = 1) -> DataFrame:
    """One score per run over its symbols: quality of each, less agreement, times participation."""
    own = 0.4 * F.greatest("sharpe_ratio", F.lit(0.0)) + 0.3 * F.col("total_return_percent") / F.greatest(F.col("max_drawdown_percent") * 100, F.lit(1.0)) + 0.2 * F.col("win_rate") + 0.1 * F.least(F.col("total_trades") / 50, F.lit(1.0))
    traded = stats.where(F.col("total_trades") >= min_trades).withColumn("own", own)
    w = Window.partitionBy("run_id")
    spread = F.stddev_pop("total_return_percent").over(w)
    z = F.when(spread > 0, F.abs((F.col("total_return_percent") - F.avg("total_return_percent").over(w)) / spread)).otherwise(0.0)
    merged = traded.withColumn("z", z).groupBy("run_id").agg(F.avg("own").alias("own"), F.max("z").alias("z"), F.count("*").alias("n"), F.avg("total_return_percent").alias("total_return_percent"), F.avg("sharpe_ratio").alias("sharpe_ratio"), F.avg("win_rate").alias("win_rate"), F.sum("total_trades").alias("total_trades"))
    penalty = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), F.least(F.lit(0.5), 1 - 0.5 * F.col("z")))).otherwise(0.0)
    value = F.col("own") * (1 - penalty) * F.col("n") / symbols
    return merged.select("run_id", F.round(F.greatest(value, F.lit(0.0)), 6).alias("score"), F.col("n").alias("symbols"), "total_return_percent", "sharpe_ratio", "win_rate", "total_trades")


@dataclass(frozen=True)
class Split:
    """Days of the in-sample and out-of-sample parts, as inclusive epoch seconds."""

    is_start: int
    is_end: int
    oos_start: int
    oos_end: int


def split_dates(start: dt.date, end: dt.date, ratio: float = 0.75, oos_start: dt.date | None = None) -> Split:
    days = (end - start).days
    is_end = start + dt.timedelta(days=round(days * ratio)) if oos_start is None else oos_start - dt.timedelta(days=1)
    begin = is_end + dt.timedelta(days=1) if oos_start is None else oos_start
    if begin >= end:
        raise ValueError("nothing is left out of sample")
    at = lambda d, last=False: int(dt.datetime(d.year, d.month, d.day, tzinfo=dt.UTC).timestamp()) + (86399 if last else 0)
    return Split(at(start), at(is_end, True), at(begin), at(end, True))


def degradation(inside: Column, outside: Column) -> Column:
    return F.when(inside != 0, (inside - outside) / F.abs(inside) * 100).otherwise(0.0)


def walk_forward(bars: DataFrame, strategy: str, sets: list[Params], split: Split, goal: str = "sharpe_ratio", top: int = 50, settings: Settings = Settings(), seconds: int = 3600) -> DataFrame:
    """The best sets in sample, with their figures out of sample and the loss between."""
    part = lambda a, b: bars.where(F.col("ts").between(a, b))
    inside = evaluate(part(split.is_start, split.is_end), strategy, sets, settings, seconds).where("total_trades > 0").withColumn("is_score", objective(goal)())
    best = inside.orderBy(F.desc("is_score"), "run_id", "symbol").limit(top)
    names = [r["run_id"] for r in best.select("run_id").distinct().collect()]  # at most ``top`` ids
    chosen = [p for p in sets if Run(strategy, p).run_id in set(names)]
    outside = evaluate(part(split.oos_start, split.oos_end), strategy, chosen or sets[:1], settings, seconds).withColumn("oos_score", objective(goal)())
    keep = ("total_return_percent", "sharpe_ratio", "max_drawdown_percent", "win_rate", "total_trades")
    left = best.select("run_id", "symbol", "is_score", *[F.col(c).alias(f"is_{c}") for c in keep])
    right = outside.select("run_id", "symbol", "oos_score", *[F.col(c).alias(f"oos_{c}") for c in keep])
    rank = F.row_number().over(Window.orderBy(F.desc("is_score"), "run_id", "symbol"))
    return left.join(right, ["run_id", "symbol"], "left").withColumn("rank", rank).withColumn("degradation", degradation(F.col("is_score"), F.coalesce("oos_score", F.lit(0.0))))


def ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """Ranks with ties averaged."""
    return df.withColumn(name, F.rank().over(Window.orderBy(column)) + (F.count("*").over(Window.partitionBy(column)) - 1) / 2)


def walk_forward_summary(results: DataFrame, min_trades: int = 1) -> DataFrame:
    """Means, medians, efficiency, robustness and rank correlation of in-sample and out-of-sample scores."""
    both = ranked(ranked(results.where(F.col("oos_score").isNotNull()), "is_score", "_ri"), "oos_score", "_ro")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    total = F.count("*")
    out = both.agg(
        total.alias("results"),
        F.avg("is_score").alias("mean_is"),
        F.avg("oos_score").alias("mean_oos"),
        F.percentile("is_score", 0.5).alias("median_is"),
        F.percentile("oos_score", 0.5).alias("median_oos"),
        F.when(F.avg("is_score") != 0, F.avg("oos_score") / F.avg("is_score") * 100).otherwise(0.0).alias("efficiency"),
        n(F.col("oos_score") > 0).alias("profitable"),
        (n((F.col("oos_score") > 0) & (F.col("degradation") < 50)) / total * 100).alias("robust_percent"),
        n(F.col("oos_total_trades") >= min_trades).alias("reliable"),
        n(F.col("oos_total_return_percent") > 10).alias("strong_returns"),
        F.max("oos_score").alias("best_oos"),
        F.when(total >= 2, F.coalesce(F.when(F.max("oos_score") == F.min("oos_score"), 0.0).otherwise(S.correlation("_ri", "_ro")), F.lit(0.0))).alias("spearman"),
    )
    return out.withColumn("tier", robustness(F.col("spearman"), F.col("efficiency"), F.col("robust_percent"))).withColumn("rank_stability", F.when(F.col("spearman") > 0.7, "stable").when(F.col("spearman") >= 0.3, "moderate").otherwise("unstable"))


def robustness(rho: Column, efficiency: Column, robust: Column) -> Column:
    bad = (efficiency < 10) | (robust < 10)
    return F.when(bad, "likely_overfit").when((rho > 0.8) & (efficiency > 70) & (robust > 70), "excellent").when((rho > 0.6) & (efficiency > 50) & (robust > 50), "good").when((rho > 0.4) & (efficiency > 30), "moderate").otherwise("weak")


def boundary_warnings(results: DataFrame, space: Space, top: int = 10) -> DataFrame:
    """Parameters whose best sets crowd at an end of their range."""
    params = F.from_json(F.regexp_replace("run_id", "^[^:]+:", ""), "map<string,double>")
    best = results.where(F.col("rank") <= top).select(F.explode(params).alias("name", "value"))
    ends = F.create_map(*[x for n, d in space.items() for x in (F.lit(n), F.struct(F.lit(float(d.low)).alias("low"), F.lit(float(d.values()[-1])).alias("high")))])
    counted = best.withColumn("e", ends[F.col("name")]).where("e is not null").groupBy("name").agg(F.avg((F.col("value") <= F.col("e.low")).cast("double")).alias("at_low"), F.avg((F.col("value") >= F.col("e.high")).cast("double")).alias("at_high"))
    return counted.withColumn("warning", F.when(F.col("at_low") >= 0.5, "low").when(F.col("at_high") >= 0.5, "high"))


def grade(summary: dict, benchmark_return: float | None, oos_return: float) -> dict:
    """Points from 0 to 100 and stars, capped where a gate fails."""
    rho, eff, robust = (float(summary.get(k) or 0) for k in ("spearman", "efficiency", "robust_percent"))
    clamp = lambda x: min(max(x, 0.0), 1.0)
    points = 100 * (0.3 * clamp(rho) + 0.3 * clamp(eff / 100) + 0.2 * clamp(robust / 100) + 0.2 * clamp(oos_return / 20))
    caps = [19] if oos_return <= 0 else []
    if benchmark_return is not None and benchmark_return > 0:
        caps += [39] if oos_return < 0.25 * benchmark_return else [59] if oos_return < benchmark_return else []
    caps += [{"likely_overfit": 19, "weak": 39, "moderate": 59, "good": 79}.get(summary.get("tier"), 100)]
    points = min(points, *caps)
    return {"points": round(points, 1), "stars": 1 + int(points // 20) if points < 100 else 5}


def conclusion(summary: dict) -> list[str]:
    """Findings in words, from one summary row."""
    out = [f"robustness is {summary['tier']}"]
    rho = summary.get("spearman") or 0.0
    out.append("ranks in sample carry over" if rho > 0.4 else "ranks in sample say little about ranks out of sample")
    out.append("most results pay out of sample" if summary["profitable"] * 2 > summary["results"] else "most results lose out of sample")
    if summary["reliable"] < summary["results"]:
        out.append("some results have few trades")
    return out


def importance(runs: DataFrame, metric: str = "score") -> DataFrame:
    """Share of each parameter in the variance of mean scores by value."""
    values = runs.select(F.explode("params").alias("name", "value"), F.col(metric).alias("m")).groupBy("name", "value").agg(F.avg("m").alias("m"))
    spread = values.groupBy("name").agg(F.var_pop("m").alias("variance"), F.count("*").alias("values"))
    total = F.sum("variance").over(Window.partitionBy())
    return spread.withColumn("importance", F.when(total > 0, F.col("variance") / total * 100).otherwise(0.0))


def score_surface(runs: DataFrame, a: str, b: str, metric: str = "score") -> DataFrame:
    """Mean score of each pair of values; null where no run has both."""
    cells = runs.groupBy(F.col("params")[a].alias("a"), F.col("params")[b].alias("b")).agg(F.avg(metric).alias("mean"), F.count("*").alias("runs"))
    axis = lambda n: F.array_sort(F.collect_set(n))
    full = cells.agg(axis("a").alias("_a"), axis("b").alias("_b")).select(F.explode("_a").alias("a"), "_b").select("a", F.explode("_b").alias("b"))
    return full.join(cells, ["a", "b"], "left")


def interactions(runs: DataFrame, metric: str = "score") -> DataFrame:
    """Joint variance of each pair of parameters less their own variances."""
    entries = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    p = runs.select(entries.alias("e"), F.col(metric).alias("m"))
    singles = p.select(F.explode("e").alias("x"), "m").groupBy(F.col("x.k").alias("k"), F.col("x.v").alias("v")).agg(F.avg("m").alias("m")).groupBy("k").agg(F.var_pop("m").alias("own"))
    pairs = F.flatten(F.transform("e", lambda x, i: F.transform(F.filter(F.col("e"), lambda y: y["k"] > x["k"]), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    joint = p.select(F.explode(pairs).alias("p"), "m").groupBy(F.col("p.x.k").alias("a"), F.col("p.y.k").alias("b"), F.col("p.x.v").alias("va"), F.col("p.y.v").alias("vb")).agg(F.avg("m").alias("m")).groupBy("a", "b").agg(F.var_pop("m").alias("joint"))
    own = lambda n: singles.select(F.col("k").alias(n), F.col("own").alias(f"own_{n}"))
    return joint.join(F.broadcast(own("a")), "a").join(F.broadcast(own("b")), "b").withColumn("interaction", F.col("joint") - F.col("own_a") - F.col("own_b"))
