"""Findings in words, and orders that have no query."""

from barloom.operators import montecarlo
from barloom.operators.opencross import ordered
from barloom.plans import search as G


def row(**more):
    return {"p_negative": 0.0, "p5": 1.0, "p50": 2.0, "p95": 4.0} | more


def test_what_a_bootstrap_says():
    assert montecarlo.interpret(row(), 40) == ["no loss in any draw", "the spread is moderate", "the median gain is moderate"]
    assert montecarlo.interpret(row(p_negative=0.04, p95=2.5), 40)[:2] == ["losses are rare", "the spread is tight"]
    assert montecarlo.interpret(row(p_negative=0.1, p50=0.5), 40)[::2] == ["losses are possible", "the median gain is small"]
    assert montecarlo.interpret(row(p_negative=0.2, p95=9.0, p50=5.0), 12) == ["fewer than 30 trades: take the figures with care", "losses are likely", "the spread is wide", "the median gain is meaningful"]


def test_what_a_walk_forward_says():
    base = {"tier": "good", "spearman": 0.5, "profitable": 3, "results": 5, "reliable": 5}
    assert G.conclusion(base) == ["robustness is good", "ranks in sample carry over", "most results pay out of sample"]
    poor = G.conclusion(base | {"spearman": None, "profitable": 2, "reliable": 4})
    assert poor[1:] == ["ranks in sample say little about ranks out of sample", "most results lose out of sample", "some results have few trades"]


def test_order_of_a_surface(spark):
    cells = [(2, 1), (-1, 3), (0, 2), (0, 5), (2, 4)]
    points = spark.createDataFrame(cells, "bucket long, minutes_remaining long")
    assert [tuple(r) for r in ordered(points).collect()] == [(-1, 3), (0, 5), (0, 2), (2, 4), (2, 1)]
