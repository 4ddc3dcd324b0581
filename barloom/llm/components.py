"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import hot_keys, join_split
from .storage import discard, materialise


#: Among fewer edges a node's own are no burden for a task, and hubs are not looked for.
HUB_EDGES = 500_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, hubs: list[int]) -> DataFrame:
    """Every neighbour larger than a node is linked to the node's least neighbour."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = join_split(both.where("v > u"), least, ["u"], "u", hubs, "v")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them.

    After a large star a node has few smaller neighbours, so no key is hot here.
    """
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _hubs(edges: DataFrame, total: int) -> list[int]:
    """The nodes that hold a large share of the edges; none is large among few edges."""
    if total <= HUB_EDGES:
        return []
    return hot_keys(_both(edges).groupBy("u").agg(F.count("*").alias("n")), "u", "n")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node that an edge names.

    ``edges`` has columns ``u`` and ``v`` (long); loops and repeated edges are
    allowed, rows with a null are ignored. Returns ``node, component`` where the
    component is the least node that can be reached. Each round is written to the
    shared folder; only a row count, a checksum and the few hubs that hold a large
    share of all edges reach the driver. An empty table gives an empty result. The
    caller deletes the result's table with ``discard``.
    """
    nodes = edges.where("u is not null and v is not null")
    current = materialise(nodes.where("u <> v").select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).distinct(), "edges")
    seen = _state(current)
    for _ in range(max_rounds):
        following = materialise(_small_star(_large_star(current, _hubs(current, seen[0]))), "edges")
        state = _state(following)
        discard(current)
        current = following
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)
    found._scratch = current._scratch
    return found
