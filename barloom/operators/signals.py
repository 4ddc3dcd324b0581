"""Evaluation of trade signals: which barrier is touched first?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


DAY = 86400


def _exits(held: DataFrame, before: str) -> DataFrame:
    """Bars of signals with the reason and price of an exit, the water mark running on from ``before``."""
    long = F.col("direction") == "long"
    w = Window.partitionBy("signal_id", "_block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(long, F.greatest(F.col(before), F.max("high").over(w))).otherwise(F.least(F.col(before), F.min("low").over(w)))
    held = held.withColumn("mark", mark)
    distance = F.col("close") * F.col("trailing_percent") / 100
    trail = F.when(long, F.col("mark") - distance).otherwise(F.col("mark") + distance)
    hit = lambda level, below: F.coalesce(F.when(below, F.col("low") <= level).otherwise(F.col("high") >= level), F.lit(False))
    reason = F.when(hit(F.col("stop_loss"), long), "stop_loss").when(hit(trail, long), "trailing_stop").when(hit(F.col("take_profit"), ~long), "take_profit")
    price = F.when(F.col("reason") == "stop_loss", F.col("stop_loss")).when(F.col("reason") == "trailing_stop", F.col("trail")).when(F.col("reason") == "take_profit", F.col("take_profit"))
    return held.withColumn("trail", trail).withColumn("reason", reason).select("signal_id", "ts", "mark", "reason", price.alias("price"))


#: Nodes below a node of the pyramid of extremes.
FAN = 32


def levels_for(bars: DataFrame, block_seconds: int) -> int:
    """Levels above the blocks so that the topmost has at most ``FAN`` nodes to a series."""
    span = bars.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    blocks, levels = 1 if span["lo"] is None else (span["hi"] - span["lo"]) // block_seconds + 2, 0
    while blocks > FAN:
        blocks, levels = -(-blocks // FAN), levels + 1
    return levels


def _pyramid(own: DataFrame, levels: int) -> DataFrame:
    """Extremes of blocks of time, of ``FAN`` blocks together, and so on: one row per symbol, level and node."""
    ends = lambda: [F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"), F.max("_top").alias("_top"), F.min("_bottom").alias("_bottom")]
    blocks = own.groupBy("symbol", "_block").agg(F.max("high").alias("_hi"), F.min("low").alias("_lo"), F.max("close").alias("_top"), F.min("close").alias("_bottom"))
    above = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("_block") / FAN**k).alias("node")) for k in range(levels + 1)]))
    return blocks.withColumn("_at", above).groupBy("symbol", F.col("_at.level").alias("_level"), F.col("_at.node").alias("_node")).agg(*ends())


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _judged(nodes: DataFrame, keys: list[str], given: str) -> DataFrame:
    """Nodes of signals with the mark before each, and whether a level is touched in it for sure, or may be.

    Nodes with the same ``keys`` follow each other in time (``_from``); ``given`` is the mark before the first of them.
    """
    long = F.col("direction") == "long"
    w = Window.partitionBy(*keys).orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    before = F.when(long, F.greatest(given, F.max("_hi").over(w))).otherwise(F.least(given, F.min("_lo").over(w)))
    nodes = nodes.withColumn("_before", before)
    sure = _yes(F.when(long, F.col("_lo") <= F.col("stop_loss")).otherwise(F.col("_hi") >= F.col("stop_loss"))) | _yes(F.when(long, F.col("_hi") >= F.col("take_profit")).otherwise(F.col("_lo") <= F.col("take_profit")))
    # the trail is nearest with the node's own extreme and the least distance that its closes allow
    near = F.when(F.col("trailing_percent") >= 0, F.col("_bottom")).otherwise(F.col("_top")) * F.col("trailing_percent") / 100
    maybe = _yes(F.when(long, F.col("_lo") <= F.greatest("_before", "_hi") - near).otherwise(F.col("_hi") >= F.least("_before", "_lo") + near))
    first = F.min(F.when(F.col("_sure"), F.col("_from"))).over(Window.partitionBy(*keys))
    nodes = nodes.withColumn("_sure", sure).withColumn("_maybe", sure | maybe)
    return nodes.withColumn("_upto", first).where(F.col("_maybe") & (F.col("_upto").isNull() | (F.col("_from") <= F.col("_upto"))))


def _descended(known: DataFrame, pyramid: DataFrame, names: list[str], levels: int) -> tuple[DataFrame, DataFrame]:
    """Blocks after each signal's entry block in which a level may be touched, up to the first in which one surely
    is; and all nodes that were looked at first, which together cover the time after the entry block."""
    top = pyramid.where(F.col("_level") == levels).withColumnRenamed("_node", "_over")
    beyond = known.select("symbol", *names, "_mark0", "_entry_block").join(top, "symbol").where(F.col("_over") > F.floor(F.col("_entry_block") / FAN**levels))
    found = beyond.withColumnRenamed("_over", "_node").drop("_entry_block")
    for k in range(levels):  # below the top, nodes to the right under the same parent
        own, last = F.floor(F.col("_entry_block") / FAN**k), F.floor(F.col("_entry_block") / FAN ** (k + 1)) * FAN + FAN - 1
        right = F.when(own < last, F.sequence(own + 1, last)).otherwise(F.array().cast("array<bigint>"))
        beside = known.select("symbol", *names, "_mark0", F.lit(k).alias("_level"), F.explode(right).alias("_node"))
        found = found.unionByName(beside.join(pyramid, ["symbol", "_level", "_node"]))
    spans = F.element_at(F.create_map(*[x for k in range(levels + 1) for x in (F.lit(k), F.lit(FAN**k))]), F.col("_level"))
    found = found.withColumn("_from", F.col("_node") * spans)
    chosen = _judged(found, ["signal_id"], "_mark0")
    kept = ["symbol", *names, "_level", "_node", "_from", "_before"]
    chosen = chosen.select(*kept)
    for k in range(levels, 0, -1):
        below = F.explode(F.sequence(F.col("_node") * FAN, F.col("_node") * FAN + FAN - 1))
        parents = chosen.where(F.col("_level") == k).withColumn("_parent", F.col("_from")).withColumnRenamed("_before", "_given")
        children = parents.withColumn("_child", below).drop("_node", "_level", "_from").withColumnRenamed("_child", "_node").withColumn("_level", F.lit(k - 1))
        children = children.join(pyramid, ["symbol", "_level", "_node"]).withColumn("_from", F.col("_node") * FAN ** (k - 1))
        chosen = chosen.where(F.col("_level") < k).unionByName(_judged(children, ["signal_id", "_parent"], "_given").select(*kept))
    return chosen, found


def evaluate(signals: DataFrame, bars: DataFrame, block_seconds: int = DAY, levels: int | None = None) -> DataFrame:
    """Outcome of each signal over the bars from its entry on.

    ``signals``: ``signal_id, symbol, direction`` (long or short), ``entry_price,
    stop_loss, take_profit`` (null: none), ``trailing_percent`` (null: none),
    ``high_water_mark`` (null: the entry price), ``entry_ts``. Within a bar the trail
    is updated with the bar's own extreme first, at a share of the bar's close from it;
    then the stop loss, the trailing stop and the take profit are tested in this order. A signal that touches nothing stays
    open, and its water mark is carried on.

    Signals meet a pyramid of extremes: blocks of time, ``FAN`` blocks together, and so on. The time after a
    signal's block is covered by a few nodes of each level; those in which a level may
    be touched are opened level by level, down to the blocks whose bars are tested one by
    one. So the rows that a signal meets grow with the logarithm of the series. The
    number of ``levels`` follows from the span of time, which is looked up if it is not given.
    """
    levels = levels_for(bars, block_seconds) if levels is None else levels
    long = F.col("direction") == "long"
    block = lambda c: F.floor(F.col(c) / block_seconds)
    names = ["signal_id", "direction", "stop_loss", "take_profit", "trailing_percent"]
    placed = signals.withColumn("_entry_block", block("entry_ts")).withColumn("_start", F.coalesce("high_water_mark", "entry_price"))
    own = bars.select("symbol", "ts", "high", "low", "close").withColumn("_block", block("ts"))

    first = placed.join(own.withColumnRenamed("_block", "_entry_block"), ["symbol", "_entry_block"]).where("ts >= entry_ts").withColumn("_block", F.col("_entry_block"))
    begun = first.groupBy("signal_id").agg(F.max("high").alias("_hi0"), F.min("low").alias("_lo0"))
    known = placed.join(begun, "signal_id", "left").withColumn("_mark0", F.when(long, F.greatest("_start", "_hi0")).otherwise(F.least("_start", "_lo0")))
    chosen, after = _descended(known, _pyramid(own, levels), names, levels)
    later = chosen.select("symbol", F.col("_node").alias("_block"), "_before", *names).join(own, ["symbol", "_block"])
    tested = _exits(first.select(*names, "_block", F.col("_start").alias("_before"), "ts", "high", "low", "close"), "_before").unionByName(_exits(later.select(*names, "_block", "_before", "ts", "high", "low", "close"), "_before"))
    exits = tested.where("reason is not null").groupBy("signal_id").agg(F.min_by(F.struct("reason", "price", "ts", "mark"), "ts").alias("exit"))
    ends = after.groupBy("signal_id").agg(F.max("_hi").alias("_hi1"), F.min("_lo").alias("_lo1"))
    last = F.when(long, F.greatest("_mark0", "_hi1")).otherwise(F.least("_mark0", "_lo1"))
    sign = F.when(long, 1).otherwise(-1)
    done = known.join(ends, "signal_id", "left").join(exits, "signal_id", "left").withColumn("last_mark", last)
    done = done.withColumn("pnl_percent", sign * F.try_divide(F.col("exit.price") - F.col("entry_price"), F.col("entry_price")) * 100)
    return done.select(
        "signal_id",
        "symbol",
        "direction",
        F.when(F.col("exit.reason").isNull(), "open").when(F.col("pnl_percent") > 0, "winner").otherwise("loser").alias("status"),
        F.col("exit.reason").alias("exit_reason"),
        F.col("exit.price").alias("exit_price"),
        F.col("exit.ts").alias("exit_ts"),
        "pnl_percent",
        F.when(F.col("exit.reason").isNull(), F.col("last_mark")).otherwise(F.col("exit.mark")).alias("high_water_mark"),
    )
