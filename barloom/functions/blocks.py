"""Long series in blocks of rows, so that one endless series is as many tasks as it has blocks.

A row's place in its series is its place within a coarse block of time plus the rows of the
coarse blocks before it, which are one row each. Blocks are then cut by place, so that none
has more than the wanted number of rows, however close, far apart or repeated the times are.

* What looks back over a bounded number of rows gets them as a halo: copies of the last
  rows of the block before, which are dropped again.
* What carries a state from row to row is told how a block changes a state that enters it; these changes
  are put together block by block, and each block is run once more from its own state.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import bucket
from .windowed import Series

#: Rows of a block.
ROWS = 4096
KEYS = ["symbol", "_block"]


def placed(bars: DataFrame, seconds: int, rows: int = ROWS) -> DataFrame:
    """Bars with ``_place`` in their series (from 0), ``_block`` and ``_i``, the place in it (from 0).

    ``seconds`` is the usual distance of two bars. It only says how much time is sorted
    at once; with irregular or repeated times the blocks still have ``rows`` rows. Bars
    of the same time are ordered by their other columns.
    """
    order = ["ts", *[c for c in ("open", "high", "low", "close", "volume") if c in bars.columns]]
    coarse = bars.withColumn("_coarse", bucket(F.col("ts"), seconds * rows))
    counts = coarse.groupBy("symbol", "_coarse").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("symbol").orderBy("_coarse").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("symbol", "_coarse", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = Window.partitionBy("symbol", "_coarse").orderBy(*order)
    numbered = coarse.withColumn("_i", F.row_number().over(own)).join(offsets, ["symbol", "_coarse"])
    place = F.col("_offset") + F.col("_i") - 1
    return numbered.withColumn("_place", place).drop("_coarse", "_offset").withColumns({"_block": F.floor(F.col("_place") / rows), "_i": F.col("_place") % rows})


def with_halo(df: DataFrame, halo: int, rows: int = ROWS) -> DataFrame:
    """``df`` (from :func:`placed`) with ``_halo``: each block also has the last ``halo`` rows before it."""
    if not halo:
        return df.withColumn("_halo", F.lit(False))
    if halo > rows:
        raise ValueError(f"a halo of {halo} rows needs blocks of at least as many, not {rows}")
    own, again = F.struct(F.col("_block").alias("b"), F.lit(False).alias("h")), F.struct((F.col("_block") + 1).alias("b"), F.lit(True).alias("h"))
    copies = F.explode(F.when(F.col("_i") >= rows - halo, F.array(own, again)).otherwise(F.array(own)))
    return df.withColumn("_copy", copies).withColumns({"_block": F.col("_copy.b"), "_halo": F.col("_copy.h")}).drop("_copy")


def windows(df: DataFrame, halo: int, apply: Callable[[DataFrame, Series], DataFrame], rows: int = ROWS) -> DataFrame:
    """``apply``, which adds window columns of a series, on each block of ``df`` (from :func:`placed`) with its halo.

    The windows of the given :class:`Series` see the block and the ``halo`` rows before it, as
    many as they look back.
    """
    return apply(with_halo(df, halo, rows), Series(tuple(KEYS), "_place", place_column="_place")).where(~F.col("_halo")).drop("_halo")


#: What a block does to a state that enters it, told from the block and the states of the steps before.
Change = Callable[[pd.DataFrame, list], list[float]]
#: States that enter the blocks of a series, from what its blocks do, in order.
Enter = Callable[[list, list], list[list[float]]]


def carried(df: DataFrame, steps: list[tuple[Change, Enter]], replay: Callable[[pd.DataFrame, list], pd.DataFrame], schema: T.StructType | str) -> DataFrame:
    """Run what carries a state over blocks (``df`` from :func:`with_halo`).

    In each step ``change`` tells what a block, ordered by place, does to a state, and ``enter``,
    from the numbers of the blocks of a series and what they do, the state that enters each. A later step
    knows the states of earlier ones. ``replay`` runs a block from its states, one per
    step. Blocks are tasks of their own, and all steps read the same shuffled blocks; only
    ``enter`` sees a series at once, one row per block.
    """
    grouped, states = df.groupBy(*KEYS), None
    names = schema.names if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema).names
    told = "symbol string, _block long, known array<array<double>>, map array<double>"
    for change, enter in steps:
        if states is None:
            maps = grouped.applyInPandas(_first_changes(change), told)
        else:
            maps = grouped.cogroup(states.groupBy(*KEYS)).applyInPandas(_later_changes(change), told)
        states = maps.groupBy("symbol").applyInPandas(_entered(enter), "symbol string, _block long, known array<array<double>>")
    return grouped.cogroup(states.groupBy(*KEYS)).applyInPandas(_replayed(replay, names), schema)


def _changed(change: Change, frame: pd.DataFrame, known: list) -> pd.DataFrame:
    row = frame.iloc[0]
    return pd.DataFrame({"symbol": [row["symbol"]], "_block": [row["_block"]], "known": [known], "map": [change(frame.sort_values("_place"), known)]})


def _first_changes(change: Change) -> Callable:
    def first(frame: pd.DataFrame) -> pd.DataFrame:
        return _changed(change, frame, [])

    return first


def _later_changes(change: Change) -> Callable:
    def later(frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        return _changed(change, frame, _known(state))

    return later


def _entered(enter: Enter) -> Callable:
    def entered(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_block").reset_index(drop=True)
        found = enter(frame["_block"].tolist(), frame["map"].tolist())
        return frame[KEYS].assign(known=[[*map(list, k), list(s)] for k, s in zip(frame["known"], found, strict=True)])

    return entered


def _replayed(replay: Callable[[pd.DataFrame, list], pd.DataFrame], names: list[str]) -> Callable:
    def replayed(frame: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        if frame["_halo"].all():  # copies of rows that no block follows
            return pd.DataFrame(columns=names)
        return replay(frame.sort_values("_place"), _known(state))

    return replayed


def _known(state: pd.DataFrame) -> list:
    return [list(s) for s in state["known"].iat[0]]
