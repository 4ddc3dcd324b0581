"""A bitmap of hashed ids, to leave rows out before a join shuffles them.

The bitmap has a fixed bound (``MOST_BITS``), is built by aggregation and broadcast. It
may let a row through whose id is not among the ids, but never leaves out one that is;
an exact join follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_name

PART = 32768  # bits of one row of the bitmap
MOST_BITS = 1 << 28  # 32 MB
BITS_PER_ID = 16


def _bits_for(n: int) -> int:
    bits = PART
    while bits < BITS_PER_ID * n and bits < MOST_BITS:
        bits *= 2
    return bits


def marked(rows: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean column ``name``: false if ``key`` (long) is surely not among ``ids`` (one long column)."""
    bits = _bits_for(ids.count())
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    own = F.col(ids.columns[0])
    part, bitmap, at = (free_name([*rows.columns, name], c) for c in ("_part", "_bitmap", "_at"))
    parts = ids.where(own.isNotNull()).groupBy(F.floor(place(own) / PART).alias(part)).agg(F.bitmap_construct_agg(place(own) % PART).alias(bitmap))
    placed = rows.withColumn(at, place(F.col(key)))
    joined = placed.join(F.broadcast(parts), F.floor(F.col(at) / PART) == F.col(part), "left")
    return joined.withColumn(name, _bit(F.col(bitmap), F.col(at) % PART)).drop(part, bitmap, at)


def _bit(bitmap: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1, F.lit(False))
