"""Joins with keys that hold a large share of all rows.

The ``SHARE`` largest keys are hot, if they have ``LEAST_HOT`` rows: every key that holds more
than one in ``SHARE`` of all rows is among them. Their rows are dealt over as many salts as
the session has shuffle partitions; the other side's rows of these keys are repeated
for each salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARE = 1000
#: A key with fewer rows is never hot.
LEAST_HOT = 512


def hot_keys(counted: DataFrame, key: str, size: str) -> list[int]:
    """The hot keys (at most ``SHARE``) of a table of keys and their sizes."""
    largest = counted.where(F.col(size) > LEAST_HOT).select(key, size).orderBy(F.desc(size), key).limit(SHARE)
    return sorted({row[0] for row in largest.collect()})


def _salted(column: str, hot: list[int], yes: Column, no: Column) -> Column:
    return F.when(F.col(column).isin(hot), yes).otherwise(no)


def join_split(left: DataFrame, right: DataFrame, keys: list[str], hot_key: str, hot: list[int], spread: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, where ``left`` has many rows of the hot values of ``hot_key``.

    ``spread`` is a column of ``left`` by which these rows are dealt; ``right`` should
    have few rows of a key.
    """
    if not hot:
        return left.join(right, keys, how)
    splits = max(16, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a = left.withColumn("_salt", _salted(hot_key, hot, F.pmod(F.xxhash64(spread), F.lit(splits)).cast("int"), F.lit(0)))
    b = right.withColumn("_salt", F.explode(_salted(hot_key, hot, F.sequence(F.lit(0), F.lit(splits - 1)), F.array(F.lit(0)))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")
