"""Shared scratch tables: lineage is cut by writing to the folder that the cluster names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a session that runs in one local process has its own folder under
    the warehouse; a cluster's executors would not share one, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/barloom-scratch"


#: Bytes of an Arrow batch.
BATCH_BYTES = 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Have Spark hand texts to Python workers in batches of a megabyte, so that executors
    need little memory beside their heap. Batches of short rows stay as they are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def unbroadcast(spark: SparkSession) -> Iterator[None]:
    """No join of a job that runs here is turned into a broadcast by itself.

    An operator of many small joins would leave a table of some megabytes (a page of memory at
    least) in every executor for each. What a plan broadcasts by a hint is not touched.
    """
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    try:
        yield
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, or a longer name, that no column has (in any case)."""
    names = {c.lower() for c in taken}
    while wish.lower() in names:
        wish += "_"
    return wish


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/barloom-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, so that later
    failures restart from the files and not from the whole lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._scratch = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            remove(table.sparkSession, path)


class Scratch:
    """Scratch tables of one operator, deleted together when nothing lazy reads them any more."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(materialise(df, label))
        return self.tables[-1]

    def clear(self) -> None:
        discard(*self.tables)
        self.tables = []
