import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("shared").as_uri())
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def make_bars(spark, rows, symbol="A", step=60, start=0):
    """Bars from (open, high, low, close) or closes."""
    shaped = [(symbol, start + i * step, *(map(float, r if isinstance(r, tuple) else (r, r, r, r))), 1.0) for i, r in enumerate(rows)]
    return spark.createDataFrame(shaped, "symbol string, ts long, open double, high double, low double, close double, volume double")
