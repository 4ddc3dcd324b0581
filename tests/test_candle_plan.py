"""The plan of the candlesticks over drawn shapes: candles before are one struct each, and line items are read and shuffled once."""

from barloom import registry


def test_rows_of_windows_are_narrow(spark, sf_dir):
    query = registry.queries()["candles_shapes"](spark, sf_dir)._jdf.queryExecution()
    assert query.optimizedPlan().toString().count("lag(") == 4
    physical = query.executedPlan().toString()
    assert physical.count("FileScan") == 1
    assert physical.count("Exchange hashpartitioning") == 1
