from conftest import make_bars
from pyspark.sql import functions as F

from barloom.operators import bars as B
from barloom.operators import bricks

import pytest


def rows(df, *cols, order=("symbol", "ts")):
    return [tuple(r) for r in df.orderBy(*order).select(*cols).collect()]


def test_aggregate_takes_first_and_last(spark):
    b = make_bars(spark, [(1, 5, 1, 2), (2, 9, 0, 3), (3, 4, 2, 4)], step=60)
    assert rows(B.aggregate(b, 120), "ts", "open", "high", "low", "close", "volume") == [(0, 1, 9, 0, 3, 2), (120, 3, 4, 2, 4, 1)]


def test_ratio_is_checked():
    assert B.check_ratio(60, 3600) == 60
    with pytest.raises(ValueError):
        B.check_ratio(3600, 60)
    with pytest.raises(ValueError):
        B.check_ratio(3600, 5400)


def test_resample_four_hours(spark):
    b = make_bars(spark, [(100, 101, 99, 102), (102, 104, 101, 105), (105, 107, 104, 108), (108, 111, 107, 110)], step=3600, start=1700006400)
    assert rows(B.resample(b, "4h"), "open", "close") == [(100, 110)]


def test_calendar_week_begins_on_monday(spark):
    b = make_bars(spark, [1, 2], step=86400 * 3, start=1704499200)  # a Saturday
    assert [r[0] % 86400 for r in rows(B.resample(b, "1w"), "ts")] == [0, 0]
    assert rows(B.resample(b, "1w"), "ts") == [(1704067200,), (1704672000,)]


def test_merge_lets_the_later_source_win(spark):
    a, b = make_bars(spark, [1, 2, 3]), make_bars(spark, [9, 8], start=60)
    assert rows(B.merge_latest([a, b]), "ts", "close") == [(0, 1), (60, 9), (120, 8)]


def test_irregularities(spark):
    b = spark.createDataFrame([("A", t, i) for i, t in enumerate([0, 60, 60, 30, 300])], "symbol string, ts long, i int")
    assert rows(B.irregularities(b, 60, "i"), "kind", order=("ts",)) == [("out_of_order",), ("duplicate",), ("gap",)]


def test_missing_ranges_are_clipped_and_joined(spark):
    b = make_bars(spark, [1, 1], step=300, start=600)
    assert rows(B.missing_ranges(b, 60, 0, 1000), "start", "stop", order=("start",)) == [(0, 599), (660, 899), (960, 1000)]


def test_coalesce_intervals(spark):
    i = spark.createDataFrame([("A", 0, 10), ("A", 11, 20), ("A", 5, 7), ("A", 30, 31)], "symbol string, start long, stop long")
    assert rows(B.coalesce_intervals(i), "start", "stop", order=("start",)) == [(0, 20), (30, 31)]


def test_as_of_sees_closed_bars_only(spark):
    b = make_bars(spark, [1, 2, 3, 4], step=60)
    out = B.as_of_higher(b, B.aggregate(b, 120), 120, ["close"])
    assert rows(out, "ts", "h_close") == [(0, None), (60, None), (120, 2), (180, 2)]


def test_coarsest_source():
    assert B.coarsest_source(["1m", "15m", "2h"], "1h") == "15m"
    assert B.coarsest_source(["1d"], "1h") is None


def test_heiken_ashi_values(spark):
    b = make_bars(spark, [(100, 110, 90, 105), (105, 115, 100, 110)])
    assert rows(bricks.heiken_ashi(b), "open", "high", "low", "close") == [(102.5, 110, 90, 101.25), (101.875, 115, 100, 107.5)]


@pytest.mark.parametrize(
    ("bars", "made"),
    [
        ([(100, 100, 100, 100), (100, 150, 100, 150)], [10] * 5),
        ([(100, 100, 100, 100), (100, 120, 100, 120), (120, 121, 90, 90)], [10, 10, -10, -10, -10]),
        ([(100, 100, 100, 100), (100, 110, 100, 110)], [10]),
        ([(100, 100, 100, 100), (100, 105, 95, 100)], []),
    ],
)
def test_renko(spark, bars, made):
    out = bricks.renko(make_bars(spark, bars), 10.0)
    assert [r.close - r.open for r in out.orderBy("seq").collect()] == made


def test_renko_splits_volume(spark):
    out = bricks.renko(make_bars(spark, [(100, 100, 100, 100), (100, 150, 100, 150)]), 10.0)
    assert out.agg(F.sum("volume")).first()[0] == pytest.approx(1.0)


def test_empty_series(spark):
    e = make_bars(spark, [1]).where("false")
    for out in (B.aggregate(e, 120), B.merge_latest([e, e]), B.catalogue(e), bricks.heiken_ashi(e), bricks.renko(e, 1.0), B.irregularities(e, 60)):
        assert out.count() == 0


@pytest.mark.parametrize("rows", [3, 7, 4096])
def test_renko_in_blocks(spark, rows):
    """Blocks of any size lay the bricks of the whole series, also where a bar spans many bricks both ways."""
    import random

    rng, bars, price = random.Random(rows), [], 100.0
    for _ in range(300):
        o, price = price, price + rng.gauss(0, 4)
        bars.append((o, max(o, price) + rng.random() * rng.choice([1, 9, 40]), min(o, price) - rng.random() * rng.choice([1, 9, 40]), price))
    b = make_bars(spark, bars).unionByName(make_bars(spark, bars[:40], symbol="B", step=7)).unionByName(make_bars(spark, [100.0] * 9, symbol="C"))
    key = lambda df: {(r.symbol, r.seq): r for r in df.collect()}
    one, many = key(bricks.renko(b, 5.0)), key(bricks.renko(b, 5.0, 60, rows))
    assert one.keys() == many.keys() and len(one) > 500
    for k, r in one.items():
        assert (r.ts, r.volume) == (many[k].ts, many[k].volume)
        assert [r.open, r.high, r.low, r.close] == pytest.approx([many[k].open, many[k].high, many[k].low, many[k].close])


@pytest.mark.parametrize("block_bars", [1, 3, 512])
def test_as_of_in_blocks(spark, block_bars):
    """Any size of blocks gives the last closed higher bar, also where blocks in between have none."""
    times = [0, 60, 120, 600, 660, 5000, 5060, 90_000, 90_060]
    bars = spark.createDataFrame([(s, t, float(t)) for s in "AB" for t in times if s == "A" or t < 700], "symbol string, ts long, close double")
    higher = spark.createDataFrame([(s, t, float(t)) for s in "AB" for t in (0, 120, 600, 4920)], "symbol string, ts long, close double")
    got = {(r.symbol, r.ts): r.h_close for r in B.as_of_higher(bars, higher, 120, ["close"], block_bars).collect()}
    want = {(s, t): max([float(h) for h in (0, 120, 600, 4920) if h + 120 <= t], default=None) for s, t in got}
    assert got == want and len(got) == 14
