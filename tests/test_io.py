import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from barloom.operators import bricks
from barloom.sources import export
from barloom.sources.exchange import ExchangeBars, active_markets
from barloom.sources.store import BarStore
from barloom.streaming import bars as stream


def test_store_round_trip(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "bars"))
    store.write(make_bars(spark, [1, 2, 3], "btc/usdt"), "x", "1m")
    store.write(make_bars(spark, [7], "eth/usdt"), "x", "1m")
    assert store.read("x", "BTC_USDT", "1m", start=60).count() == 2
    store.merge(make_bars(spark, [9, 9], "btc/usdt", start=120), "x", "1m")
    got = [r.close for r in store.read("x", "BTC_USDT").orderBy("ts").collect()]
    assert got == [1, 2, 9, 9]
    assert {r.symbol: r.records for r in store.catalogue().collect()} == {"BTC_USDT": 4, "ETH_USDT": 1}
    assert store.missing("x", "1m", 0, 300).where("symbol = 'ETH_USDT'").count() == 1
    store.delete("x", "ETH_USDT", "1m")
    assert store.read("x", "ETH_USDT").count() == 0
    with pytest.raises(ValueError):
        store.write(make_bars(spark, [1]), "x", "7m")


def test_range_filter_reaches_the_scan(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "bars"))
    store.write(make_bars(spark, [1, 2, 3]), "x", "1m")
    plan = store.read("x", "A", "1m", start=60).select("close")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,60)" in plan and "PartitionFilters: [isnotnull(exchange" in plan


def test_exchange_source(spark):
    spark.dataSource.register(ExchangeBars)
    df = spark.read.format("exchange_bars").options(adapter="barloom.sources.exchange.RandomWalk", symbols="A,BB", seconds=60, start=0, stop=6000, limit=20, pages=2).load()
    assert df.groupBy("symbol").count().collect()[0]["count"] == 101
    assert df.select("symbol", "ts").distinct().count() == df.count() == 202


def test_active_markets(spark):
    m = spark.createDataFrame([("B", "U", True, "spot"), ("A", "U", True, "spot"), ("A", "U", True, "spot"), ("C", "U", False, "spot"), ("D", "U", True, "swap")], "base string, quote string, active boolean, type string")
    assert [r.symbol for r in active_markets(m).collect()] == ["A/U", "B/U"]
    assert [r.symbol for r in active_markets(m, True).collect()] == ["D/U"]


def test_exports(spark, tmp_path):
    points = spark.createDataFrame([(1, 2, 10, 0.12345, "low")], "bucket long, minutes_remaining long, samples long, probability double, confidence string")
    assert '"probability": 0.1235' in export.surface_json(points, 0.5, {"a": 1}) or '"probability": 0.1234' in export.surface_json(points, 0.5, {"a": 1})
    assert "<table>" in export.surface_html(points, 0.5, "t")
    for kind in ("csv", "json", "parquet"):
        export.write(points, str(tmp_path / kind), kind)
    with pytest.raises(ValueError):
        export.write(points, str(tmp_path / "x"), "xml")


def batches(spark, tmp_path, bars, parts):
    """A file stream of the bars, a file at a time."""
    for i, (a, b) in enumerate(parts):
        bars.where(F.col("ts").between(a, b)).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    return spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streamed_bricks_equal_batch(spark, tmp_path):
    b = make_bars(spark, [(100, 100, 100, 100), (100, 133, 99, 130), (130, 131, 95, 96), (96, 120, 96, 118), (118, 150, 117, 150)])
    df = batches(spark, tmp_path, b, [(0, 300)])
    run(stream.streamed_bricks(df, 10.0), tmp_path, "bricks")
    want = bricks.renko(b, 10.0).orderBy("ts", "seq").select("open", "close").collect()
    assert spark.table("bricks").orderBy("ts", "seq").select("open", "close").collect() == want


def test_streamed_atr_bricks_equal_batch(spark, tmp_path):
    import random

    rng, price, rows = random.Random(2), 100.0, []
    for _ in range(60):
        start, price = price, price + rng.uniform(-9, 9)
        rows.append((start, max(start, price) + 2, min(start, price) - 2, price))
    b = make_bars(spark, rows)
    df = batches(spark, tmp_path, b, [(0, 240), (241, 1200), (1201, 9999)])
    run(stream.streamed_atr_bricks(df, 14), tmp_path, "atrbricks")
    want = bricks.atr_renko(b, 14).orderBy("ts", "seq").select("ts", "open", "close").collect()
    got = spark.table("atrbricks").orderBy("ts", "seq").select("ts", "open", "close").collect()
    assert len(want) > 10 and [r.ts for r in got] == [r.ts for r in want]
    assert all(abs(x - y) < 1e-9 for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True))


def test_streamed_heiken_ashi_equals_batch(spark, tmp_path):
    b = make_bars(spark, [(1, 4, 1, 3), (3, 5, 2, 4), (4, 6, 3, 5)])
    df = batches(spark, tmp_path, b, [(0, 300)])
    run(stream.streamed_heiken_ashi(df), tmp_path, "ha")
    assert spark.table("ha").orderBy("ts").select("open", "close").collect() == bricks.heiken_ashi(b).orderBy("ts").select("open", "close").collect()


def test_merge_into(spark, tmp_path):
    b = make_bars(spark, [1, 2, 3])
    df = batches(spark, tmp_path, b, [(0, 300)])
    stream.merge_into(df, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert stream.merged(spark, str(tmp_path / "t")).count() == 3
