import random

import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from barloom.operators import signals
from barloom.streaming.signals import STATE_STORE, step, streamed_signals

GIVEN = "signal_id string, symbol string, direction string, entry_price double, stop_loss double, take_profit double, trailing_percent double, high_water_mark double, entry_ts long"


def walk(seed, n=200):
    rng, price, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o, price = price, price * (1 + rng.gauss(0, 0.01))
        out.append((o, max(o, price) * 1.003, min(o, price) * 0.997, price))
    return out


def some_signals(spark, n=60):
    rng, rows = random.Random(9), []
    for i in range(n):
        way, at = rng.choice(["long", "short"]), 60 * rng.randint(0, 150)
        sign = 1 if way == "long" else -1
        price = 100.0 + rng.gauss(0, 5)
        pick = lambda x: rng.choice([x, None])
        rows.append((f"s{i}", rng.choice("AB"), way, price, pick(price * (1 - sign * 0.04)), pick(price * (1 + sign * 0.06)), pick(rng.choice([2.0, 5.0])), pick(price * (1 + sign * 0.01)), at))
    return spark.createDataFrame(rows, GIVEN)


@pytest.mark.parametrize("cuts", [[200], [37, 80, 200]])
def test_streamed_outcomes_equal_the_batch(spark, tmp_path, cuts):
    bars = make_bars(spark, walk(1), symbol="A").unionByName(make_bars(spark, walk(2), symbol="B"))
    given = some_signals(spark)
    given.coalesce(1).write.parquet(str(tmp_path / "signals"))
    for i, (a, b) in enumerate(zip([0, *cuts], cuts, strict=False)):
        bars.where((F.col("ts") >= 60 * a) & (F.col("ts") < 60 * b)).coalesce(1).write.parquet(str(tmp_path / f"bars/{i}"))
    spark.conf.set(*STATE_STORE)
    try:
        stream = lambda df, p: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(p)
        out = streamed_signals(stream(given, str(tmp_path / "signals")), stream(bars, str(tmp_path / "bars/*")))
        name = f"outcomes{len(cuts)}"
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert q.exception() is None
        got = {r.signal_id: r for r in spark.table(name).collect()}
    finally:
        spark.conf.unset(STATE_STORE[0])
    want = {r.signal_id: r for r in signals.evaluate(given, bars).where("status <> 'open'").collect()}
    assert got.keys() == want.keys() and len({r.exit_reason for r in want.values()}) == 3 and len(want) > 30
    for k, r in want.items():
        assert (r.symbol, r.direction, r.status, r.exit_reason, r.exit_ts) == (got[k].symbol, got[k].direction, got[k].status, got[k].exit_reason, got[k].exit_ts)
        assert [r.exit_price, r.pnl_percent, r.high_water_mark] == pytest.approx([got[k].exit_price, got[k].pnl_percent, got[k].high_water_mark])


def test_a_trail_follows_its_mark():
    """The mark moves with the bar's high before the trail is tested."""
    s = {"direction": "long", "mark": 50000.0, "stop_loss": None, "take_profit": None, "trailing_percent": 5.0}
    assert step(s, 51000, 49000, 50500) is None and s["mark"] == 51000
    assert step(s, 50600, 47000, 48000) == ("trailing_stop", pytest.approx(48600.0))
