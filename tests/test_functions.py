import numpy as np
import pytest
from conftest import make_bars
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import conditions as C
from barloom.functions import indicators as I
from barloom.functions import kernels as K
from barloom.functions.candles import PATTERNS
from barloom.functions.indicators import Spec
from barloom.functions.kernels import RECURSIVE
from barloom.functions.windowed import WINDOWED, Series


def column(df, name):
    return [r[0] for r in df.orderBy("ts").select(name).collect()]


def condition(spark, values, f):
    df = spark.createDataFrame([("A", i, None if v is None else float(v)) for i, v in enumerate(values)], "symbol string, ts long, x double")
    return column(df.withColumn("c", f(F.col("x"), Series().window)), "c")


def test_persisted_for(spark):
    df = spark.createDataFrame([("A", i, float(v)) for i, v in enumerate([3, 5, 6, 3])], "symbol string, ts long, x double").withColumn("a", C.above(F.col("x"), F.lit(4.0)))
    assert column(df.withColumn("c", C.persisted_for(F.col("a"), Series().window, 2)), "c") == [False, False, True, False]


def test_crosses(spark):
    up = condition(spark, [1, 2, 3, 2, None, 5], lambda x, w: C.crosses_above(x, F.lit(2.0), w))
    assert up == [False, False, True, False, False, False]
    down = condition(spark, [3, 1, 3, 1], lambda x, w: C.crosses_below(x, F.lit(2.0), w))
    assert down == [False, True, False, True]


def test_within_last_and_became(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([True, False, False, True, True])], "symbol string, ts long, a boolean")
    w = Series().window
    assert column(df.withColumn("c", C.within_last(F.col("a"), w, 2)), "c") == [True, True, False, True, True]
    assert column(df.withColumn("c", C.just_became(F.col("a"), w)), "c") == [False, False, False, True, False]


def test_null_compares_as_false(spark):
    assert condition(spark, [None, 1], lambda x, w: C.at_least(x, F.lit(0.0))) == [False, True]
    assert condition(spark, [1, 2, 3], lambda x, w: C.is_rising(x, w, 2)) == [False, False, True]


def sample(spark, n=80):
    i = np.arange(n)
    p = 100 + 10 * np.sin(0.3 * i) + 0.5 * i
    data = [(float(p[k]), float(p[k] + 3 * abs(np.sin(0.7 * k))), float(p[k] - 3 * abs(np.cos(0.7 * k))), float(p[k] + 0.2 * np.sin(0.2 * k))) for k in range(n)]
    data = [(o, max(h, o, c), min(low, o, c), c) for o, h, low, c in data]
    return make_bars(spark, data, step=3600, start=1700000000), data


@pytest.mark.parametrize("period", [1, 2, 7])
def test_means_match_brute_force(spark, period):
    b, data = sample(spark)
    out = I.compute(b, [Spec("sma", {"period": period}), Spec("wma", {"period": period}), Spec("trima", {"period": period})])
    close = np.array([r[3] for r in data])
    for k, (s, w) in enumerate(zip(column(out, "sma"), column(out, "wma"), strict=True)):
        if k < period - 1:
            assert s is None and w is None
        else:
            part = close[k - period + 1 : k + 1]
            assert s == pytest.approx(part.mean())
            assert w == pytest.approx(np.average(part, weights=np.arange(1, period + 1)))


FIRST = {"ema": 9, "dema": 18, "tema": 27, "rsi": 10, "cmo": 10, "atr": 10, "natr": 10, "plus_dm": 9, "plus_di": 10, "dx": 10, "adx": 19, "adxr": 28, "kama": 10, "trix": 28}


@pytest.mark.parametrize("name", sorted(FIRST))
def test_first_defined_bar(spark, name):
    _, data = sample(spark)
    arrays = {c: np.array([r[i] for r in data]) for i, c in enumerate(("open", "high", "low", "close"))} | {"volume": np.ones(len(data))}
    out = K.RECURSIVE[name](arrays, 10)[name]
    assert int(np.argmax(~np.isnan(out))) == FIRST[name]
    assert not np.isnan(out[FIRST[name] :]).any()


def test_macd_starts_with_its_signal():
    x = np.cumsum(np.ones(60))
    m = K.macd({"close": x}, 12, 26, 9)
    assert all(int(np.argmax(~np.isnan(v))) == 33 for v in m.values())


def test_ema_of_constant_is_constant():
    assert np.nanmax(np.abs(K.ema_of(np.full(30, 5.0), 7) - np.where(np.arange(30) < 6, np.nan, 5.0))) == 0


def test_every_indicator_runs(spark):
    b, _ = sample(spark)
    specs = [Spec(n, {}, f"i_{n}") for n in I.names() if n not in PATTERNS]
    out = I.compute(b, specs)
    assert out.count() == 80 and len(out.columns) > 100
    assert len(I.names()) >= 161


def test_unknown_indicator(spark):
    with pytest.raises(KeyError):
        I.compute(sample(spark)[0], [Spec("nope")])


def test_patterns_are_zero_or_hundred(spark):
    b, _ = sample(spark)
    out = I.compute(b, [Spec(n) for n in sorted(PATTERNS)])
    assert len(PATTERNS) == 61
    values = {v for r in out.select(*sorted(PATTERNS)).collect() for v in r}
    assert values <= {-100, 0, 100}


def test_engulfing(spark):
    flat = [(10, 10.5, 9.5, 10.2)] * 16
    out = I.compute(make_bars(spark, [*flat, (10, 10.1, 8.9, 9), (8.8, 11, 8.7, 10.8)]), [Spec("cdlengulfing")])
    assert column(out, "cdlengulfing")[-1] == 100


def test_custom_indicator(spark):
    I.register_windowed("doubled", lambda s: {"doubled": s["close"] * 2})
    try:
        assert column(I.compute(make_bars(spark, [1, 2]), [Spec("doubled")]), "doubled") == [2, 4]
    finally:
        WINDOWED.pop("doubled")


@pytest.mark.parametrize("rows", [3, 7, 4096])
def test_parallel_recursions_equal_kernels(spark, rows):
    """Blocks of any size, with gaps between bars, give what one pass over the series gives."""
    from barloom.functions import scan
    from barloom.operators.bricks import heiken_ashi

    b, _ = sample(spark)
    b = b.where("ts % 7 <> 3").unionByName(b.withColumn("symbol", F.lit("B")).limit(30))
    want = I.compute(b, [Spec("ema", {"period": 10}), Spec("atr", {"period": 10})])
    key = lambda df, c: {(r.symbol, r.ts): r[c] for r in df.collect()}
    for name, got in (("ema", scan.ema(b, 10, 3600, rows)), ("atr", scan.atr(b, 10, 3600, rows))):
        a, w = key(got, name), key(want, name)
        assert a.keys() == w.keys()
        assert all((a[k] is None) == (w[k] is None) and (w[k] is None or a[k] == pytest.approx(w[k])) for k in w)
    specs = [Spec(n, {"period": 5}, f"{n}_x") for n in ("rsi", "cmo", "atr", "natr", "ema")] + [Spec("sma", {"period": 3}), Spec("trix", {"period": 3})]
    one, many = I.compute(b, specs), I.compute(b, specs, seconds=3600)
    assert sorted(one.columns) == sorted(many.columns)
    for name in ("rsi_x", "cmo_x", "atr_x", "natr_x", "ema_x", "sma", "trix"):
        a, w = key(many, name), key(one, name)
        assert all((a[k] is None) == (w[k] is None) and (w[k] is None or a[k] == pytest.approx(w[k])) for k in w), name
    a, w = key(scan.ewma_volatility(b, 10, 3600, rows), "volatility"), key(I.compute(b, [Spec("ewma_volatility", {"lookback": 10}, "volatility")]), "volatility")
    assert all(a[k] == pytest.approx(w[k]) for k in w)
    a, w = key(I.compute(b, [Spec("sma", {"period": 3}, source="hlc3")]), "sma"), key(I.compute(b.withColumn("close", (F.col("high") + F.col("low") + F.col("close")) / 3), [Spec("sma", {"period": 3})]), "sma")
    assert a == w
    a, w = key(scan.heiken_ashi_open(b, 3600, rows), "ha_open"), key(heiken_ashi(b), "open")
    assert all(a[k] == pytest.approx(w[k]) for k in w)


def test_short_series_have_no_mean(spark):
    from barloom.functions import scan

    out = scan.ema(make_bars(spark, [1, 2, 3]), 10, 60)
    assert column(out, "ema") == [None, None, None]
    assert scan.block_rows(1 / 3) < 500


def series(spark, n=420):
    """Two series of bars with gaps, bars much closer than the usual distance, and repeated times."""
    rng, rows = np.random.default_rng(4), []
    for symbol in ("A", "B"):
        price, ts = 100.0, 0
        for i in range(n if symbol == "A" else 100):
            ts += int(rng.choice([3600, 3600, 6, 0, 36000]))
            o, price = price, price * float(np.exp(rng.normal() / 50))
            rows.append((symbol, ts, o, max(o, price) + float(rng.random()), min(o, price) - float(rng.random()), price, float(rng.integers(1, 40))))
    return spark.createDataFrame(rows, "symbol string, ts long, open double, high double, low double, close double, volume double")


def by_bar(df, name):
    found = {}
    for r in df.select("symbol", "ts", "open", "high", "low", "close", "volume", name).collect():
        found[tuple(r)[:7]] = r[name]
    return found


TYPES = [Spec(n, {"ma_type": t}, f"{n}{t}") for n in ("ma", "apo", "ppo", "stoch", "bbands") for t in (0, 1, 2, 5)] + [Spec("macdext", {"fast_type": t, "slow_type": t, "signal_type": t}, f"macdext{t}") for t in (0, 2, 3)]


@pytest.mark.parametrize("rows", [100, 131])
def test_all_indicators_in_blocks(spark, rows):
    """Every indicator that runs in blocks gives what the whole series gives, however irregular its times are."""
    b = series(spark).where("symbol = 'A' or ts % 2 = 0").distinct()
    ordered = b.withColumn("_t", F.row_number().over(Window.partitionBy("symbol").orderBy("ts", "open", "high", "low", "close", "volume")))
    sliding = [Spec(n) for n in sorted({*WINDOWED} - {"add", "sub", "mult", "div", "acos", "asin", "ad", "obv"})]
    specs = sliding + [Spec(n) for n in sorted(RECURSIVE) if not n.startswith("ht_") and n not in ("mama", "sar", "sarext", "ma", "macdext", "macd", "bbands", "stoch")] + TYPES
    specs += [Spec("ad"), Spec("obv"), Spec("kama", {"period": 4}, "quick"), Spec("trix", {"period": 3}, "short"), Spec("adxr", {"period": 5}, "calm"), Spec("macd", {"fast": 5, "slow": 3, "signal": 4}, "turned"), Spec("dema", {"period": 7}, "mid", "hlc3")]
    specs += [Spec(n) for n in sorted(PATTERNS)[:: 8 if rows > 100 else 11]]
    specs = list({s.prefix: s for s in specs}.values())
    one, many = I.compute(ordered, specs, order="_t").persist(), I.compute(b, specs, seconds=3600, rows=rows).persist()
    names = [c for c in many.columns if c not in b.columns]
    assert sorted(names) == sorted(c for c in one.columns if c not in (*b.columns, "_t"))
    key = lambda r: (r.symbol, r.ts, r.open, r.close)
    want, got = ({key(r): r for r in df.collect()} for df in (one, many))
    assert want.keys() == got.keys() and len(got) > 3 * rows
    for name in names:
        for k, r in want.items():
            x, y = r[name], got[k][name]
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-7, abs=1e-7)), (name, k, x, y)


def test_blocks_are_tasks(spark):
    """The plan of blocked windows deals out blocks, and no window spans a whole series."""
    b = series(spark)
    df = I.compute(b, [Spec("sma", {"period": 5}), Spec("cdldoji")], seconds=3600, rows=128)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "_offset" not in line and "sum(_n" not in line]
    assert windows and all("_block" in line or "_coarse" in line for line in windows)
