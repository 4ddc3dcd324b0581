import os
import struct

import pytest
from conftest import make_bars

from barloom.sources import barfiles

COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume")


def rows(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def archives(path):
    return sorted(f for f in os.listdir(path) if f.endswith(".bars"))


def test_round_trip(spark, tmp_path):
    bars = make_bars(spark, [1.5, 2.5, 3.25]).unionByName(make_bars(spark, [7.0, 8.0], symbol="BTC_USDT"))
    barfiles.write(bars, str(tmp_path), "1m")
    back = barfiles.read(spark, str(tmp_path))
    assert rows(back) == rows(bars)
    assert {(r.timeframe, r.data_type) for r in back.collect()} == {("1m", "ohlcv")}
    assert not [f for f in os.listdir(tmp_path) if f.startswith(".") and f.endswith(".bars")]


def test_layout_of_a_file(spark, tmp_path):
    """Big-endian header of 64 bytes and records of 48, as other programs write them."""
    barfiles.write(make_bars(spark, [(1, 4, 0.5, 2)], symbol="ETH_USDT", start=120), str(tmp_path), "1m", "renko", 10.0)
    (name,) = archives(tmp_path)
    raw = (tmp_path / name).read_bytes()
    assert len(raw) == 64 + 48
    assert raw[:8] == b"STCHXBF1" and struct.unpack(">HHHBBQ", raw[8:24]) == (2, 64, 48, 1, 3, 1)
    assert raw[24:40] == b"ETH_USDT".ljust(16, b"\0") and raw[40:44] == b"1m\0\0" and struct.unpack(">d", raw[44:52]) == (10.0,)
    assert struct.unpack(">Q5d", raw[64:]) == (120, 1.0, 4.0, 0.5, 2.0, 1.0)


@pytest.mark.parametrize(("start", "stop"), [(None, None), (300, None), (None, 300), (301, 899), (300, 900), (5000, 9000), (900, 300)])
def test_bounds_read_only_their_records(spark, tmp_path, start, stop):
    bars = make_bars(spark, [float(i) for i in range(50)])
    barfiles.write(bars, str(tmp_path), "1m", bars_per_file=20)
    assert len(archives(tmp_path)) == 3
    want = [r for r in rows(bars) if (start is None or r[1] >= start) and (stop is None or r[1] <= stop)]
    assert rows(barfiles.read(spark, str(tmp_path), start, stop)) == want
    options = {"path": str(tmp_path), "split": "7"} | ({"start": start} if start is not None else {}) | ({"stop": stop} if stop is not None else {})
    parts = barfiles.Reader(options).partitions()
    assert sum(p.last - p.first for p in parts) == len(want) and all(p.last - p.first <= 7 for p in parts)


def test_filters_are_pushed_down(spark, tmp_path):
    bars = make_bars(spark, [float(i) for i in range(50)]).unionByName(make_bars(spark, [1.0] * 9, symbol="B"))
    barfiles.write(bars, str(tmp_path), "1m")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        part = barfiles.read(spark, str(tmp_path)).where("ts > 600 and ts <= 1200 and symbol = 'A'")
        assert rows(part) == [r for r in rows(bars) if 600 < r[1] <= 1200 and r[0] == "A"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    reader = barfiles.PushingReader({"path": str(tmp_path)})
    list(reader.pushFilters([GreaterThan(("ts",), 600), LessThanOrEqual(("ts",), 1200), EqualTo(("symbol",), "A")]))
    assert [(p.first, p.last) for p in reader.partitions()] == [(11, 21)]


def test_headers_are_checked_and_repaired(spark, tmp_path):
    barfiles.write(make_bars(spark, [1.0, 2.0, 3.0]), str(tmp_path), "1m")
    (name,) = archives(tmp_path)
    with open(tmp_path / name, "ab") as f:  # a writer that died before it counted, in the middle of a record
        f.write(struct.pack(">Q5d", 180, 4, 4, 4, 4, 1) + b"\0" * 20)
    assert [r[1] for r in rows(barfiles.read(spark, str(tmp_path)))] == [0, 60, 120, 180]
    r = barfiles.describe(spark, str(tmp_path)).first()
    assert (r.header_records, r.records, r.agrees) == (3, 4, False)
    assert barfiles.repair(str(tmp_path)) == 1 and barfiles.repair(str(tmp_path)) == 0
    (tmp_path / "other.bars").write_bytes(b"no archive" * 10)
    with pytest.raises(barfiles.BadFile):
        barfiles.Reader({"path": str(tmp_path)}).partitions()


def test_an_aborted_job_leaves_nothing(tmp_path):
    writer = barfiles.Writer({"path": str(tmp_path), "timeframe": "1m"})
    import pyarrow as pa

    batch = pa.table({"symbol": ["A", "A"], "file": [0, 0], "ts": [0, 60], **{c: [1.0, 2.0] for c in COLUMNS[2:]}}).to_batches()
    message = writer.write(iter(batch))
    assert len(os.listdir(tmp_path)) == 1 and not archives(tmp_path)[0].startswith("A")
    writer.abort([message, None])
    assert os.listdir(tmp_path) == []
