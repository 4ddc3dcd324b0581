import os
import threading

import pytest
from conftest import make_bars
from pyspark.sql import functions as F

from barloom.operators.opencross import SurfaceConfig, surface
from barloom.operators.surfacestore import SurfaceStore
from barloom.sources.versions import Conflict, Manifest, VersionedTable

SCHEMA = "symbol string, ts long, open double, high double, low double, close double, volume double"


def files(path):
    return {os.path.relpath(os.path.join(d, f), path): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.select("symbol", "ts", "close").collect()))


def test_merges_write_what_they_touch(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, 3600)
    t.merge(make_bars(spark, [1.0] * 240))  # four hours
    before = files(tmp_path / "t")
    t.merge(make_bars(spark, [9.0] * 3, start=3600))
    new = set(files(tmp_path / "t")) - set(before)
    assert len(before) == 4 and len(new) == 1
    got = dict((r[1], r[2]) for r in rows(t.read()))
    assert len(got) == 240 and [got[3600 + 60 * i] for i in range(4)] == [9.0, 9.0, 9.0, 1.0]


def test_readers_see_one_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, 3600)
    t.merge(make_bars(spark, [1.0] * 120))
    old = t.read()
    t.merge(make_bars(spark, [5.0] * 120))
    assert {r[2] for r in rows(old)} == {1.0} and {r[2] for r in rows(t.read())} == {5.0}
    assert {r[2] for r in rows(t.read(version=1))} == {1.0}


def test_old_versions_go(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, 3600)
    for k in range(5):
        t.merge(make_bars(spark, [float(k)] * 120), keep=2)
    assert t.versions() == [4, 5] and len(files(tmp_path / "t")) == 4
    t.vacuum(1)
    assert t.versions() == [5] and len(files(tmp_path / "t")) == 2 and len(rows(t.read())) == 120


def test_bounds_open_few_folders(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA, 3600)
    t.merge(make_bars(spark, [1.0] * 600))
    part = t.read(4000, 7000)
    assert len({f.rpartition("/")[0] for f in part.inputFiles()}) == 1
    assert [r[1] for r in rows(part)] == [x for x in range(0, 36_000, 60) if 4000 <= x <= 7000]


def test_a_batch_counts_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    assert t.merge(make_bars(spark, [1.0, 2.0]), 0).version == 1
    assert t.merge(make_bars(spark, [7.0, 7.0]), 0).version == 1
    assert t.merge(make_bars(spark, [3.0], start=60), 1).version == 2
    assert rows(t.read()) == [("A", 0, 1.0), ("A", 60, 3.0)]
    assert t.merge(make_bars(spark, [3.0]).where("false"), 2).version == 2


def test_a_version_is_published_once(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), SCHEMA)
    t._publish(Manifest(1, {}))
    with pytest.raises(Conflict):
        t._publish(Manifest(1, {0: "data/x"}))
    assert t.manifest() == Manifest(1, {})


def test_writers_that_meet(spark, tmp_path):
    """Two writers of other hours both end up in the table."""
    tables = [VersionedTable(spark, str(tmp_path / "t"), SCHEMA, 3600) for _ in range(2)]
    fresh = [make_bars(spark, [float(k + 1)] * 60, start=3600 * k) for k in range(2)]
    threads = [threading.Thread(target=t.merge, args=(f,), kwargs={"keep": 9}) for t, f in zip(tables, fresh, strict=True)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert {r[2] for r in rows(tables[0].read())} == {1.0, 2.0} and tables[0].versions() == [1, 2]


def test_an_updated_surface_equals_a_rebuilt_one(spark, tmp_path):
    import random

    rng, price, closes = random.Random(2), 100.0, []
    for _ in range(600):
        price *= 1 + rng.gauss(0, 0.002)
        closes.append((price, price * 1.001, price * 0.999, price * (1 + rng.gauss(0, 0.001))))
    bars = make_bars(spark, closes).unionByName(make_bars(spark, closes[::-1], symbol="B"))
    config = SurfaceConfig(15, 0.001, 5)
    store = SurfaceStore(spark, str(tmp_path / "s"), config, 3600)
    first = bars.where("ts < 20000 or ts % 7 > 0")
    store.update(first, first)
    before = files(tmp_path / "s")
    changed = bars.where("ts between 21000 and 21600").withColumn("close", F.col("close") * 1.01)
    now = bars.where("ts not between 21000 and 21600").unionByName(changed).where("symbol = 'A' or ts < 30000")
    store.update(now, bars.where("ts >= 20000"))
    key = lambda df: {(r.bucket, r.minutes_remaining): (r.samples, r.crosses, r.probability, r.confidence) for r in df.collect()}
    assert key(store.surface()) == key(surface(now, config))
    assert set(before) & set(files(tmp_path / "s"))  # untouched periods keep their files
    with pytest.raises(ValueError):
        SurfaceStore(spark, str(tmp_path / "v"), SurfaceConfig(volatility_lookback=20))
