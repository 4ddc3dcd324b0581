"""Every registered query that has SQL gives the rows that DuckDB gives; the others run."""

import math
import os

import duckdb
import pandas as pd
import pytest

from barloom import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(frame):
    plain = lambda x: None if x is None or x is pd.NA or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, int) and not isinstance(x, bool) else x
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(tuple(plain(x) for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    want = con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_names_of_sql():
    assert set(registry.oracle_sql()) <= set(registry.queries())
