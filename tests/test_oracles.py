"""Every query with SQL gives what DuckDB gives on the same small tables."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestrum.plans import registry

registry.load()
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows(table, cols):
    return sorted(map(repr, (tuple(plain(r[c]) for c in cols) for r in table.to_pylist())))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = duck.sql(registry.ORACLES[name]).arrow()
    want = want.read_all() if hasattr(want, "read_all") else want
    assert sorted(want.column_names) == cols
    assert rows(df.toArrow(), cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
