"""Every registered query against its SQL oracle, on the smallest tables."""

import math

import duckdb
import pytest

from quarry.plans import registry
from quarry.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = ", ".join(f'"{c}"' for c in columns)
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect())
    assert got == sorted(repr(tuple(map(plain, r))) for r in want.select(order).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
