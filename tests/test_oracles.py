"""Every registered plan with SQL against that SQL on another engine, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from tidewatch.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v.replace(tzinfo=None)) if hasattr(v, "hour") else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_plan_equals_sql(spark, small, sql, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    result = sql.execute(registry.ORACLES[name])
    given = [x[0] for x in result.description]
    assert sorted(given) == columns
    expected = sorted(tuple(plain(r[given.index(c)]) for c in columns) for r in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_plan_without_sql_runs(spark, small, name):
    assert registry.QUERIES[name](spark, small).count() > 0
