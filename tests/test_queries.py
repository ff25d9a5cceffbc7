"""Every registered box query against its SQL over the smallest tables."""

import math
import os

import __spark_entry__ as entry
import duckdb
import pytest
from quadrat import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(rows):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "~"
        if isinstance(v, float):
            return str(int(v)) if v == int(v) else repr(round(v, 9))
        return str(v)

    return sorted(tuple(map(value, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(name, spark, duck, sf):
    df = registry.queries()[name](spark, sf)
    result = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = plain([tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()])
    assert plain(tuple(r[c] for c in sorted(names)) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(name, spark, sf):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
