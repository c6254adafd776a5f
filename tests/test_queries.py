"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from threadloom import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert ours
        return
    rel = duck.sql(sql)
    names = list(rel.columns)
    assert sorted(names) == cols
    theirs = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert ours == theirs
