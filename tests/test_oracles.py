"""Every registered query of the engine against its SQL."""

import math
import os

import duckdb
import pytest

from palimpsest.plans.registry import oracle_sql, queries


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, small, duck, name):
    df = queries()[name](spark, small)
    rows = sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    columns = [c[0] for c in found.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(norm(r[i]) for i in order) for r in found.fetchall()) == rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
