"""Every query of the catalogue against the same question in SQL."""

import math
import os

import duckdb
import pytest

from memlattice import catalog


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    return sorted([_norm(r[c]) for c in columns] for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in os.listdir(sf):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{sf}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equal(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cur = duck.execute(catalog.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    kinds = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    told = {d[0]: str(d[1]) for d in cur.description}
    assert {c: kinds[t] for c, t in df.dtypes} == told
    assert rows_of(columns, df.collect()) == rows_of(columns, [dict(zip(names, r, strict=True)) for r in cur.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
