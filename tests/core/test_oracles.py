"""Every query of the library that has SQL gives the SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from courtflux.plans.catalog import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in sorted(x.removesuffix(".parquet") for x in os.listdir(FOLDER)):
        path = f"{FOLDER}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(x):
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in sorted(x.items()))
    if isinstance(x, list):
        return tuple(map(plain, x))
    return None if isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, float) else x


def ordered(names, rows):
    by = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in by], sorted((tuple(plain(r[i]) for i in by) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows(spark, tables, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    found = tables.execute(ORACLE[name])
    names = [c[0] for c in found.description]
    rows = [tuple(r.values()) for r in got.to_pylist()]
    assert ordered(got.column_names, rows) == ordered(names, found.fetchall())
