"""Every registered query that has SQL equals it, on the smallest data set."""

import glob
import os
from collections import Counter

import pytest

from feedloom.plans import catalog, catalog_more, catalog_pages, catalog_profiles, catalog_state, catalog_streams, catalog_values  # noqa: F401

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def told(x):
    return f"{x:.9g}" if isinstance(x, float) else None if x is None else str(x)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    want = duck.execute(catalog.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == sorted(found.columns)
    rows = Counter(tuple(map(told, r)) for r in found.collect())
    assert rows == Counter(tuple(told(r[at[c]]) for c in found.columns) for r in want.fetchall())
