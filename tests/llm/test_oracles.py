"""Registered text queries against their SQL, on the smallest data set."""

import glob
import os
from collections import Counter

import pytest

from feedloom.llm.oracles import ORACLES
from feedloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = QUERIES[name](spark, DATA)
    want = con.execute(ORACLES[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert sorted(at) == sorted(found.columns)
    assert Counter(map(tuple, found.collect())) == Counter(tuple(r[at[c]] for c in found.columns) for r in want.fetchall())
