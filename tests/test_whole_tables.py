"""Queries run over all ids of their tables, and equal their SQL."""

import glob
import os
from collections import Counter

import pytest

from feedloom.plans import catalog, catalog_more, catalog_pages, catalog_state, catalog_values  # noqa: F401

DATA = "/root/testdata/sf0.001"


def rows_of(rows):
    return Counter(tuple(None if x is None else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", ["d7_stated_years", "f5_match_contacts", "i16_split_cooldown", "h5_rank_contacts", "g15_undrafted_reason", "f9_correlate_mail"])
def test_whole_form_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = catalog.QUERIES[name](spark, DATA)
    want = con.execute(catalog.ORACLES[name])
    at = {d[0]: i for i, d in enumerate(want.description)}
    assert rows_of(found.collect()) == rows_of([tuple(r[at[c]] for c in found.columns) for r in want.fetchall()])


def test_no_id_is_left_out(spark):
    orders, people = (spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("orders", "customer"))
    years = {r["id"]: r["years"] for r in catalog.QUERIES["d7_stated_years"](spark, DATA).collect()}
    assert len(years) == orders and all(y is None for k, y in years.items() if k % 7 == 5)
    assert catalog.QUERIES["f5_match_contacts"](spark, DATA).where("tier = 1").count() == people
    assert catalog.QUERIES["f9_correlate_mail"](spark, DATA).count() == orders


def test_undrafted_tells_every_role_that_has_no_eligible_contact(spark):
    data = "/root/testdata/sf0.01"
    states = {}
    for (k,) in spark.read.parquet(f"{data}/customer.parquet").select("c_custkey").collect():
        state = "bounced_contact" if k % 6 == 1 else "cooldown" if k % 2 == 0 and k % 60 < 30 else "eligible"
        states.setdefault(k + (k % 40 == 7), set()).add(state)
    want = Counter()
    for key, customer in spark.read.parquet(f"{data}/orders.parquet").select("o_orderkey", "o_custkey").collect():
        found = states.get(customer, set())
        if key % 3 < 2 and "eligible" not in found:
            reason = "cooldown" if "cooldown" in found else "bounced_contact" if found else "no_contact"
            want[f"Role {key}", ("green", "yellow")[key % 3], reason] += 1
    assert {reason for _, _, reason in want} == {"no_contact", "cooldown", "bounced_contact"}
    assert rows_of(catalog.QUERIES["i17_undrafted"](spark, data).collect()) == want


@pytest.mark.parametrize("users", [range(0), range(0, 4000, 60), range(1500), range(0, 60000, 60), [u for u in range(600) if u % 60 < 3]])
def test_issue_text_lists_all_slugs_of_a_reason(spark, tmp_path, users):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    rows = " UNION ALL ".join(f"SELECT {k}::BIGINT AS event_id, u::BIGINT AS user_id, TIMESTAMP '2024-01-01' AS ts, '{kind}' AS event_type, 1.0::DOUBLE AS value FROM (SELECT unnest({list(users)}::BIGINT[]) AS u)" for k, kind in enumerate(("error", "error", "view")))
    con.execute(f"COPY ({rows} UNION ALL SELECT 9, 7, TIMESTAMP '2024-01-01', 'view', 1.0) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet')")
    want = con.execute(catalog.ORACLES["g10_issue_text"]).fetchall()
    assert [tuple(r) for r in catalog.QUERIES["g10_issue_text"](spark, str(tmp_path)).collect()] == want
