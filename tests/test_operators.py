"""Operators over small tables."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions.filters import Profile
from feedloom.operators import decide, normalise, outreach, urls
from feedloom.sources import readers


def ts(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def test_json_boards(spark):
    spec = normalise.JsonSpec("jobs array<struct<id:string,title:string,open:boolean>>", "jobs", {"external_id": "item.id", "job_title": "item.title", "job_url": "concat('https://a/', item.id)"}, "item.open")
    body = lambda *jobs: json.dumps({"jobs": [dict(zip(("id", "title", "open"), j, strict=True)) for j in jobs]})
    raw = spark.createDataFrame([("g", "acme", 1, body(("1", "A", True), ("2", "B", False))), ("g", "acme", 2, body(("1", "again", True), ("3", "C", True), (None, "D", True))), ("x", "y", 1, "{}")], "provider string, slug string, page int, body string")
    found, unknown = normalise.normalize_all(raw, {"g": spec})
    assert sorted((r["external_id"], r["job_title"]) for r in found.collect()) == [("1", "A"), ("3", "C")]
    assert [r["provider"] for r in unknown.collect()] == ["x"]


def test_islands_scripts_and_jsonld(spark):
    jobs = [{"title": "Data  Analyst", "id": 7, "city": "Pune"}, {"title": "Data Lead"}]
    island = f'<script id="__NEXT_DATA__" type="application/json">{json.dumps({"props": {"jobs": jobs}})}</script>'
    script = f"<script>var jobs = {json.dumps(jobs)}; var x = ']';</script>"
    pages = spark.createDataFrame([("p", "s", 1, island + script)], "provider string, slug string, page int, html string")
    got = normalise.normalize_island(pages, "props.jobs", "title", "id", "city", url="https://x/{slug}/{id}")
    assert sorted((r["external_id"], r["job_url"], r["location"]) for r in got.collect()) == [("7", "https://x/s/7", "Pune"), ("data-lead", "https://x/s/data-lead", None)]
    got = normalise.normalize_script_literal(pages, "var jobs", "title", "id", "city")
    assert sorted((r["external_id"], r["job_title"]) for r in got.collect()) == [("7", "Data Analyst"), ("data-lead", "Data Lead")]
    ld = {"@graph": [{"@type": ["JobPosting"], "title": "X", "jobLocation": [{"address": {"addressLocality": "Pune", "addressCountry": {"name": "India"}}}], "jobLocationType": "TELECOMMUTE"}]}
    html = f"<script type='application/ld+json'>{json.dumps(ld)}</script><script type='application/ld+json'>broken</script>"
    got = normalise.extract_jsonld(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).collect()
    assert [(r["job_title"], r["location"]) for r in got] == [("X", "Pune, India; Remote")]


def test_pages(spark):
    html = "<title>Careers | Acme</title><body><nav>menu</nav><a href='/jobs/1#a'>Data <b>Analyst</b></a><a href='/jobs/1'>Data Analyst</a><a href='https://other.example/jobs/2'>Engineer</a><a href='/positions'>View open roles</a><p>one<br>two</p></body>"
    pages = spark.createDataFrame([(1, "https://www.acme.example/careers", html)], "page_id long, url string, html string")
    assert [r["link"] for r in normalise.extract_links(pages).orderBy("pos").collect()] == ["https://www.acme.example/jobs/1", "https://www.acme.example/positions"]
    assert normalise.pick_openings_link(pages).first()["link"] == "https://www.acme.example/positions"
    row = pages.select(normalise.title_hint(F.col("html")).alias("t"), normalise.main_text(F.col("html")).alias("m"), normalise.challenge_evidence(F.lit("x Just a moment... Ray ID y")).alias("c"), normalise.challenge_evidence(F.col("html")).alias("n")).first()
    assert row["t"] == "Careers" and "menu" not in row["m"] and "one\ntwo" in row["m"] and "Just a moment" in row["c"] and row["n"] is None
    assert normalise.page_signals(pages).first()["careers_title"]


def test_sitemaps_and_gaps(spark):
    body = "<urlset><url><loc>https://a.example/jobs/data-analyst-12345</loc></url><url><loc>https://a.example/about</loc></url><url><loc>https://a.example/jobs/x.css</loc></url></urlset>"
    got = normalise.normalize_sitemap(spark.createDataFrame([("p", "s", body)], "provider string, slug string, body string"))
    assert [(r["external_id"], r["job_title"]) for r in got.collect()] == [("a.example/jobs/data-analyst-12345", "Data Analyst")]
    listing = spark.createDataFrame([("p", "s", "1"), ("p", "t", "9")], "provider string, company_slug string, external_id string")
    site = spark.createDataFrame([("p", "s", "1"), ("p", "s", "2"), ("p", "t", "5"), ("p", "u", "7")], listing.schema)
    assert sorted((r[1], r[2]) for r in normalise.gap_fill(listing, site).collect()) == [("s", "1"), ("s", "2"), ("t", "9"), ("u", "7")]
    pages = spark.createDataFrame([("p", "s", 1, ["1", "2"], 3), ("p", "s", 2, ["2", "1"], 3), ("p", "t", 1, ["1"], None)], "provider string, slug string, page int, ids array<string>, reported_total long")
    assert {r["slug"]: (r["level"], r["message"]) for r in normalise.audit_pages(pages).collect()} == {"s": ("warn", "stalled-short"), "t": ("info", "complete")}


def test_registry(spark):
    good = ["Acme", "https://acme.example", "g", "acme", "api", "active", "", "", "", "", "", '{"a": "b"}', "", ""]
    rows = [good, ["", "nope", *good[2:]], [*good[:11], "[1]", "", ""], [*good[:11], "{bad", "", ""]]
    valid, bad = readers.decode_registry(spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"{c} string" for c in readers.REGISTRY_COLUMNS)))
    assert [r["api_meta"] for r in valid.collect()] == [{"a": "b"}]
    assert sorted(r["issues"] for r in bad.collect()) == ["api_meta: not an object of strings", "api_meta: not valid JSON", "name: required; careers_url: not a url"]
    assert [x or "" for x in readers.encode_registry(valid).first()] == [*good[:11], '{"a":"b"}', "", ""]


def test_tables(spark, tmp_path):
    path = f"{tmp_path}/t"
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    assert readers.read_table(spark, path, schema).count() == 0
    readers.write_table(spark.createDataFrame([(1,), (2,), (3,)], "a long"), path)
    assert {r["b"] for r in readers.read_table(spark, path, schema, backfill={"b": F.lit("new")}).collect()} == {"new"}
    with pytest.raises(ValueError, match="refusing"):
        readers.publish(spark.createDataFrame([(1, "x")], schema), path)
    assert readers.read_table(spark, path, schema).count() == 3
    readers.publish(spark.createDataFrame([(1, "x")], schema), path, force=True)
    assert readers.read_table(spark, path, schema).count() == 1
    # A table may be made from itself, and only partitions with rows are replaced.
    readers.write_table(spark.createDataFrame([(1, "x"), (2, "y")], schema), f"{path}2", ("b",))
    held = readers.read_table(spark, f"{path}2", T.StructType(schema.fields[:1]), "b string")
    readers.publish(held.where("b = 'x'").selectExpr("a + 10 AS a", "b"), f"{path}2", ("b",))
    assert sorted(map(tuple, spark.read.parquet(f"{path}2").select("a", "b").collect())) == [(2, "y"), (11, "x")]


def test_outreach_plan(spark):
    postings = spark.createDataFrame([("Acme Ltd", "A", "u1", "yellow", 0.9, 1), ("ACME", "B", "u2", "green", 0.8, 2), ("Other", "C", "u3", "green", 0.8, 3), ("Beta", "D", "u4", "green", 0.9, 4), ("Gone", "E", "u5", "silent", 0.1, 5)], "company string, job_title string, job_url string, severity string, llm_confidence double, pos int")
    people = [("a@x.com", "verified", "acme", []), ("b@x.com", "unverified", "acme", []), ("c@beta.com", "bounced", "zzz", []), ("d@y.com", "unverified", "zzz", ["other"])]
    recruiters = spark.createDataFrame(people, "email string, status string, company_norm string, alt_names_norm array<string>")
    last = spark.createDataFrame([("d@y.com", "p0", ts(20))], "recruiter_email string, profile_id string, last_drafted_at timestamp")
    plan, rest = outreach.plan_outreach(postings, recruiters, last, "{{company}}: {{roles}}", F.lit(ts(31)))
    assert sorted((r["email"], r["rank"], r["top"]["title"], r["body"]) for r in plan.collect()) == [("a@x.com", 1, "B", "Acme Ltd: A and 1 more"), ("b@x.com", 2, "B", "Acme Ltd: A and 1 more")]
    assert sorted((r["job_title"], r["reason"]) for r in rest.collect()) == [("C", "cooldown"), ("D", "bounced_contact")]


def test_outreach_states(spark):
    columns = "id long, recruiter_email string, status string, drafted_at timestamp, sent_at timestamp, verified_at timestamp, message_id string, failure_detail string, last_checked_at timestamp"
    rows = [(1, "a", "draft", ts(1)), (2, "b", "draft", ts(1)), (3, "c", "discarded", ts(25)), (4, "d", "sent", ts(1)), (5, "e", "sent", ts(1)), (6, "f", "draft", ts(1))]
    rows = [(*r, ts(2) if r[2] == "sent" else None, None, None, None, None) for r in rows]
    mail = spark.createDataFrame([("m1", "sent", "a", ts(3), ""), ("m3", "sent", "c", ts(30, 12), ""), ("m4", "bounce", "d", ts(4), "no such user"), ("m0", "bounce", "e", ts(1), "old")], "message_id string, folder string, address string, internal_date timestamp, snippet string")
    got = outreach.advance_outreach(spark.createDataFrame(rows, columns), mail, spark.createDataFrame([(1,), (2,)], "id long"), F.lit(ts(31)))
    assert {r["id"]: r["status"] for r in got.collect()} == {1: "verified", 2: "discarded", 3: "sent", 4: "bounced", 5: "verified", 6: "draft"}


def test_gate_and_funnel(spark):
    raw = ['{"matchScore": 0.9, "dealBreakerHit": "none", "reason": "fine"}', '{"matchScore": 0.5, "dealBreakerHit": "x"}', '{"matchScore": 1.5}', "oops", '{"matchScore": 0.75, "analysis": "long"}']
    got = decide.parse_gate(spark.createDataFrame([("p", str(i), "u", r) for i, r in enumerate(raw)], "provider string, external_id string, profile_id string, raw string")).orderBy("external_id").collect()
    assert [(r["match_score"], r["deal_breaker_severity"], r["reason"], r["gate_error"] is None) for r in got] == [(0.9, None, "fine", True), (0.5, "soft", "auto: matchScore 0.50", True), (None, None, None, False), (None, None, None, False), (0.75, None, "long", True)]

    listing = [("1", "Analyst", "Pune", "sql work, 3 years"), ("2", "Analyst", "Paris", "sql"), ("3", "Red Lead", "Pune", "sql"), ("4", "Clerk", "Pune", ""), ("5", "Chief", "Pune", "sql, 12 years of experience"), ("6", "Analyst", "Pune", "sql work"), ("7", "Cook", "Pune", "food"), ("8", "Old", "Pune", "sql"), ("9", "Told", "Pune", "sql")]
    frame = spark.createDataFrame([("p", k, "u", "acme", "Acme", t, f"u{k}", loc, False, jd) for k, t, loc, jd in listing], "provider string, external_id string, profile_id string, company_slug string, company_name string, job_title string, job_url string, location string, is_remote boolean, jd_text string")
    known = spark.createDataFrame([("p", "8", "u", "silent", ts(1), None)], "provider string, external_id string, profile_id string, drop_stage string, discovered_at timestamp, jd_checked_at timestamp")
    prior = spark.createDataFrame([("acme|told|pune",)], "notify_key string")
    profile = Profile(cities=("pune",), title_deny=("^Red",), accept_unspecified_yoe=True)
    out = decide.decide(frame, known, prior, profile, decide.keyword_scorer({"sql": 0.9}), F.lit(ts(31)))
    assert {r["external_id"]: r["decision"] for r in out.collect()} == {"1": "green", "2": "location", "3": "title-deny", "4": "no-jd", "5": "yoe-deny", "6": "duplicate", "7": "silent", "8": "known", "9": "prior-duplicate"}


def test_catalog_names():
    from feedloom.plans import catalog

    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_job_urls(spark):

    uuid = "0f8fad5b-d9cb-469f-a165-70867728950e"
    cases = {
        "https://boards.greenhouse.io/acme/jobs/123?x=1": ("greenhouse", "acme", "123"),
        f"https://jobs.lever.co/acme/{uuid}/apply": ("lever", "acme", uuid),
        "https://jobs.lever.co/acme/123": (None, None, None),
        "https://jobs.smartrecruiters.com/Acme/744-analyst": ("smartrecruiters", "Acme", "744"),
        "https://acme.wd1.myworkdayjobs.com/en/site/job/Pune/Analyst_R12": ("workday", "acme", "Analyst_R12"),
        "https://acme.wd1.myworkdayjobs.com/en": ("workday", "acme", None),
        "https://acme.bamboohr.com/careers/list": (None, None, None),
        "https://www.acme.example/careers?gh_jid=9": ("greenhouse", None, "9"),
        "https://jobs.acme.example/job/Analyst/987-en_US/": (None, "jobs.acme.example", "987"),
        "nonsense": (None, None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    resolved = urls.resolve_job_urls(df, "url")
    assert {r["url"]: (r["provider"], r["slug_hint"], r["external_id"]) for r in resolved.collect()} == cases
    companies = spark.createDataFrame([("greenhouse", "acme", "Acme", "https://careers.acme.example/x"), ("sf", "a2", "Acme 2", "https://x.jobs.acme.example/")], "provider string, slug string, name string, careers_url string")
    found = {(r["url"][:25], r["slug"]) for r in urls.find_companies(resolved, companies).collect()}
    assert found == {("https://boards.greenhouse", "acme"), ("https://jobs.acme.example", "a2")}
    postings = spark.createDataFrame([("greenhouse", "123", "u", "https://z/1"), ("sf", "5", "u", "https://jobs.acme.example/job/Analyst/987-en_US/more")], "provider string, external_id string, profile_id string, job_url string")
    assert sorted(r["external_id"] for r in urls.find_postings(resolved, postings, "u").collect()) == ["123", "5"]


def test_html_boards(spark):
    from feedloom.operators.html_boards import HtmlBoard, normalize_html

    html = '<ul class="jobs"><li data-id="7"><h3>Role: Analyst</h3><a href="/j/7">go</a><span class="loc">Pune<br></span></li><li><h3>Role: Lead</h3><a href="x/8?y=1">go</a></li><li><h3>General application</h3></li></ul><ul><li><h3>no</h3></li></ul>'
    pages = spark.createDataFrame([("p", "s", 1, "https://a.example/c/list", html), ("p", "s", 2, "https://a.example/c/list", html)], "provider string, slug string, page int, url string, html string")
    board = HtmlBoard("ul.jobs li", "h3", "a@href", ".loc", "India", "^General", r"Role: (.*)", "data-id")
    got = sorted(tuple(r)[2:6] for r in normalize_html(pages, board).collect())
    assert got == [("/c/x/8?y=1", "Lead", "https://a.example/c/x/8?y=1", "India"), ("7", "Analyst", "https://a.example/j/7", "Pune")]
    plan = normalize_html(pages, board)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_elements_by_selector(spark):
    from feedloom.operators.html_boards import _attribute, _field, select

    html = """<!-- <div class="job">no</div> --><script>var x = '<div class="job">no</div>';</script><DIV Class='job wide' data-n="1"><div>in <b>ner</b></div>a&amp;b<img class=pic src=/x.png></DIV>
    <div class="jobs">not</div><section id=s><div class="x job" data-n='2'><div class="job">nested</div><br>c</div></section><p class="job">p<div class="job" data-n=3>open"""
    df = spark.createDataFrame([(html,), ("",), ("<",), ("text only",)], "html string")
    got = {s: df.select(F.transform(select(F.col("html"), s), lambda x: F.struct(_attribute(x, "data-n").alias("n"), _field(x, "b").alias("b"), F.length(x).alias("size"))).alias("x")).first()["x"] for s in ("div.job", "#s div", ".job", "div[data-n=3]", "img", "section .job", "nav div", "div.job div")}
    assert [r["n"] for r in got["div.job"]] == ["1", "2", "3"] and [r["b"] for r in got["div.job"]] == ["ner", None, None]
    assert [r["n"] for r in got["#s div"]] == ["2"] and [r["n"] for r in got["section .job"]] == ["2"] and [r["n"] for r in got[".job"]] == ["1", "2", ""]
    assert [r["n"] for r in got["div[data-n=3]"]] == ["3"] and len(got["img"]) == 1 and got["nav div"] == []
    assert all(not r["x"] for r in df.where("html <> ''").select(F.transform(select(F.col("html"), "div.job"), lambda x: x).alias("x")).collect()[1:])


def test_news_that_repeat_a_key_multiply_nothing(spark):
    from feedloom.operators import lifecycle

    people = spark.createDataFrame([("a@x", "verified"), ("b@x", "bounced"), ("c@x", "unverified")], "email string, status string")
    changes = spark.createDataFrame([("A@x", "bounced", 2), ("a@x", "verified", 1), ("b@x", "verified", 3), ("c@x", "verified", 1), ("c@x", "bounced", 0)], "email string, new_status string, at int")
    assert sorted(map(tuple, lifecycle.set_recruiter_status(people, changes).collect())) == [("a@x", "bounced"), ("b@x", "bounced"), ("c@x", "verified")]
    columns = "provider string, slug string, status string, consecutive_failures long, postings_seen_total long, zero_yield_streak long"
    companies = spark.createDataFrame([("p", "s", "active", 2, 5, 1), ("p", "t", "active", 4, 5, 1)], columns)
    outcomes = spark.createDataFrame([("p", "s", None, "boom", False), ("p", "s", 3, None, False), ("p", "t", None, "boom", False), ("p", "t", None, "boom", False)], "provider string, slug string, seen long, error string, transport_fault boolean")
    assert sorted(tuple(r)[1:] for r in lifecycle.apply_outcomes(companies, outcomes, F.lit(ts(31))).collect()) == [("s", "active", 0, 8, 0), ("t", "broken", 5, 5, 1)]
    parked = spark.createDataFrame([("p", "s", "dormant", 4, ts(1), "old"), ("p", "t", "active", 4, ts(1), "old")], "provider string, slug string, status string, consecutive_failures long, last_fetched_at timestamp, last_error string")
    news = spark.createDataFrame([("p", "s", None, "boom", False), ("p", "t", None, "down", True)], outcomes.schema)
    assert sorted(tuple(r)[1:] for r in lifecycle.apply_outcomes(parked, news, F.lit(ts(31))).collect()) == [("s", "broken", 5, ts(31), "boom"), ("t", "active", 4, ts(31), "down")]
    pool = spark.createDataFrame([("a@Good.com",), ("b@bad.com",), ("c@none.com",)], "email string")
    verdicts = spark.createDataFrame([("good.com", False), ("good.com", True), ("bad.com", False), ("bad.com", False)], "domain string, ok boolean")
    assert sorted((r["email"], r["deliverable"]) for r in outreach.deliverable(pool, verdicts).collect()) == [("a@Good.com", True), ("b@bad.com", False), ("c@none.com", False)]


def test_bounds_say_what_they_leave_out(spark):
    urls = "".join(f"<loc>https://a.example/jobs/role-{i}</loc>" for i in range(7))
    files = spark.createDataFrame([("p", "s", urls)], "provider string, slug string, body string")
    assert [(r["cut"]) for r in normalise.normalize_sitemap(files, cap=5).collect()] == [2] * 5
    assert normalise.normalize_sitemap(files, cap=None).count() == 7
    listing = spark.createDataFrame([("p", "s", "1")], "provider string, company_slug string, external_id string")
    site = spark.createDataFrame([("p", "s", str(i)) for i in range(1, 5)] + [("p", "t", "9")], listing.schema)
    assert {r["company_slug"]: r["outcome"] for r in normalise.gap_report(listing, site, guard=2).collect()} == {"s": "truncated", "t": "filled"}
    assert normalise.gap_fill(listing, site, guard=None).count() == 5
    # Beyond the guard the first ids are added, in the sitemap's order; listed rows take the sitemap's url.
    placed = spark.createDataFrame([("p", "s", str(i), 9 - i, f"new/{i}") for i in range(1, 6)], "provider string, company_slug string, external_id string, pos int, job_url string")
    told = spark.createDataFrame([("p", "s", "1", "old/1"), ("p", "s", "7", "https://x/job/a/7-en_US/"), ("p", "z", "7", "https://x/job/a/7-en_US/")], "provider string, company_slug string, external_id string, job_url string")
    got = sorted((r["company_slug"], r["external_id"], r["job_url"]) for r in normalise.gap_fill(told, placed, guard=2).collect())
    assert got == [("s", "1", "new/1"), ("s", "4", "new/4"), ("s", "5", "new/5"), ("s", "7", "https://x/job/a/7/"), ("z", "7", "https://x/job/a/7-en_US/")]


def test_pay_statements(spark):
    from feedloom.functions.filters import extract_salary

    cases = {
        "CTC: 12-18 LPA": (1_200_000, 1_800_000, "INR", "year"),
        "₹12,00,000 - ₹15,00,000 per annum": (1_200_000, 1_500_000, "INR", "year"),
        "Salary: $120k-$150k": (120_000, 150_000, "USD", "year"),
        "pay is $25/hr": (52_000, 52_000, "USD", "hour"),
        "1 - 1.5 Cr": (10_000_000, 15_000_000, "INR", "year"),
        "Founded in 2024-2026": None,
        "": None,
        "7 people, 3 floors, 2-4 teams": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "body string").select("body", extract_salary(F.col("body")).alias("s")).collect()
    for r in got:
        assert (None if r["s"] is None else (r["s"]["annual_min"], r["s"]["annual_max"], r["s"]["currency"], r["s"]["period"])) == cases[r["body"]]


def test_containment_join_is_whole(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ab.é") for _ in range(n))
    texts = [word(rng.randrange(0, 14)) for _ in range(200)] + [None, "", "aaaa" * 10]
    needles = [word(rng.randrange(1, 8)) for _ in range(80)] + [None, "", "zzzzz", "aaaa", "a"]
    one = spark.createDataFrame([(x,) for x in texts * 2], "t string")
    other = spark.createDataFrame([(x,) for x in needles * 2], "n string")
    got = urls.contains_join(one, "t", other, "n")
    assert sorted(map(tuple, got.collect())) == sorted((t, n) for t in {x for x in texts if x is not None} for n in {x for x in needles if x} if n in t)
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert urls.contains_join(one.limit(0), "t", other, "n").count() == 0


def test_companies_by_the_host_that_their_pages_hold(spark):
    companies = spark.createDataFrame([("g", "acme", "Acme", "https://jobs.acme.com/x", None), ("w", "tenant", "T", "https://none", "https://TENANT.wd1.example.com/a"), ("g", "port", "P", "http://local.test:8080/", None), ("h", "query", "Q", "https://x.test/?u=jobs.acme.com", None)], "provider string, slug string, name string, careers_url string, tenant_url string")
    asked = [("https://jobs.acme.com/1", None, None), ("https://JOBS.acme.com:443/2", "g", "other"), ("http://local.test:8080/3", None, None), ("https://tenant.wd1.example.com/4", "w", None), ("https://jobs.lever.co/5", "lever", "zzz"), ("no url", None, "acme.com"), ("https://x/6", "g", "acme"), ("https://jobs.acme.com/1", None, None), ("https://wd1/7", None, None)]
    found = urls.find_companies(spark.createDataFrame(asked, "url string, provider string, slug_hint string"), companies)
    assert sorted((r["url"][-1], r["slug"]) for r in found.collect()) == [("1", "acme"), ("1", "query"), ("2", "acme"), ("3", "port"), ("4", "tenant"), ("6", "acme"), ("7", "tenant"), ("l", "acme"), ("l", "query")]


def rows_dealt(plan):
    """Rows that the exchanges of an executed plan wrote."""
    if plan.nodeName().startswith("AdaptiveSparkPlan"):
        return rows_dealt(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return rows_dealt(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(rows_dealt(plan.children().apply(i)) for i in range(plan.children().size()) if plan.nodeName() != "ReusedExchange")


def test_urls_and_companies_of_one_host_are_not_dealt_as_pairs(spark):
    asked = spark.range(400).selectExpr("'https://jobs.acme.test/' || id AS url", "CAST(NULL AS STRING) AS provider", "CAST(NULL AS STRING) AS slug_hint")
    companies = spark.range(300).selectExpr("'g' AS provider", "CAST(id AS STRING) AS slug", "'x' AS name", "'https://jobs.acme.test/' || id AS careers_url", "CAST(NULL AS STRING) AS tenant_url")
    found = urls.find_companies(asked, companies)
    assert len(found.collect()) == 400 * 300
    assert 0 < rows_dealt(found._jdf.queryExecution().executedPlan()) < 20_000


@pytest.mark.parametrize("blocks, probes", [(2000, 20_000), (3, 2), (1, 0)])
def test_companies_of_many_urls_equal_a_plain_search(spark, monkeypatch, blocks, probes):
    monkeypatch.setattr(urls, "BLOCK_ROWS", blocks, raising=False)
    monkeypatch.setattr(urls, "PROBES", probes, raising=False)
    rng = random.Random(5)
    hosts = ["a.test", "b.a.test", "c.test", "x", "jobs.lever.co", "none.test"]
    asked = [(rng.choice([None, "", *[f"https://{h}/{k}" for h in hosts for k in range(3)], "free text", "more"]), rng.choice([None, "g", "w"]), rng.choice([None, "s1", "s2", "a.test", "c.test", "x"])) for _ in range(150)]
    link = lambda: rng.choice([None, "", "https://A.test/", "https://b.a.test/?c.test", "https://c.test/x", "https://q/"])
    companies = [(rng.choice(["g", "w"]), f"s{rng.randrange(30)}", rng.choice(["N", "M"]), link(), link()) for _ in range(60)]
    want = set()
    equal = {}
    for u, p, s in asked:
        equal.setdefault(u, set()).update((c[0], c[1], c[2]) for c in companies if p is not None and (p, s) == (c[0], c[1]))
    for u, p, s in asked:
        host = u.split("//")[1].split("/")[0] if u and "//" in u else s
        want |= {(u, *c) for c in equal[u]}
        if (u is None or not equal[u]) and host and host not in urls.SHARED_HOSTS:
            want |= {(u, *c[:3]) for c in companies if p in (None, c[0]) and any(host in (x or "").lower() for x in c[3:])}
    found = urls.find_companies(spark.createDataFrame(asked, "url string, provider string, slug_hint string"), spark.createDataFrame(companies, "provider string, slug string, name string, careers_url string, tenant_url string"))
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(want) > 100
    exact = {(u, *c) for u, cs in equal.items() for c in cs}
    assert len([r for r in rows if r not in exact]) == len(want - exact)


def scanned(text, marker, opening):
    """The bracketed literal behind a marker, character by character."""
    at = text.find(marker)
    start = text.find(opening, at + len(marker)) if at >= 0 else -1
    if start < 0:
        return None
    depth, quote, i = 0, "", start
    while i < len(text):
        c = text[i]
        if quote:
            i += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in (opening, {"[": "]", "{": "}"}[opening]):
            depth += 1 if c == opening else -1
            if not depth:
                return text[start : i + 1]
        i += 1
    return None


def test_literals_end_where_their_brackets_close(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["[", "]", "{", "}", '"', "'", "`", "\\", "a", "é😀", "\n", "jobs=", '"x"', '"]"', "'\\''"]) for _ in range(rng.randrange(0, 40))) for _ in range(600)]
    texts += [None, "", "jobs=", "jobs=[" + '"\\"]"' * 3000 + "]", "jobs=" + "[" * 2000 + "]" * 2000, "jobs=['" + "x" * 50000 + "']"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", *[normalise.balanced(F.col("t"), "jobs=", o).alias(n) for o, n in (("[", "a"), ("{", "b"))])
    rows = df.collect()
    assert sum(r["a"] is not None for r in rows) > 20
    for r in rows:
        assert (r["a"], r["b"]) == tuple(scanned(r["t"] or "", "jobs=", o) for o in "[{"), r["t"]


def job_postings(v):
    if isinstance(v, list):
        return [n for x in v for n in job_postings(x)]
    if not isinstance(v, dict):
        return []
    kind = v.get("@type")
    own = [v] if kind == "JobPosting" or (isinstance(kind, list) and "JobPosting" in kind) else []
    return own + [n for k in ("@graph", "itemListElement", "item", "mainEntity", "mainEntityOfPage") if k in v for n in job_postings(v[k])]


def test_nodes_at_any_depth_in_their_order(spark):
    rng = random.Random(3)
    number = iter(range(100000))

    def value(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["JobPosting", 1, None, True, {"@type": "JobPosting", "title": f"t{next(number)}"}])
        if rng.random() < 0.4:
            return [value(depth - 1) for _ in range(rng.randrange(0, 4))]
        out = {k: value(depth - 1) for k in rng.sample(["@graph", "item", "mainEntity", "itemListElement", "mainEntityOfPage", "other"], rng.randrange(0, 4))}
        return out | ({"@type": rng.choice(["JobPosting", ["x", "JobPosting"], "Page", ["Page"]]), "title": f"t{next(number)}"} if rng.random() < 0.6 else {})

    values = [value(rng.randrange(1, 14)) for _ in range(60)] + [json.loads("[" * 11 + json.dumps({"item": {"@type": "JobPosting", "title": "deep"}}) + "]" * 11)]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, "{broken"), (901, None)], "id long, body string").select("id", F.try_parse_json("body").alias("v"))
    got = {}
    for r in normalise.job_nodes(df).select("id", "path", F.try_variant_get("node", "$.title", "string").alias("t")).collect():
        got.setdefault(r["id"], []).append((r["path"], r["t"]))
    assert {i: [t for _, t in sorted(x)] for i, x in got.items()} == {i: [n["title"] for n in ns] for i, v in enumerate(values) if (ns := job_postings(v))}


def test_places_of_nodes(spark):
    node = {"@type": "JobPosting", "title": " A ", "url": 5, "jobLocation": [{"address": {"addressLocality": " Pune ", "addressCountry": {"name": "India"}}}, {"name": "Goa"}, "x", {"address": {}}, {"address": {"addressRegion": "MH", "addressCountry": "IN"}}], "jobLocationType": ["TELECOMMUTE"], "datePosted": ""}
    pages = [(1, "u1", json.dumps([node, {"@type": "JobPosting", "title": 7}, {"@type": "JobPosting", "title": "B", "jobLocation": {"name": "Y"}}])), (2, "u2", json.dumps({"@type": "JobPosting", "title": "C", "jobLocationType": "TELECOMMUTE", "applicantLocationRequirements": [{"name": "India"}], "description": "<p>text</p>"}))]
    html = spark.createDataFrame([(i, u, f'<script type="application/ld+json">{b}</script>') for i, u, b in pages], "page_id long, url string, html string")
    assert sorted((r["job_title"], r["job_url"], r["location"], r["posted"]) for r in normalise.extract_jsonld(html).collect()) == [("A", "u1", "Pune, India; Goa; MH, IN; Remote", None), ("B", "u1", "Y", None), ("C", "u2", "Remote", None)]
    told = {r["job_url"]: (r["title"], r["text"], r["place"], r["remote"]) for r in normalise.read_details(html).collect()}
    assert told == {"u1": ("A", None, "Pune, India; Goa; MH, IN; Remote", True), "u2": ("C", "text", "Remote - India", True)}
    plan = normalise.read_details(html)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    grouped = '<script id="__NEXT_DATA__">{"jobs": {"a": [{"title": "One"}], "b": [{"title": "Two"}], "c": 5}}</script>'
    island = spark.createDataFrame([("p", "s", 1, grouped)], "provider string, slug string, page int, html string")
    assert sorted(r["job_title"] for r in normalise.normalize_island(island, "jobs", "title").collect()) == ["One", "Two"]


def test_noise_slugs_as_a_table(spark, monkeypatch):
    from feedloom.functions import filters

    df = spark.createDataFrame([("Koo", "K"), ("own", "O"), ("x-services", "X"), (None, "N"), ("y", "Bad Ltd")], "slug string, name string")
    noise = spark.createDataFrame([("koo", "defunct"), ("KOO", "another"), ("own", "table"), (None, "x"), ("y", None)], "slug string, reason string")
    profile = Profile(noise_slugs={"own": "mine"}, slug_fragments=("-services",), name_patterns=("^Bad",))
    for rows in (100_000, 0):
        monkeypatch.setattr(filters, "NOISE_ROWS", rows)
        got = {r["name"]: r["deny_reason"] for r in filters.denied_company(df, profile, noise=noise).collect()}
        assert got == {"K": "noise:another", "O": "noise:mine", "X": "services-slug:-services", "N": None, "Bad Ltd": "services-name:^Bad"}


def test_positions_by_text_in_even_buckets(spark):
    from feedloom.operators.lifecycle import with_position

    rng = random.Random(5)
    # Texts that begin alike, nulls, and one that a third of all rows share.
    rows = [(f"company-with-a-long-name-{rng.randrange(500)}" if i % 3 else "company-with-a-long-name-7", i) for i in range(900)] + [(None, 1000), (None, 1001), ("é", 1), ("", 2)]
    df = spark.createDataFrame(rows, "name string, n int").repartition(5)
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1]))
    places = sorted((r["at"], r["name"], r["n"]) for r in with_position(df, ["name", "n"], "at").collect())
    assert places == [(i, *r) for i, r in enumerate(order)]
    assert with_position(df.limit(0), ["name"], "at").count() == 0 and with_position(df.where("name IS NULL"), ["name", "n"], "at").count() == 2


def test_company_groups_keep_counts_and_the_top_role(spark):
    rows = [("Acme Ltd", "A", "u1", "yellow", None, 1), ("ACME", "B", "u2", "yellow", -0.5, 2), ("acme", "C", "u3", "green", None, 3), ("Acme", "D", "u4", "green", None, 4), ("Z", "E", "u5", "yellow", None, 5)]
    df = spark.createDataFrame(rows, "company string, job_title string, job_url string, severity string, llm_confidence double, pos int")
    got = {r["company_norm"]: (r["company"], r["first_pos"], r["roles"], r["first_title"], r["top"]["title"]) for r in outreach.group_by_company(df).collect()}
    assert got == {"acme": ("Acme Ltd", 1, 4, "A", "C"), "z": ("Z", 5, 1, "E", "E")}
    assert sorted((r["pos"], r["role"]["title"]) for r in outreach.roles_of(df, spark.createDataFrame([("acme",)], "company_norm string")).collect()) == [(1, "A"), (2, "B"), (3, "C"), (4, "D")]


def test_diagnostics_of_boards(spark):
    from feedloom.operators import reports

    columns = "provider string, company_slug string, external_id string, job_title string, job_url string, location string, is_remote boolean, posted_at timestamp, jd_text string"
    same = [("p", "same", str(i), "T", "u", "Paris", False, None, "one text" if i in (0, 4, 8) else f"text {i}") for i in range(9)]
    # Of a board with something in the region only that is sampled.
    some = [("p", "some", str(i), "T", "u", "Pune, India" if i < 3 else "Paris", False, None, "one" if i < 3 else f"t{i}") for i in range(9)]
    rest = [("p", "rest", None, "T", None, None, None, ts(1), None), ("p", "rest", "", " ", "", "", True, None, " t "), ("p", "rest", "1", "Title", "u", "x", False, None, " TITLE "), ("p", "rest", "1", "t", "u", "x", None, None, "<a >b</a ><br/><i >x")]
    round_ = [("p", "round", str(i), "t", "u", "x", False, ts(1), "captcha" if i == 3 else "x" * 400) for i in range(30)]
    got = {r["company_slug"]: r for r in reports.diagnose_boards(spark.createDataFrame(same + some + rest + round_, columns), region=r"\bIndia\b").collect()}
    assert got["same"]["identical_samples"] and got["some"]["identical_samples"] and not got["rest"]["identical_samples"] and got["some"]["in_region"] == 3
    want = {"n": 4, "duplicate_ids": 1, "missing_ids": 2, "missing_urls": 2, "missing_titles": 1, "null_locations": 2, "null_dates": 3, "empty_jd": 1, "thin_jd": 3, "html_residue": 1, "error_pages": 0, "title_only": 1, "round_count": False}
    assert {k: got["rest"][k] for k in want} == want
    assert got["round"]["round_count"] and got["round"]["error_pages"] == 1
    assert reports.diagnose_boards(spark.createDataFrame([], columns)).count() == 0
