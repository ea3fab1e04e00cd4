"""Registered queries of joins, outreach plans, state tables and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import lifecycle, normalise, outreach, reports, urls
from feedloom.plans.catalog import EVENTS_NOW, ORDERS_NOW, query, ts
from feedloom.plans.catalog_values import written
from feedloom.plans.tables import scratch
from feedloom.sources import readers
from feedloom.streaming import feed

_NUMBER = "CAST(split_part(slug, '-', 2) AS BIGINT)"


def _number(column="slug"):
    return F.split_part(column, F.lit("-"), F.lit(2)).cast("long")


# Joins

_SITE = "lower(regexp_extract({}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)', 1))"
#: Careers pages and tenants that lie on the sites of pages, or only name them.
_PLACES = """SELECT s_suppkey, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'workday' ELSE 'html' END AS provider, CASE WHEN a.url IS NULL OR s_suppkey % 5 = 0 THEN 'https://none.test/' ELSE 'https://go.test/?to=' || upper(a.url) END AS careers_url, CASE WHEN s_suppkey % 4 > 0 THEN 'x' || b.url END AS tenant_url
    FROM {supplier} LEFT JOIN {pages} a ON a.page_id = s_suppkey LEFT JOIN {pages} b ON b.page_id = s_suppkey * 2"""


@query("f7_host_containment", f"WITH c AS ({_PLACES.format(supplier='supplier', pages='pages')}), p AS (SELECT page_id, {_SITE.format('url')} AS host FROM pages) SELECT page_id, s_suppkey FROM p JOIN c ON host <> '' AND (contains(lower(careers_url), host) OR contains(lower(tenant_url), host))")
def _(v, t):
    pages = t("pages").select("page_id", "url")
    companies = pages.sparkSession.sql(_PLACES, supplier=t("supplier"), pages=pages).withColumn("slug", F.col("s_suppkey").cast("string"))
    asked = pages.select("page_id", "url", F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("slug_hint"))
    found = urls.find_companies(asked, companies, keep=("page_id",))
    return found.select("page_id", F.col("slug").cast("long").alias("s_suppkey"))


@query("f6_lookup_contacts", "SELECT DISTINCT recruiter_email AS email, u.status FROM v_drafts JOIN (SELECT 'u' || c_custkey AS email, status, c_custkey FROM v_recruiters) u ON u.email = recruiter_email WHERE c_custkey % 4 > 0")
def _(v, t):
    people = v("v_recruiters").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("email"), "status", "c_custkey")
    existing = people.where("c_custkey % 4 = 0")
    return outreach.lookup_contacts(v("v_drafts").select(F.upper("recruiter_email").alias("recruiter_email")), people, existing).select("email", "status")


@query("f7_find_companies", f"SELECT page_id, slug FROM pages JOIN (SELECT slug, {_NUMBER} AS s FROM v_companies) ON CASE WHEN page_id % 3 = 0 THEN page_id % 50 WHEN page_id % 3 = 1 THEN page_id % 70 END = s")
def _(v, t):
    own = v("v_companies").withColumn("careers_url", F.concat(F.lit("https://x."), "slug", F.lit(".example.com/careers")))
    # Greenhouse boards are found by slug; others by their host; shared hosts by neither.
    companies = own.withColumn("provider", F.lit("greenhouse"))
    k = F.col("page_id") % 3
    slug = F.concat(F.lit("supplier-"), (F.col("page_id") % F.when(k == 0, 50).otherwise(70)).cast("string"))
    url = F.when(k == 0, F.concat(F.lit("https://boards.greenhouse.io/"), slug, F.lit("/jobs/1?p="), F.col("page_id").cast("string"))).when(k == 1, F.concat(F.lit("https://"), slug, F.lit(".example.com/job?p="), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit("https://jobs.lever.co/x?p="), F.col("page_id").cast("string")))
    asked = t("pages").select(url.alias("url"))
    found = urls.find_companies(urls.resolve_job_urls(asked, "url"), companies)
    return found.select(F.regexp_extract("url", r"p=(\d+)", 1).cast("long").alias("page_id"), "slug")


@query("f10_pruned_keys", f"SELECT provider, slug FROM v_companies WHERE {_NUMBER} % 7 = 0")
def _(v, t):
    return lifecycle.subtract_keys(v("v_companies"), v("v_companies").where(_number() % 7 > 0), lifecycle.COMPANY).select("provider", "slug")


@query("f11_new_registry_rows", f"SELECT provider, slug, name FROM v_companies WHERE {_NUMBER} % 7 = 0")
def _(v, t):
    rows = v("v_companies").select("provider", "slug", "name")
    doubled = rows.union(rows.withColumn("name", F.concat("name", F.lit(" again"))))
    return lifecycle.first_per_key(lifecycle.subtract_keys(doubled, rows.where(_number() % 7 > 0), lifecycle.COMPANY), lifecycle.COMPANY, "name")


@query("g18_sync_counts", f"SELECT count(*) FILTER (s % 7 > 0) AS synced, count(*) FILTER (s % 7 > 0 AND status = 'denied') AS denied, count(*) FILTER (s % 7 = 0) AS pruned, count(*) FILTER (s % 10 IN (3, 4, 5, 6, 8)) AS invalid FROM (SELECT *, {_NUMBER} AS s FROM v_companies)")
def _(v, t):
    c = v("v_companies")
    return reports.registry_sync_counts(c, c.where(_number() % 7 > 0), readers.decode_registry(v("v_registry"))[1])


# Ranks


@query("h6_one_draft", "SELECT email, company_norm, first_pos FROM (SELECT *, row_number() OVER (PARTITION BY email ORDER BY first_pos, company_norm) AS n FROM (SELECT recruiter_email AS email, company_name AS company_norm, min(id) AS first_pos FROM v_drafts GROUP BY 1, 2)) WHERE n = 1")
def _(v, t):
    plan = v("v_drafts").groupBy(F.col("recruiter_email").alias("email"), F.col("company_name").alias("company_norm")).agg(F.min("id").alias("first_pos"))
    return outreach.one_draft_per_contact(plan).select("email", "company_norm", "first_pos")


@query("h9_rotate_variants", "SELECT o_orderkey, ['s0', 's1', 's2'][(i % 3 + 1)::INT] AS subject, ['o0', 'o1'][(i // 3 % 2 + 1)::INT] AS opener FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 + 4 AS i FROM orders)")
def _(v, t):
    return reports.rotate_variants(t("orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], ["s0", "s1", "s2"], ["o0", "o1"], 4).select("o_orderkey", "subject", "opener")


@query("h10_remaining", "SELECT greatest(count(*) - 100, 0) AS remaining FROM v_recruiters")
def _(v, t):
    return reports.take_batch(v("v_recruiters"), ["email"])[1]


# State


@query("i6_write_results", f"""SELECT external_id, profile_id, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 6 = 0 THEN 'silent' END ELSE drop_stage END AS drop_stage, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 6 = 0 THEN NULL ELSE 0.5 END ELSE llm_confidence END AS llm_confidence,
    CASE WHEN k % 3 = 0 THEN NULL ELSE notified_at END AS notified_at FROM (SELECT *, CAST(split_part(external_id, '-', 1) AS BIGINT) AS k FROM v_postings)""")  # fmt: skip
def _(v, t):
    p = v("v_postings")
    k = F.split_part("external_id", F.lit("-"), F.lit(1)).cast("long")
    decided = p.where(k % 3 == 0).select(*lifecycle.PK, F.lit(2).alias("run_id"), F.when(k % 6 == 0, "silent").alias("drop_stage"), F.when(k % 6 > 0, 0.5).alias("llm_confidence"))
    earlier = decided.withColumn("run_id", F.lit(1)).withColumn("drop_stage", F.lit("old"))
    return lifecycle.write_results(p, decided.union(earlier)).select("external_id", "profile_id", "drop_stage", "llm_confidence", "notified_at")


def _registry_of(v):
    """Five sevenths of the companies with a new name and status, and as many new ones."""
    own = v("v_companies").where(_number() % 7 > 1).select("provider", "slug", F.concat("name", F.lit(" new")).alias("name"), F.lit("active").alias("status"), "careers_url")
    return own.union(own.withColumn("slug", F.concat("slug", F.lit("-x"))).withColumn("status", F.lit("denied")))


def _old_companies(v):
    return v("v_companies").withColumn("discovered_at", ts("2023-01-01 00:00:00"))


_UPSERT = f"""SELECT slug, CASE WHEN s % 7 > 1 THEN name || ' new' ELSE name END AS name, CASE WHEN s % 7 > 1 AND status NOT IN ('denied', 'broken', 'dormant') THEN 'active' ELSE status END AS status, TIMESTAMP '2023-01-01' AS discovered_at FROM (SELECT *, {_NUMBER} AS s FROM v_companies) {{where}}
    UNION ALL SELECT slug || '-x', name || ' new', 'denied', TIMESTAMP '{EVENTS_NOW}' FROM v_companies WHERE {_NUMBER} % 7 > 1"""


@query("i7_upsert_companies", _UPSERT.format(where="WHERE s % 7 > 1"))
def _(v, t):
    return lifecycle.upsert_companies(_old_companies(v), _registry_of(v), True, ts(EVENTS_NOW)).select("slug", "name", "status", "discovered_at")


@query("i7_upsert_untrusted", _UPSERT.format(where=""))
def _(v, t):
    return lifecycle.upsert_companies(_old_companies(v), _registry_of(v), False, ts(EVENTS_NOW)).select("slug", "name", "status", "discovered_at")


@query("i10_flag_and_switch", f"SELECT slug, {_NUMBER} % 4 = 0 OR url_suspect AS url_suspect, CASE WHEN parsing_strategy = 'llm_scrape' AND {_NUMBER} % 5 <= 3 THEN 'playwright' ELSE parsing_strategy END AS parsing_strategy FROM v_companies")
def _(v, t):
    c = v("v_companies")
    flagged = lifecycle.flag_suspect(c, c.select("provider", "slug", (_number() % 4 > 0).alias("looks_ok")))
    return lifecycle.switch_strategy(flagged, c.select("provider", "slug", (_number() % 5).alias("links"))).select("slug", "url_suspect", "parsing_strategy")


@query("i11_upsert_recruiters", """SELECT email, CASE WHEN k = 0 THEN status WHEN status = 'bounced' OR k = 2 THEN 'bounced' WHEN status = 'verified' OR k = 3 THEN 'verified' ELSE 'unverified' END AS status, CASE WHEN k = 0 THEN company ELSE 'New ' || company END AS company
    FROM (SELECT *, c_custkey % 4 AS k FROM v_recruiters) UNION ALL SELECT 'new' || c_custkey || '@x.example.com', 'unverified', company FROM v_recruiters WHERE c_custkey % 9 = 0""")  # fmt: skip
def _(v, t):
    old = v("v_recruiters").select("email", "status", "company", "c_custkey")
    k = F.col("c_custkey") % 4
    news = old.where(k > 0).select(F.upper("email").alias("email"), F.when(k == 2, "bounced").when(k == 3, "verified").otherwise("unverified").alias("status"), F.concat(F.lit("New "), "company").alias("company"))
    fresh = old.where("c_custkey % 9 = 0").select(F.concat(F.lit("new"), F.col("c_custkey").cast("string"), F.lit("@x.example.com")).alias("email"), F.lit("unverified").alias("status"), "company")
    return lifecycle.upsert_recruiters(old.select("email", "status", "company"), news.union(fresh))


_GONE = "id % 3 = 0"
_ADVANCE = f"""WITH d AS (SELECT *, status = 'draft' AND {_GONE} AS gone, drafted_at >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 14 DAY AS young FROM v_drafts),
    s AS (SELECT id, max(internal_date) AS found FROM d JOIN v_mailbox ON address = recruiter_email AND folder = 'sent' AND internal_date > drafted_at GROUP BY 1),
    one AS (SELECT d.*, CASE WHEN found IS NOT NULL AND (gone OR (status = 'discarded' AND young)) THEN 'sent' WHEN gone THEN 'discarded' ELSE status END AS st1, CASE WHEN found IS NOT NULL AND (gone OR (status = 'discarded' AND young)) THEN found ELSE sent_at END AS at1 FROM d LEFT JOIN s USING (id)),
    b AS (SELECT id, min(internal_date) AS bounced, arg_min(snippet, internal_date) AS snip FROM one JOIN v_mailbox ON address = recruiter_email AND folder = 'bounce' AND internal_date > at1 GROUP BY 1)
    SELECT id, CASE WHEN st1 = 'sent' AND at1 IS NOT NULL AND bounced IS NOT NULL THEN 'bounced' WHEN st1 = 'sent' AND at1 <= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR THEN 'verified' ELSE st1 END AS status, at1 AS sent_at, CASE WHEN st1 = 'sent' AND bounced IS NOT NULL THEN snip END AS failure_detail FROM one LEFT JOIN b USING (id)"""


def _advanced(v):
    gone = v("v_drafts").where(f"status = 'draft' AND {_GONE}").select("id")
    return outreach.advance_outreach(v("v_drafts"), v("v_mailbox"), gone, ts(EVENTS_NOW))


@query("i13_advance_outreach", _ADVANCE)
def _(v, t):
    return _advanced(v).select("id", "status", "sent_at", "failure_detail")


@query("i15_promote_contacts", "SELECT DISTINCT 'u' || c_custkey AS email FROM v_recruiters JOIN (SELECT DISTINCT recruiter_email FROM v_drafts WHERE status = 'sent') ON recruiter_email = 'u' || c_custkey WHERE status = 'verified' AND c_custkey % 5 > 0 AND c_custkey % 4 > 0")
def _(v, t):
    people = v("v_recruiters").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("email"), "status", F.when(F.col("c_custkey") % 5 > 0, "raw-csv").otherwise("manual").alias("source"), "c_custkey")
    return outreach.promote_contacts(v("v_drafts").where("status = 'sent'"), people, people.where("c_custkey % 4 = 0")).select("email")


# The plan: contacts match companies by exact name. The drafts' companies are buckets of customers, the contacts' as well.
def _plan_sql(company: str, employer: str) -> str:
    return f"""WITH roles AS (SELECT o_orderkey AS pos, 'firm ' || ({company}) AS firm, CASE o_orderkey % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'silent' END AS severity FROM orders),
    firms AS (SELECT firm, min(pos) AS first_pos, count(*) AS roles FROM roles WHERE severity <> 'silent' GROUP BY 1), people AS (SELECT 'c' || c_custkey || '@x.example.com' AS email, 'firm ' || ({employer}) AS firm, status, c_custkey FROM v_recruiters),
    last AS (SELECT email, TIMESTAMP '{ORDERS_NOW}' - to_days(CAST(c_custkey % 60 AS INT)) AS drafted FROM people WHERE c_custkey % 2 = 0),
    m AS (SELECT f.firm, first_pos, p.email, p.status, drafted, CASE WHEN p.status = 'bounced' THEN 'bounced_contact' WHEN drafted > TIMESTAMP '{ORDERS_NOW}' - INTERVAL 30 DAY THEN 'cooldown' ELSE 'eligible' END AS state FROM firms f JOIN people p ON p.firm = f.firm LEFT JOIN last l ON l.email = p.email)"""


_PLAN = _plan_sql("o_custkey % 40", "c_custkey % 50")
# In 40 buckets some contact is always eligible, so no role stays undrafted: here each customer is a company with its own
# contact. Of those with 7 the contact works for the next one, so that no contact is left out and some companies have none.
_EMPLOYER = "c_custkey + CASE WHEN c_custkey % 40 = 7 THEN 1 ELSE 0 END"
_PLAN_BY_CUSTOMER = _plan_sql("o_custkey", _EMPLOYER)


def _plan(v, t, company="o_custkey % 40", employer="c_custkey % 50"):
    postings = t("orders").select(F.concat(F.lit("Firm "), F.expr(company).cast("string"), F.lit(" Ltd")).alias("company"), F.concat(F.lit("Role "), F.col("o_orderkey").cast("string")).alias("job_title"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("job_url"), F.element_at(F.array(F.lit("green"), F.lit("yellow"), F.lit("silent")), (F.col("o_orderkey") % 3).cast("int") + 1).alias("severity"), F.lit(0.9).alias("llm_confidence"), F.col("o_orderkey").alias("pos"))
    people = v("v_recruiters").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@x.example.com")).alias("email"), "status", F.concat(F.lit("firm "), F.expr(employer).cast("string")).alias("company_norm"), F.array().cast("array<string>").alias("alt_names_norm"), "c_custkey")
    last = people.where("c_custkey % 2 = 0").select(F.col("email").alias("recruiter_email"), F.expr(f"timestamp'{ORDERS_NOW}' - make_interval(0, 0, 0, cast(c_custkey % 60 as int))").alias("last_drafted_at"))
    return outreach.plan_outreach(postings, people, last, "Hi {{name}}, {{company}}: {{roles}}", ts(ORDERS_NOW))


@query("i17_plan_outreach", f"""{_PLAN}, top AS (SELECT firm, arg_min(pos, (CASE WHEN severity = 'green' THEN 0 ELSE 1 END, pos)) AS top, arg_min('Role ' || pos, pos) AS first FROM roles WHERE severity <> 'silent' GROUP BY 1)
    SELECT email, m.firm AS company_norm, row_number() OVER (PARTITION BY m.firm ORDER BY CASE WHEN status = 'verified' THEN 0 ELSE 1 END, drafted ASC NULLS FIRST, email) AS rank, 'Role ' || top AS top,
    'Hi ' || split_part(email, '@', 1) || ', F' || substr(m.firm, 2) || ' Ltd: ' || first || CASE WHEN roles > 1 THEN ' and ' || (roles - 1) || ' more' ELSE '' END AS body FROM m JOIN top ON top.firm = m.firm JOIN firms ON firms.firm = m.firm WHERE state = 'eligible'""")  # fmt: skip
def _(v, t):
    return _plan(v, t)[0].select("email", "company_norm", "rank", F.col("top.title").alias("top"), "body")


@query("i17_undrafted", f"""{_PLAN_BY_CUSTOMER}, why AS (SELECT firms.firm, CASE WHEN count(m.firm) = 0 THEN 'no_contact' WHEN bool_or(state = 'cooldown') THEN 'cooldown' ELSE 'bounced_contact' END AS reason FROM firms LEFT JOIN m ON m.firm = firms.firm GROUP BY 1 HAVING NOT coalesce(bool_or(state = 'eligible'), false))
    SELECT 'Role ' || pos AS job_title, roles.severity, reason FROM roles JOIN why ON why.firm = roles.firm WHERE roles.severity <> 'silent'""")  # fmt: skip
def _(v, t):
    return _plan(v, t, "o_custkey", _EMPLOYER)[1].select("job_title", "severity", "reason")


@query("i19_sweep_bounces", f"""SELECT o_orderkey, CASE WHEN status = 'drafted' AND "at" >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 21 DAY AND last > "at" THEN 'bounced' ELSE status END AS status FROM v_blast LEFT JOIN (SELECT address, max(internal_date) AS last FROM v_mailbox WHERE folder = 'bounce' GROUP BY 1) ON address = email""")
def _(v, t):
    return outreach.sweep_bounces(v("v_blast"), v("v_mailbox"), ts(EVENTS_NOW)).select("o_orderkey", "status")


@query("i19_append_records", "SELECT profile_id, email, batch FROM (SELECT profile_id, email, batch FROM v_blast UNION ALL SELECT 'p0', email, 99 FROM v_recruiters WHERE c_custkey % 3 = 0)")
def _(v, t):
    records = v("v_blast").select("profile_id", "email", F.col("batch").cast("long").alias("batch"), "status", "at")
    batch = v("v_recruiters").where("c_custkey % 3 = 0").select("email")
    return outreach.append_records(records, batch, "p0", 99, ts(EVENTS_NOW)).select("profile_id", "email", "batch")


@query("i20_log_run", "SELECT event_id AS id, event_type AS kind FROM events WHERE event_id < 500 UNION ALL SELECT 499 + row_number() OVER (ORDER BY ts, event_id), 'run' FROM events WHERE event_id >= 500")
def _(v, t):
    e = t("events")
    runs = e.where("event_id < 500").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("started_at"))
    summary = e.where("event_id >= 500").select(F.lit("run").alias("kind"), F.col("ts").alias("started_at"), F.col("event_id").alias("n"))
    return lifecycle.log_run(runs, summary).select("id", "kind")


@query("i21_resolve_outcomes", f"SELECT slug, CASE WHEN s % 4 = 0 THEN 2 ELSE 1 END AS pass, CASE WHEN s % 4 = 1 THEN NULL WHEN s % 8 = 0 THEN NULL ELSE 'boom' END AS error, s % 4 = 2 AS transport_fault FROM (SELECT slug, {_NUMBER} AS s FROM v_companies)")
def _(v, t):
    c, s = v("v_companies"), _number()
    first = c.select("provider", "slug", F.lit(1).alias("pass"), F.when(s % 4 != 1, "boom").alias("error"), (s % 2 == 0).alias("transport_fault"))
    second = c.where(s % 4 == 0).select("provider", "slug", F.lit(2).alias("pass"), F.when(s % 8 > 0, "boom").alias("error"), F.lit(True).alias("transport_fault"))
    return lifecycle.resolve_outcomes(first.union(second)).select("slug", "pass", "error", "transport_fault")


@query("i4_board_outcomes", """SELECT company_slug, profile_id, CASE WHEN failed THEN 'error' ELSE 'ok' END AS status, CASE WHEN failed THEN 0 ELSE added END AS added, CASE WHEN failed THEN 0 ELSE removed END AS removed, CASE WHEN failed THEN repeat('x', 300) END AS error
    FROM (SELECT company_slug, profile_id, provider < 'nation_2' AS failed, count(*) FILTER (NOT o) AS added, count(*) FILTER (NOT n) AS removed FROM (SELECT *, substr(external_id, -1) IN ('1', '2', '3') AS o, substr(external_id, -1) NOT IN ('1', '0') AS n FROM v_postings) WHERE o OR n GROUP BY 1, 2, 3, provider)""")  # fmt: skip
def _(v, t):
    p = v("v_postings")
    outcomes = p.select(*lifecycle.BOARD).distinct().withColumn("error", F.when(F.col("provider") < "nation_2", F.repeat(F.lit("x"), 400)))
    return lifecycle.board_diff(p.where("substr(external_id, -1) IN ('1', '2', '3')"), p.where("substr(external_id, -1) NOT IN ('1', '0')"), outcomes.union(outcomes.withColumn("error", F.lit(None).cast("string")))).select("company_slug", "profile_id", "status", "added", "removed", "error")


# Streams

@written("i8_stream_failures", "SELECT CAST(ts AS DATE) AS day, 'user-' || user_id AS company_slug, count(*) AS fetches, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1, 2")
def _(spark, v, t):
    root = scratch(spark, "failures")
    events = t("events").select(F.col("ts").cast("timestamp").alias("ts"), F.lit("p").alias("provider"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("company_slug"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"))
    events.write.parquet(f"{root}/in")
    # A last day that nothing happens on closes the days before it.
    close = events.agg(F.max("ts").alias("ts")).select((F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("ts"), F.lit("z").alias("provider"), F.lit("z").alias("company_slug"), F.lit("ok").alias("status"))
    stream = lambda: feed.windowed_failures(spark.readStream.schema(events.schema).parquet(f"{root}/in"))

    def run() -> None:
        stream().writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()

    run()
    close.write.mode("append").parquet(f"{root}/in")
    run()
    return spark.read.parquet(f"{root}/out").where("provider <> 'z'").select(F.col("day").cast("date").alias("day"), "company_slug", "fetches", "failures")

