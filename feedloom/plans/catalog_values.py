"""Registered queries of scalar functions, filters, gate responses, sources and sinks."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import filters, text, times
from feedloom.operators import decide, lifecycle, normalise, outreach, reports, vendors
from feedloom.plans.catalog import EVENTS_NOW, ORACLES, PROFILE, QUERIES, query, ts
from feedloom.plans.tables import scratch, table
from feedloom.plans.views import view, with_views
from feedloom.sources import readers

def written(name: str, sql: str | None = None):
    """Registers a function of session, view getter and table getter that writes files of its own and reads them."""

    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(spark, lambda v: view(spark, sf_dir, v), lambda t: table(spark, sf_dir, t))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register


# Text

@query("c2_attr_entities", "SELECT p_partkey, '<b> ' || p_name || ' &amp; éA &nope; \"' AS body FROM part")
def _(v, t):
    raw = F.concat(F.lit("&lt;b&gt; "), "p_name", F.lit(" &amp;amp; &#233;&#x41; &nope; &quot;"))
    return t("part").select("p_partkey", text.decode_attr_entities(raw).alias("body"))


@query("c4_join_location", "SELECT p_partkey, nullif(concat_ws(', ', CASE WHEN p_partkey % 3 > 0 THEN p_brand END, CASE WHEN p_partkey % 2 > 0 THEN p_type END), '') AS place FROM part")
def _(v, t):
    first, second = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("  "), "p_brand")).otherwise("  "), F.when(F.col("p_partkey") % 2 > 0, F.col("p_type"))
    return t("part").select("p_partkey", text.join_location(first, F.lit(None).cast("string"), second).alias("place"))


@query("c6_times", """SELECT event_id, CASE WHEN event_id % 5 > 0 THEN make_timestamp(event_id * 86400 * 1000000) END AS seconds, CASE WHEN event_id > 0 THEN make_timestamp(event_id * 1000 * 1000) END AS millis,
    CASE WHEN event_id % 2 = 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS day FROM events""")  # fmt: skip
def _(v, t):
    said = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise("not a date")
    return t("events").select("event_id", times.unix_to_ts(F.when(F.col("event_id") % 5 > 0, F.col("event_id") * 86400).otherwise(0)).alias("seconds"), times.epoch_ms_to_ts(F.col("event_id") * 1000).alias("millis"), times.parse_date(said).alias("day"))


@query("c8_parse_age", f"""SELECT event_id, TIMESTAMP '{EVENTS_NOW}' - to_seconds(CAST((event_id % 50 + 1) * CASE event_id % 6 WHEN 0 THEN 60 WHEN 1 THEN 3600 WHEN 2 THEN 86400 WHEN 3 THEN 604800 WHEN 4 THEN 2592000 ELSE 31536000 END AS DOUBLE)) AS at FROM events""")
def _(v, t):
    unit = F.element_at(F.array(*map(F.lit, ("minute", "hours", "days", "weeks", "month", "Years"))), (F.col("event_id") % 6).cast("int") + 1)
    return t("events").select("event_id", times.parse_age(F.concat(F.lit("about "), (F.col("event_id") % 50 + 1).cast("string"), F.lit(" "), unit), ts(EVENTS_NOW)).alias("at"))


@query("c9_vendor_dates", "SELECT event_id, CASE WHEN event_id % 9 = 8 THEN NULL WHEN event_id % 9 = 1 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) END AS at FROM events")
def _(v, t):
    shapes = ("dd-MM-yyyy", "dd-MM-yyyy HH:mm:ss", "dd.MM.yyyy", "M/d/yy", "d/M/yyyy", "yyyyMMdd", "d-MMM-yyyy", "yyyy-MM-dd")
    said = F.coalesce(*[F.when(F.col("event_id") % 9 == i, F.date_format("ts", shape)) for i, shape in enumerate(shapes)], F.lit("soon"))
    return t("events").select("event_id", times.parse_vendor_date(said).alias("at"))


@query("c11_slug_variants", """SELECT s_suppkey, slug FROM (SELECT DISTINCT s_suppkey, unnest([k, replace(k, '-', ''), regexp_replace(k, '-ltd$', ''), replace(regexp_replace(k, '-ltd$', ''), '-', ''), regexp_replace(k, '^the-', '')]) AS slug
    FROM (SELECT s_suppkey, 'the-' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') || '-ltd' AS k FROM supplier)) WHERE length(slug) > 1""")  # fmt: skip
def _(v, t):
    return t("supplier").select("s_suppkey", F.explode(text.slug_variants(F.concat(F.lit("The "), "s_name", F.lit(" Ltd.")))).alias("slug"))


@query("c12_titles", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '(position)' WHEN 1 THEN cap || ' Node.js' WHEN 2 THEN cap || ' C+' ELSE cap END AS title, cap AS sitemap_title FROM (SELECT *, array_to_string([upper(w[1]) || lower(w[2:]) for w in string_split(p_name, ' ')], ' ') AS cap FROM part)""")
def _(v, t):
    name = F.replace("p_name", F.lit(" "), F.lit("-"))
    ends = F.array(F.lit(""), F.lit("-node.js"), F.lit("-c+"), F.lit("-987654.HTML"), F.lit("_987654.aspx"))
    k = F.col("p_partkey") % 5
    last = F.when(k == 0, F.lit("12345")).otherwise(F.concat(name, F.element_at(ends, k.cast("int") + 1)))
    url = F.concat(F.lit("https://a.example.com/jobs/"), last)
    site = F.concat(F.lit("https://a.example.com/job/"), name, F.lit("/"), F.col("p_partkey").cast("string"), F.lit("/"))
    return t("part").select("p_partkey", text.title_from_url(url).alias("title"), text.title_from_sitemap_url(site).alias("sitemap_title"))


@query("c15_emails", """SELECT c_custkey, email, email LIKE 'no-reply@%' AS no_reply FROM (SELECT c_custkey, unnest(['c' || c_custkey || '@x.example.com', CASE WHEN c_custkey % 3 = 0 THEN 'no-reply@y.example.com' WHEN c_custkey % 3 = 1 THEN 'mailer-daemon@y.example.com' END]) AS email FROM customer) WHERE email IS NOT NULL""")
def _(v, t):
    k = F.col("c_custkey") % 3
    cell = F.concat(F.lit(" C"), F.col("c_custkey").cast("string"), F.lit("@X.example.com / nobody, "), F.when(k == 0, "No-Reply@y.example.com").when(k == 1, "Mailer-Daemon@y.example.com").otherwise("two@@z.com"))
    return t("customer").select("c_custkey", F.explode(text.split_emails(cell)).alias("email")).withColumn("no_reply", text.is_no_reply(F.col("email")))


@query("c17_mentions", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'there' ELSE 'Ann' || c_custkey END AS first, CASE WHEN c_custkey % 9 IN (3, 4, 5) THEN c_name WHEN c_custkey % 9 = 6 THEN 'NEC 日本' END AS mention,
    CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'A' ELSE 'A and 2 more' END AS roles FROM customer""")  # fmt: skip
def _(v, t):
    number = F.col("c_custkey").cast("string")
    name = F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.concat(F.lit("  Ann"), number, F.lit(" Lee")))
    names = F.array(F.lit("Unknown"), F.concat(F.lit("The "), "c_name"), F.lit("12"), F.col("c_name"), F.concat("c_name", F.lit(" ")), F.concat("c_name", F.lit(" | Jobs | More")), F.lit("NEC 日本"), F.lit("An unknown firm of Pune"), F.lit("日本電気"))
    company = F.element_at(names, (F.col("c_custkey") % 9).cast("int") + 1)
    titles = F.slice(F.array(F.lit("A"), F.lit("B"), F.lit("C")), 1, F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3)), (F.col("c_custkey") % 3).cast("int") + 1))
    return t("customer").select("c_custkey", text.first_name(name).alias("first"), text.company_for_mention(company).alias("mention"), text.role_summary(titles).alias("roles"))


@query("c20_stable_hash", """WITH RECURSIVE step(k, s, i, h) AS (SELECT DISTINCT p_name, p_name, 1, 2166136261::BIGINT FROM part UNION ALL SELECT k, s, i + 1, (xor(h, ascii(s[i])::BIGINT) * 16777619) & 4294967295 FROM step WHERE i <= length(s)),
    value AS (SELECT k, h FROM step WHERE i = length(s) + 1), digit AS (SELECT '0123456789abcdefghijklmnopqrstuvwxyz' AS d)
    SELECT p_partkey, ltrim(d[(h // 2176782336 % 36 + 1)::INT] || d[(h // 60466176 % 36 + 1)::INT] || d[(h // 1679616 % 36 + 1)::INT] || d[(h // 46656 % 36 + 1)::INT] || d[(h // 1296 % 36 + 1)::INT] || d[(h // 36 % 36 + 1)::INT] || d[(h % 36 + 1)::INT], '0') AS hash
    FROM part JOIN value ON p_name = k, digit""")  # fmt: skip
def _(v, t):
    return t("part").select("p_partkey", text.stable_hash(F.col("p_name")).alias("hash"))


@query("c22_lines", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS body FROM documents")
def _(v, t):
    return t("documents").select("doc_id", F.md5(text.normalize_lines(F.col("text"))).alias("body"))


_ERRORS = ("The operation was aborted", "HTTP 404 for x", "HTTP 429", "HTTP 503 from y", "Schema mismatch", "getaddrinfo ENOTFOUND a", "requires tenant_url", "something else", "CERT_HAS_EXPIRED fetch failed", "Unexpected token '<' is not valid JSON", "Just a moment... Ray ID 7")
_CLASSES = ("timeout", "404", "rate-limited", "5xx", "schema", "network", "config", "other", "network", "other", "other")
_FAULTS = (2, 5, 9, 10)
_AT = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES))


def _error():
    return F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % len(_ERRORS)).cast("int") + 1)


@query("c23_error_class", f"SELECT event_id, CASE event_id % {len(_ERRORS)} {_AT} END AS class FROM events")
def _(v, t):
    return t("events").select("event_id", filters.classify_error(_error()).alias("class"))


@query("c24_infrastructure", f"SELECT event_id, event_id % {len(_ERRORS)} IN ({', '.join(map(str, _FAULTS))}) AS fault FROM events")
def _(v, t):
    return t("events").select("event_id", filters.is_infrastructure_fault(_error()).alias("fault"))


@query("c25_meta_and_dig", """SELECT source_slug, CASE WHEN s % 10 IN (5, 6, 7) THEN NULL ELSE CAST(s AS VARCHAR) END AS k, CASE WHEN s % 2 = 0 THEN 'x' || s END AS dug FROM (SELECT source_slug, CAST(split_part(source_slug, '-', 2) AS BIGINT) AS s FROM v_registry)""")
def _(v, t):
    number = F.split_part("source_slug", F.lit("-"), F.lit(2))
    deep = F.when(number.cast("long") % 2 == 0, F.concat(F.lit('{"a": [{"b": 1}, {"b": "x'), number, F.lit('"}]}'))).otherwise('{"a": []}')
    return v("v_registry").select("source_slug", text.parse_api_meta(F.col("api_meta"))["k"].alias("k"), text.dig(deep, "a.1.b").alias("dug"))


@query("c26_roles", "SELECT id, CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN id % 4 > 0 THEN title END AS title FROM v_drafts")
def _(v, t):
    raw = F.when(F.col("id") % 4 == 0, "{broken").otherwise(F.to_json(F.array(F.struct(F.col("title"), F.lit("u").alias("jobUrl")))))
    return v("v_drafts").select("id", text.parse_roles(raw).alias("r")).select("id", F.size("r").alias("n"), F.get("r", F.lit(0))["title"].alias("title"))


@query("c27_hierarchy", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN n_name || ', India' WHEN 1 THEN 'Site ' || s_suppkey || ', India, ' || n_name WHEN 2 THEN n_name || ', India' ELSE 'India, Site ' || s_suppkey || ', India, ' || n_name END AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(v, t):
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k, site = F.col("s_suppkey") % 4, F.concat(F.lit("Site "), F.col("s_suppkey").cast("string"))
    full = F.when(k % 2 == 0, F.concat("n_name", F.lit(" > India >  > INDIA"))).otherwise(F.concat(F.lit("India > "), "n_name", F.lit(">india")))
    short = F.when(k == 0, F.lower("n_name")).when(k == 1, site).when(k == 2, F.concat(F.lit("INDIA > "), F.lower("n_name"))).otherwise(F.concat(F.lit("India>"), site))
    return rows.select("s_suppkey", text.location_hierarchy(full, short).alias("place"))


@query("c28_location_line", "SELECT p_partkey, CASE WHEN p_partkey % 6 > 0 THEN p_brand END AS place FROM part")
def _(v, t):
    ends = F.array(F.lit(""), F.concat(F.lit(", "), "p_type"), F.lit("<br>more"), F.lit("; more"), F.lit(" | more"), F.lit("\nmore"))
    jd = F.concat(F.lit("About us\n"), F.when(F.col("p_partkey") % 6 > 0, F.concat(F.lit("LOCATION :  "), "p_brand", F.element_at(ends, (F.col("p_partkey") % 6).cast("int") + 1))).otherwise("allocation of things"), F.lit("\nmore"))
    return t("part").select("p_partkey", text.location_from_text(jd).alias("place"))


@query("c29_region", "SELECT s_suppkey, s_suppkey % 13 < 7 AS inside FROM supplier")
def _(v, t):
    cases = ("Bengalūru, INDIA", "IND-KA", "São Pune", "Pune 75001", "Site (IND)", "Indiana/india", "Greater Pune", "Pune, Texas", "Pune, TX", "Pune, OH 75001", "Indianapolis", "Punexx", "US PA IND 324")
    said = F.element_at(F.array(*map(F.lit, cases)), (F.col("s_suppkey") % 13).cast("int") + 1)
    return t("supplier").select("s_suppkey", text.is_place_in_region(said, "India", "IND", ["pune"], ["texas"]).alias("inside"))


# Filters

_LATE = """SELECT external_id, profile_id, CASE WHEN k = 0 THEN 'geo-rejected' WHEN k = 1 THEN 'geo-rejected-title' WHEN k = 2 THEN 'geo-rejected-url' WHEN k = 3 THEN 'geo-rejected-jd-location' WHEN k = 4 THEN 'remote-accept-text' WHEN k = 5 THEN 'in-region-text' WHEN k = 6 THEN 'no-text-defer' ELSE 'unknown-defer' END AS reason,
    k > 3 AS accept FROM (SELECT *, (CAST(split_part(external_id, '-', 1) AS BIGINT) + CAST(split_part(external_id, '-', 2) AS BIGINT)) % 8 AS k FROM v_postings)"""


_LATE_PROFILE = dataclasses.replace(PROFILE, reject_regions=(*PROFILE.reject_regions, "at lantis"))


def _late_rows(v):
    k = (F.split_part("external_id", F.lit("-"), F.lit(1)).cast("long") + F.split_part("external_id", F.lit("-"), F.lit(2)).cast("long")) % 8
    title = F.when(k == 1, "Lead nation_7").when(k == 6, " ").otherwise(F.col("job_title"))
    jd = F.when(k == 0, F.concat(F.repeat(F.lit("x "), 1500), F.lit("Nation_9"))).when(k == 3, "We hire.\nLocation: NATION_8 city\n").when(k == 4, "fully Remote work").when(k == 5, "come to Nation_1 today").when(k == 6, "").otherwise("plain text")
    url = F.when(k == 2, "https://jobs.example.com/at-lantis/x").otherwise(F.col("job_url"))
    return v("v_postings").select("external_id", "profile_id", title.alias("t"), jd.alias("d"), url.alias("u"), "location", "is_remote")


@query("d2_location_text", _LATE)
def _(v, t):
    return _late_rows(v).select("external_id", "profile_id", filters.check_location_text(F.col("t"), F.col("d"), F.col("u"), _LATE_PROFILE).alias("x")).select("external_id", "profile_id", "x.reason", "x.accept")


@query("d3_late_location", f"""WITH late AS ({_LATE}), stated AS (SELECT external_id, profile_id, location, CASE WHEN lower(location) LIKE '%nation_9%' THEN 'geo-rejected' WHEN regexp_matches(lower(location), '\\b(nation_7|nation_8)\\b') THEN 'geo-rejected' WHEN lower(location) LIKE '%remote%' THEN 'remote-accept'
    WHEN regexp_matches(lower(location), '\\b(nation_1|nation_2|nation_3)\\b') THEN CASE WHEN is_remote THEN 'in-region-remote' ELSE 'in-region' END ELSE 'out-of-region' END AS own FROM v_postings)
    SELECT external_id, profile_id, CASE WHEN location IS NULL THEN reason ELSE own END AS reason, CASE WHEN location IS NULL THEN accept ELSE own IN ('remote-accept', 'in-region-remote', 'in-region') END AS accept FROM late JOIN stated USING (external_id, profile_id)""")  # fmt: skip
def _(v, t):
    found = filters.late_location(F.col("location"), F.col("is_remote"), F.col("t"), F.col("d"), F.col("u"), _LATE_PROFILE)
    return _late_rows(v).select("external_id", "profile_id", found.alias("x")).select("external_id", "profile_id", "x.reason", "x.accept")


@query("d10_draftable", "SELECT external_id, profile_id FROM v_postings WHERE coalesce(drop_stage, 'green') IN ('green', 'yellow')")
def _(v, t):
    rows = v("v_postings").withColumn("severity", F.coalesce("drop_stage", F.lit("green")))
    return outreach.draftable(rows).select("external_id", "profile_id")


_CACHE = f"cache AS (SELECT provider, slug, CASE WHEN s % 5 = 0 THEN 0 ELSE s % 3 END AS links, TIMESTAMP '{EVENTS_NOW}' - to_hours(CAST(s % 40 AS INT)) AS cached_at FROM (SELECT provider, slug, CAST(split_part(slug, '-', 2) AS BIGINT) AS s FROM v_companies))"


def _cache(v):
    s = F.split_part("slug", F.lit("-"), F.lit(2)).cast("long")
    n = F.when(s % 5 == 0, 0).otherwise(s % 3).cast("int")
    links = F.slice(F.array(*[F.struct(F.lit(f"u{i}").alias("url"), F.lit("t").alias("title")) for i in range(3)]), 1, n)
    return v("v_companies").select("provider", "slug", links.alias("links"), F.expr(f"timestamp'{EVENTS_NOW}' - make_interval(0, 0, 0, 0, cast(cast(split_part(slug, '-', 2) as long) % 40 as int))").alias("cached_at"))


@query("d11_fresh_links", f"WITH {_CACHE} SELECT provider, slug, CAST(links AS INT) AS links FROM cache WHERE cached_at > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR AND links > 0")
def _(v, t):
    return reports.fresh_links(_cache(v), ts(EVENTS_NOW)).select("provider", "slug", F.size("links").alias("links"))


@query("i18_link_cache", f"WITH {_CACHE} SELECT provider, slug, CASE WHEN s % 2 = 0 AND TIMESTAMP '{EVENTS_NOW}' - INTERVAL 10 HOUR > cached_at THEN TIMESTAMP '{EVENTS_NOW}' - INTERVAL 10 HOUR ELSE cached_at END AS cached_at FROM (SELECT *, CAST(split_part(slug, '-', 2) AS BIGINT) AS s FROM cache)")
def _(v, t):
    cache = _cache(v)
    new = cache.where("split_part(slug, '-', 2) % 2 = 0").withColumn("cached_at", F.expr(f"timestamp'{EVENTS_NOW}' - interval 10 hours"))
    return lifecycle.upsert_link_cache(cache, new).select("provider", "slug", "cached_at")


@query("d14_keep_predicates", "SELECT 'recruitee' AS provider, CAST(p_partkey AS VARCHAR) AS external_id FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT 'mynexthire', CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 4 = 3")
def _(v, t):
    page = F.floor(F.col("p_partkey") / 20).cast("int")
    offer = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 == 0, "published").otherwise("draft").alias("status"), F.lit("https://a.example.com").alias("careers_url"))
    job = F.struct(F.col("p_partkey").alias("reqId"), (F.col("p_partkey") % 4).alias("statusId"), F.col("p_name").alias("reqTitle"))
    pages = t("part").groupBy(page.alias("page")).agg(F.to_json(F.struct(F.collect_list(offer).alias("offers"))).alias("recruitee"), F.to_json(F.struct(F.collect_list(job).alias("reqDetailsBOList"))).alias("mynexthire"))
    raw = pages.select(F.explode(F.create_map(F.lit("recruitee"), "recruitee", F.lit("mynexthire"), "mynexthire")).alias("provider", "body"), "page").withColumn("slug", F.lit("acme"))
    return normalise.normalize_all(raw, {k: vendors.SPECS[k] for k in ("recruitee", "mynexthire")})[0].select("provider", "external_id")


# Gate


@query("e1_prompts", "SELECT external_id, profile_id, md5('Rate ' || job_title || ' at ' || company_slug || ': ' || repeat('ab ', 10) || ' for me') AS prompt FROM v_postings")
def _(v, t):
    rows = v("v_postings").withColumn("company_name", F.col("company_slug")).withColumn("jd_text", F.repeat(F.lit("ab "), 6000))
    made = decide.build_prompts(rows, "Rate {{jobTitle}} at {{companyName}}: {{jdText}} for {{who}}", chars=30, who="me")
    return made.select("external_id", "profile_id", F.md5("prompt").alias("prompt"))


@query("e3_parse_extract", "SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN CAST(doc_id % 9 AS DOUBLE) END AS yoe_min, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 12 + 0.5 AS DOUBLE) END AS yoe_max FROM documents")
def _(v, t):
    low, high = (F.col("doc_id") % 9).cast("string"), F.concat((F.col("doc_id") % 12).cast("string"), F.lit(".5"))
    raw = F.element_at(F.array(F.concat(F.lit('{"yoeMin": '), low, F.lit(', "yoeMax": "'), high, F.lit('"}')), F.concat(F.lit('{"yoeMin": "'), low, F.lit('", "yoeMax": "not stated"}')), F.lit('{"yoeMin": null}'), F.lit("{oops")), (F.col("doc_id") % 4).cast("int") + 1)
    rows = t("documents").select(F.lit("p").alias("provider"), F.col("doc_id").cast("string").alias("external_id"), F.lit("u").alias("profile_id"), raw.alias("raw"))
    return decide.parse_extract(rows).select(F.col("external_id").cast("long").alias("doc_id"), "yoe_min", "yoe_max")


_SCORE = "least(1.0, CASE WHEN job_title LIKE '%ring%' THEN 0.9 ELSE 0 END + CASE WHEN job_title LIKE '%widget%' THEN 0.7 ELSE 0 END)"


@query("e5_score", f"SELECT external_id, profile_id, CAST({_SCORE} AS DOUBLE) AS match_score FROM v_postings")
def _(v, t):
    rows = v("v_postings").select(*lifecycle.PK, "job_title", F.col("company_slug").alias("company_name"), F.lit("").alias("jd_text"))
    return decide.score(rows, decide.keyword_scorer({"ring": 0.9, "widget": 0.7})).select("external_id", "profile_id", "match_score")


@query("j3_scorer_hook", "SELECT external_id, profile_id, CAST(length(job_title) AS DOUBLE) / 100 AS match_score FROM v_postings")
def _(v, t):
    import pandas as pd

    def lengths(batches):
        for b in batches:
            yield pd.DataFrame({"provider": b["provider"], "external_id": b["external_id"], "profile_id": b["profile_id"], "match_score": b["job_title"].str.len() / 100.0, "deal_breaker_hit": None, "deal_breaker_severity": None, "reason": "length", "yoe_min": None, "yoe_max": None, "gate_error": None})

    return decide.score(v("v_postings").select(*lifecycle.PK, "job_title"), lengths).select("external_id", "profile_id", "match_score")


@query("j4_profile", """SELECT external_id, profile_id, regexp_matches(job_title, '^blue') AS skip, lower(coalesce(location, '')) LIKE '%nation_1%' AS rejected FROM v_postings""")
def _(v, t):
    own = filters.Profile.from_dict(dataclasses.asdict(PROFILE) | {"title_deny": ["^blue"], "reject": ["nation_1"]})
    rejected = filters.check_location(F.col("location"), F.col("is_remote"), own)["reason"] == "geo-rejected"
    place = F.lower(F.coalesce("location", F.lit(""))).rlike(r"nation_1")
    return v("v_postings").select("external_id", "profile_id", filters.check_title(F.col("job_title"), own.title_deny)["skip"].alias("skip"), (rejected & place).alias("rejected"))


@query("h12_best_candidate", "SELECT l_orderkey, min(l_quantity) FILTER (l_quantity >= 10) AS least, arg_min(l_suppkey, (l_discount, l_suppkey)) AS supplier FROM lineitem GROUP BY 1")
def _(v, t):
    # An order has a handful of lines.
    rows = t("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"), F.collect_list(F.struct("l_discount", "l_suppkey")).alias("s"))
    return rows.select("l_orderkey", filters.best_candidate(F.col("q"), lambda x: x >= 10).alias("least"), filters.best_candidate(F.col("s"))["l_suppkey"].alias("supplier"))


# Sources and sinks

_REGISTRY = list(readers.REGISTRY_COLUMNS)
_ISSUES = "CASE s % 10 WHEN 3 THEN 'careers_url: not a url; tenant_url: not a url' WHEN 4 THEN 'status: unknown value' WHEN 5 THEN 'api_meta: not valid JSON' WHEN 6 THEN 'api_meta: not an object of strings' WHEN 8 THEN 'tenant_url: not a url' ELSE '' END"


@written("a1_read_registry", f"SELECT source_slug, CASE WHEN {_ISSUES} = '' AND s % 10 <> 7 THEN CAST(s AS VARCHAR) END AS k, {_ISSUES} AS issues FROM (SELECT *, CAST(split_part(source_slug, '-', 2) AS BIGINT) AS s FROM v_registry)")
def _(spark, v, t):
    path = scratch(spark, "registry")
    readers.write_csv_rows(v("v_registry").select(*_REGISTRY), path)
    valid, bad = readers.read_registry(spark, path)
    return valid.select("source_slug", F.col("api_meta")["k"].alias("k"), F.lit("").alias("issues")).union(bad.select("source_slug", F.lit(None).cast("string"), "issues"))


@written("a2_registry_cache", "SELECT provider, slug, name, 'cache' AS source_kind FROM v_companies")
def _(spark, v, t):
    path = scratch(spark, "cache")
    # Files of twenty entries each.
    part = F.floor(F.split_part("slug", F.lit("-"), F.lit(2)).cast("long") / 20)
    files = v("v_companies").groupBy(part.alias("part")).agg(F.to_json(F.collect_list(F.struct("provider", "slug", "name"))).alias("value"))
    files.write.partitionBy("part").text(path)
    return readers.read_registry_cache(spark, f"{path}/*", "provider string, slug string, name string")


@query("a3_encode_registry", "SELECT source_slug, name, careers_url, coalesce(tenant_url, '') AS tenant_url, CASE WHEN s % 10 IN (5, 6, 7) THEN '' ELSE '{\"k\":\"' || s || '\"}' END AS api_meta, '' AS employer_type FROM (SELECT *, CAST(split_part(source_slug, '-', 2) AS BIGINT) AS s FROM v_registry)")
def _(v, t):
    rows = v("v_registry").withColumn("api_meta", text.parse_api_meta(F.when(F.col("api_meta").startswith("{\"k"), F.col("api_meta"))))
    return readers.encode_registry(rows).select("source_slug", "name", "careers_url", "tenant_url", "api_meta", "employer_type")


@written("a4_csv_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(coalesce(replace(text, chr(13), ' '), '')) AS body FROM documents")
def _(spark, v, t):
    path = scratch(spark, "csv")
    readers.write_csv_rows(t("documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.replace("text", F.lit("\r"), F.lit(" ")).alias("text")), path)
    return readers.read_csv_rows(spark, path, ["doc_id", "text"]).select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("body"))


@query("a5_read_contacts", """SELECT email, CASE WHEN manual THEN 'manual' ELSE 'raw-csv' END AS source, CASE WHEN manual THEN 'verified' ELSE 'unverified' END AS status, alts FROM (
    SELECT 'c' || c_custkey || '@' || lower(c_mktsegment) || '.example.com' AS email, c_custkey % 4 = 0 AS manual, CASE WHEN c_custkey % 4 > 0 AND c_custkey % 5 = 0 THEN 2 ELSE 0 END AS alts FROM customer
    UNION ALL SELECT 'alt' || c_custkey || '@x.example.com', false, CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 0 END FROM customer)""")  # fmt: skip
def _(v, t):
    raw = v("v_contact_cells")
    manual = raw.where("c_custkey % 4 = 0").select(F.split_part("emails", F.lit(" "), F.lit(1)).alias("emails"), "company", "contact_name")
    return outreach.read_contacts(raw, manual).select("email", "source", "status", F.size("alt_names_norm").alias("alts"))


@written("a6_blast_state", "SELECT profile_id, email, status, CAST(batch AS INT) AS batch FROM v_blast")
def _(spark, v, t):
    path = scratch(spark, "blast")
    # A line holds the records of a thousand orders at most.
    record = F.struct("email", "status", F.col("batch").cast("int").alias("batch"))
    states = v("v_blast").groupBy("profile_id", F.floor(F.col("o_orderkey") / 1000).alias("k")).agg(F.to_json(F.struct(F.collect_list(record).alias("records"))).alias("value")).drop("k")
    states.write.partitionBy("profile_id").text(path)
    return readers.read_blast_state(spark, f"{path}/*", "email string, status string, batch int", lines=True)


@written("a7_read_diag", "SELECT event_id, event_type FROM events WHERE event_id % 3 > 0")
def _(spark, v, t):
    path = scratch(spark, "diag")
    lines = t("events").select(F.to_json(F.struct("event_id", "event_type")).alias("value"))
    cut = t("events").where("event_type = 'error'").select(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "event_ty')).alias("value"))
    lines.union(cut).write.text(path)
    found = readers.read_diag(spark, path, "event_id long, event_type string")
    return lifecycle.subtract_keys(found, t("events").where("event_id % 3 = 0"), ["event_id"])


@written("a8_read_payloads", "SELECT provider, slug, page, md5(body) AS body FROM (SELECT 'g' AS provider, 'r' || n_regionkey AS slug, CAST(n_nationkey AS INT) AS page, n_name AS body FROM nation UNION ALL SELECT 'g', 's' || s_suppkey, 1, s_name FROM supplier)")
def _(spark, v, t):
    path = scratch(spark, "payloads")
    own = [F.lit("g").alias("provider")]
    rest = [ts(EVENTS_NOW).alias("fetched_at"), F.lit(None).cast("long").alias("reported_total"), F.lit("json").alias("kind")]
    nations = t("nation").select(*own, F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("slug"), F.col("n_nationkey").cast("int").alias("page"), *rest, F.col("n_name").alias("body"))
    suppliers = t("supplier").select(*own, F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slug"), F.lit(1).alias("page"), *rest, F.col("s_name").alias("body"))
    nations.union(suppliers).write.json(path)
    return readers.read_payloads(spark, path).select("provider", "slug", "page", F.md5("body").alias("body"))


@written("a9_table_store", "SELECT slug, CASE WHEN status = 'active' THEN 'seen' ELSE status END AS status, 'none' AS owner FROM v_companies")
def _(spark, v, t):
    path, rows = scratch(spark, "store"), v("v_companies").select("slug", "status", "provider")
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("owner", T.StringType())])
    readers.write_table(rows, path, ("provider",))
    # One column is younger than the files, and only the providers with a change are written again.
    held = readers.read_table(spark, path, schema, "provider string")
    some = held.join(held.where("status = 'active'").select("provider").distinct(), "provider").withColumn("status", F.when(F.col("status") == "active", "seen").otherwise(F.col("status")))
    readers.publish(some, path, ("provider",), least=0.0)
    return readers.read_table(spark, path, schema, "provider string", {"owner": F.lit("none")}).select("slug", "status", "owner")


@written("a13_guarded_publish", "SELECT slug, status, true AS refused FROM v_companies WHERE status <> 'denied'")
def _(spark, v, t):
    path, rows = scratch(spark, "publish"), v("v_companies").select("provider", "slug", "status")
    readers.publish(rows, path)
    readers.publish(rows.where("status <> 'denied'"), path)
    refused = 0
    for worse in (rows.limit(0), rows.where("status = 'dormant'")):
        try:
            readers.publish(worse, path)
        except ValueError:
            refused += 1
    return readers.read_table(spark, path, rows.schema).select("slug", "status", F.lit(refused == 2).alias("refused"))


def _with_roles(v):
    role = lambda title, green, score: F.struct(title.alias("title"), F.concat(F.lit("u/"), title).alias("jobUrl"), F.when(green, "green").otherwise("yellow").alias("severity"), score.alias("score"))
    own, other = F.col("title"), F.concat("title", F.lit(" b"))
    return v("v_drafts").withColumn("roles", F.array(role(own, F.col("green"), F.col("score")), role(other, F.lit(False), F.lit(0.5))))


_TOP = "CASE WHEN green OR score >= 0.5 THEN {} ELSE {} END"


@query("a10_project_drafts", f"SELECT id, title || ' — u/' || title || chr(10) || title || ' b — u/' || title || ' b' AS roles_text, CASE WHEN green THEN 'green' ELSE 'yellow' END AS severity, {_TOP.format('score', '0.5')}::DOUBLE AS score FROM v_drafts WHERE status = 'draft'")
def _(v, t):
    return outreach.project_drafts(_with_roles(v)).select("id", "roles_text", "severity", "score")


@query("a10_project_sent", "SELECT id, sent_at + INTERVAL 24 HOUR AS check_after FROM v_drafts WHERE sent_at IS NOT NULL")
def _(v, t):
    return outreach.project_sent(_with_roles(v)).select("id", "check_after")


@query("g14_top_role", "SELECT id, CASE WHEN id % 5 = 0 THEN CASE WHEN green THEN title ELSE title || ' c' END WHEN green OR score >= 0.5 THEN title ELSE title || ' b' END AS title FROM v_drafts")
def _(v, t):
    # No score is less than any, also than one below zero.
    role = lambda title, severity, score: F.struct(title.alias("title"), F.lit("u").alias("jobUrl"), severity.alias("severity"), score.alias("score"))
    third = F.array(role(F.col("title"), F.when(F.col("green"), "green").otherwise("yellow"), F.lit(None).cast("double")), role(F.concat("title", F.lit(" c")), F.lit("yellow"), F.lit(-1.0)))
    roles = F.when(F.col("id") % 5 == 0, third).otherwise(F.col("roles"))
    return _with_roles(v).withColumn("roles", roles).select("id", outreach.top_role(F.col("roles"))["title"].alias("title"))


@query("i14_discarded_roles", "SELECT run_id, company_name AS company, unnest([title, title || ' b']) AS job_title, 'draft_discarded' AS reason FROM v_drafts WHERE status = 'discarded'")
def _(v, t):
    return outreach.discarded_roles(_with_roles(v)).select("run_id", "company", "job_title", "reason")


@written("a11_append_undrafted", "SELECT run_id, company_name AS company, unnest([title, title || ' b']) AS job_title FROM v_drafts WHERE status = 'discarded' AND run_id IN (1, 2)")
def _(spark, v, t):
    path, rows = scratch(spark, "undrafted"), outreach.discarded_roles(_with_roles(v))
    for run in (1, 2, 1):
        readers.append_undrafted(rows, run, path)
    return spark.read.parquet(path).select(F.col("run_id").cast("long").alias("run_id"), "company", "job_title")


@query("a12_blast_log", "SELECT profile_id, batch, email, company, status, variant, \"at\", coalesce(note, '') AS note FROM v_blast")
def _(v, t):
    return readers.project_blast_log(v("v_blast").withColumn("batch", F.col("batch").cast("long")))



# Rules whose cases the tables above do not hold.

_JDS = (("TBD.", True), ("Job description goes here", True), ("!!! --- %%", True), ("", False), ("Real work", False), (" Attached\n", True), ("n/a", True), ("Lorem ipsum dolor", True), ("TBD later today", False), ("Please enter the job description.", True))


@query("d6_placeholders", f"SELECT p_partkey, p_partkey % {len(_JDS)} IN ({', '.join(str(i) for i, (_, junk) in enumerate(_JDS) if junk)}) AS junk FROM part")
def _(v, t):
    said = F.element_at(F.array(*[F.lit(x) for x, _ in _JDS]), (F.col("p_partkey") % len(_JDS)).cast("int") + 1)
    return t("part").select("p_partkey", filters.is_junk_jd(said).alias("junk"))


@query("e4_verdict_reason", """SELECT doc_id, CASE WHEN deal_breaker_severity = 'hard' THEN coalesce(deal_breaker_hit, 'hard-deal-breaker') WHEN match_score < 0.65 AND regexp_matches(job_title, 'src1') AND NOT coalesce(yoe_min >= 6, false) THEN 'priority-title, borderline score (' || printf('%.2f', match_score) || ')'
    WHEN match_score < 0.65 THEN 'score-too-low (' || printf('%.2f', match_score) || ')' WHEN yoe_min >= 6 THEN 'needs ' || CAST(yoe_min AS INT) || '+ years (hard cap 6)' WHEN deal_breaker_severity = 'soft' THEN 'soft: ' || coalesce(deal_breaker_hit, 'soft-deal-breaker') WHEN yoe_min IS NULL AND yoe_max IS NULL THEN 'yoe-unknown'
    WHEN yoe_min > 4.5 THEN 'under-qualified (needs ' || CAST(yoe_min AS INT) || '+)' WHEN yoe_max < 4.5 THEN 'over-qualified (max ' || CAST(yoe_max AS INT) || ')' WHEN match_score >= 0.8 THEN reason ELSE 'borderline-score (' || printf('%.2f', match_score) || ')' END AS reason FROM v_gate""")  # fmt: skip
def _(v, t):
    return v("v_gate").select("doc_id", filters.classify_verdict(PROFILE)["reason"].alias("reason"))


@query("f5_match_tiers", """SELECT 'firm ' || n AS company_norm, email, n % 3 + 1 AS tier FROM (SELECT c_custkey AS k, c_custkey % 40 AS n, CASE WHEN c_custkey % 3 = 2 THEN 'c' || c_custkey || '@firm' || (c_custkey % 40) || '.example.com' ELSE 'c' || c_custkey || '@x.example.com' END AS email FROM customer) WHERE k % 3 = n % 3""")
def _(v, t):
    k, firm = F.col("c_custkey"), F.concat(F.lit("firm "), (F.col("c_custkey") % 40).cast("string"))
    rank = (k % 40) % 3
    email = F.concat(F.lit("c"), k.cast("string"), F.when(k % 3 == 2, F.concat(F.lit("@"), F.replace(firm, F.lit(" "), F.lit("")), F.lit(".example.com"))).otherwise("@x.example.com"))
    # Contacts by own name, by alternative name, by the label of their domain; a tier counts where no better one has a match.
    people = t("customer").select(email.alias("email"), F.lit("verified").alias("status"), F.when((k % 3 == 0) & (rank == 0), firm).otherwise("zzz").alias("company_norm"), F.when((k % 3 == 1) & (rank < 2), F.array(F.lit("other"), firm)).otherwise(F.array().cast("array<string>")).alias("alt_names_norm"))
    groups = t("customer").select(firm.alias("company_norm")).distinct()
    return outreach.match_contacts(groups, people).select("company_norm", "email", F.col("tier").cast("long").alias("tier"))
