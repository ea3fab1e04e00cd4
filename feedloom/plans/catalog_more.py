"""Registered queries of contacts, outreach, payloads, gate and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text
from feedloom.operators import decide, normalise, outreach, reports, urls
from feedloom.plans.catalog import EVENTS_NOW, ORDERS_NOW, PROFILE, QUERIES, ORACLES, query, ts
from feedloom.plans.tables import scratch, table
from feedloom.streaming import feed

# Contacts and outreach

_NORM = "regexp_replace(trim(regexp_replace(regexp_replace(lower(company), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '( (pvt|ltd|inc))+$', '')"
_PEOPLE = f"people AS (SELECT email, status, {_NORM} AS own, lower(c_mktsegment) AS label, c_custkey FROM v_recruiters)"
_MATCH = f"{_PEOPLE}, matches AS (SELECT own AS company_norm, email, status, 1 AS tier FROM people UNION ALL SELECT label, email, status, 3 FROM people)"


def _people(v):
    r = v("v_recruiters")
    return r.select("email", "status", text.normalize_company_name(F.col("company")).alias("company_norm"), F.array().cast("array<string>").alias("alt_names_norm"), "c_custkey", "c_mktsegment")


def _matches(v):
    p = _people(v)
    groups = p.select("company_norm").union(p.select(F.lower("c_mktsegment"))).distinct()
    return outreach.match_contacts(groups, p)


@query("f5_match_contacts", f"WITH {_MATCH} SELECT * FROM matches")
def _(v, t):
    return _matches(v)


_LAST = "last AS (SELECT 'c' || CAST(o_custkey AS VARCHAR) || '@' || lower(c_mktsegment) || '.example.com' AS email, max(o_orderdate) AS last_drafted_at FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"
_STATE = f"{_MATCH}, {_LAST}, states AS (SELECT m.*, last_drafted_at, CASE WHEN status = 'bounced' THEN 'bounced_contact' WHEN last_drafted_at > TIMESTAMP '{ORDERS_NOW}' - INTERVAL 30 DAY THEN 'cooldown' ELSE 'eligible' END AS state FROM matches m LEFT JOIN last USING (email))"


def _states(v, t):
    drafts = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    email = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com"))
    last = drafts.groupBy(email.alias("recruiter_email")).agg(F.max("o_orderdate").alias("last_drafted_at"))
    return outreach.split_cooldown(_matches(v), last, ts(ORDERS_NOW))


@query("i16_split_cooldown", f"WITH {_STATE} SELECT company_norm, email, state FROM states")
def _(v, t):
    return _states(v, t).select("company_norm", "email", "state")


@query("h5_rank_contacts", f"""WITH {_STATE} SELECT company_norm, email, row_number() OVER (PARTITION BY company_norm ORDER BY CASE WHEN status = 'verified' THEN 0 ELSE 1 END, last_drafted_at ASC NULLS FIRST, email) AS rank
    FROM states WHERE state = 'eligible'""")  # fmt: skip
def _(v, t):
    return outreach.rank_contacts(_states(v, t).where("state = 'eligible'")).select("company_norm", "email", "rank")


@query("g15_undrafted_reason", f"""WITH {_STATE} SELECT company_norm, CASE WHEN bool_or(state = 'cooldown') THEN 'cooldown' ELSE 'bounced_contact' END AS reason FROM states GROUP BY 1 HAVING NOT bool_or(state = 'eligible')""")
def _(v, t):
    return outreach.undrafted_reason(_states(v, t))


@query("g13_group_by_company", f"""SELECT job_title AS company_norm, count(*) AS roles, min(external_id) AS first_id FROM v_postings WHERE profile_id = 'p0' GROUP BY 1""")
def _(v, t):
    p = v("v_postings").where("profile_id = 'p0'").select(F.col("job_title").alias("company"), F.col("external_id").alias("job_title"), "job_url", F.lit("green").alias("severity"), "llm_confidence", F.col("external_id").alias("pos"))
    return outreach.group_by_company(p).select("company_norm", "roles", F.col("first_title").alias("first_id"))


_OUT = """out AS (SELECT o_orderkey AS id, 'u' || CAST(o_custkey % 150 AS VARCHAR) AS recruiter_email, TIMESTAMP '2024-01-01' + to_days(CAST(o_orderkey % 30 AS INT)) AS drafted_at,
    CASE WHEN o_orderkey % 2 = 0 THEN TIMESTAMP '2024-01-02' + to_days(CAST(o_orderkey % 30 AS INT)) END AS sent_at FROM orders)"""


def _mail(t):
    kind = F.when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "error", "bounce")
    return t("events").select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), kind.alias("folder"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("address"), F.col("ts").alias("internal_date"), F.col("props").alias("snippet"))


_MAIL = f"""WITH {_OUT}, s AS (SELECT id, max(ts) AS found_sent_at, arg_max('m' || CAST(event_id AS VARCHAR), ts) AS found_message_id FROM out JOIN events ON recruiter_email = 'u' || CAST(user_id AS VARCHAR) AND event_type = 'purchase' AND ts > drafted_at GROUP BY 1),
    b AS (SELECT id, min(ts) AS bounced_at FROM out JOIN events ON recruiter_email = 'u' || CAST(user_id AS VARCHAR) AND event_type = 'error' AND ts > sent_at GROUP BY 1)
    SELECT id, found_sent_at, found_message_id, bounced_at FROM out LEFT JOIN s USING (id) LEFT JOIN b USING (id)"""


def _correlated(t, drafts):
    day = lambda first: F.expr(f"timestamp'{first}' + make_interval(0, 0, 0, cast(o_orderkey % 30 as int))")
    rows = drafts.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("u"), (F.col("o_custkey") % 150).cast("string")).alias("recruiter_email"), day("2024-01-01").alias("drafted_at"), F.when(F.col("o_orderkey") % 2 == 0, day("2024-01-02")).alias("sent_at"))
    return outreach.correlate_mail(rows, _mail(t)).select("id", "found_sent_at", "found_message_id", "bounced_at")


@query("f9_correlate_mail", _MAIL)
def _(v, t):
    return _correlated(t, t("orders"))


@query("h11_latest_message", "SELECT 'u' || CAST(user_id AS VARCHAR) AS address, arg_max('m' || CAST(event_id AS VARCHAR), ts) AS message_id, max(ts) AS internal_date FROM events GROUP BY 1")
def _(v, t):
    return outreach.latest_message(_mail(t))


@query("d12_campaign_pool", """WITH e AS (SELECT c_custkey, company, unnest([email, 'x' || c_custkey % 40 || '@y.example.com', 'mailer-daemon@z' || c_custkey % 9 || '.example.com']) AS email FROM v_recruiters)
    SELECT email, min(c_custkey) AS first FROM e WHERE email NOT IN (SELECT email FROM v_recruiters WHERE c_custkey % 3 = 0) GROUP BY 1""")
def _(v, t):
    number = F.col("c_custkey")
    cell = F.concat(F.upper("email"), F.lit(" / x"), (number % 40).cast("string"), F.lit("@y.example.com, nobody, No-Reply@y.example.com/mailer-daemon@z"), (number % 9).cast("string"), F.lit(".example.com"))
    r = v("v_recruiters").select("email", "company", "c_custkey")
    pool = outreach.campaign_pool(r.select(cell.alias("email"), "company", number.alias("pos")), r.where("c_custkey % 3 = 0").withColumn("profile_id", F.lit("p0")), "p0")
    return pool.select("email", F.col("pos").alias("first"))


@query("d13_deliverable", "SELECT email, c_mktsegment IN ('BUILDING', 'MACHINERY') AS deliverable FROM v_recruiters")
def _(v, t):
    r = v("v_recruiters")
    verdicts = r.select(F.concat(F.lower("c_mktsegment"), F.lit(".example.com")).alias("domain"), (F.col("c_mktsegment") != "FURNITURE").alias("ok")).where("domain LIKE 'building%' OR domain LIKE 'machinery%' OR domain LIKE 'furniture%'").distinct()
    return outreach.deliverable(r, verdicts).select("email", "deliverable")


@query("g16_campaign_stats", """WITH r AS (SELECT 'p' || CAST(c_nationkey % 5 AS VARCHAR) AS profile_id, year(o_orderdate) - 1991 AS batch, o_orderdate AS at, CASE WHEN o_orderkey % 11 = 0 THEN 'bounced' WHEN o_orderkey % 13 = 0 THEN 'skipped_invalid' ELSE 'drafted' END AS status FROM orders JOIN customer ON o_custkey = c_custkey),
    l AS (SELECT profile_id, max(batch) AS batch, count(*) AS drafted_ever FROM r WHERE status <> 'skipped_invalid' GROUP BY 1)
    SELECT l.profile_id, l.batch, drafted_ever, avg(CASE WHEN status = 'bounced' THEN 100.0 ELSE 0 END) > 10 AS bounced_out FROM l JOIN r ON r.profile_id = l.profile_id AND r.batch = l.batch AND status <> 'skipped_invalid' GROUP BY 1, 2, 3""")  # fmt: skip
def _(v, t):
    status = F.when(F.col("o_orderkey") % 11 == 0, "bounced").when(F.col("o_orderkey") % 13 == 0, "skipped_invalid").otherwise("drafted")
    r = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("p"), (F.col("c_nationkey") % 5).cast("string")).alias("profile_id"), (F.year("o_orderdate") - 1991).cast("long").alias("batch"), F.col("o_orderdate").alias("at"), status.alias("status"))
    return reports.campaign_stats(r, ts(ORDERS_NOW)).select("profile_id", "batch", "drafted_ever", "bounced_out")


# Payloads


@query("b1_normalize_json", "SELECT 'g' AS provider, r_name AS company_slug, 'n' || CAST(n_nationkey AS VARCHAR) AS external_id, n_name AS job_title, 'https://jobs.example.com/' || CAST(n_nationkey AS VARCHAR) AS job_url FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 6 > 0")
def _(v, t):
    spec = normalise.JsonSpec("jobs array<struct<id:string,title:string,live:boolean>>", "jobs", {"external_id": "concat('n', item.id)", "job_title": "item.title", "job_url": "concat('https://jobs.example.com/', item.id)"}, "item.live")
    job = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title"), (F.col("n_nationkey") % 6 > 0).alias("live"))
    raw = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.to_json(F.struct(F.array_sort(F.collect_list(job)).alias("jobs"))).alias("body"))
    return normalise.normalize_json(raw.select(F.lit("g").alias("provider"), F.col("r_name").alias("slug"), F.lit(1).alias("page"), "body"), spec).select("provider", "company_slug", "external_id", "job_title", "job_url")


@query("b3_normalize_island", "SELECT DISTINCT 'supplier-' || CAST(p_size AS VARCHAR) AS company_slug, replace(p_name, ' ', '-') AS external_id FROM part")
def _(v, t):
    html = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), F.to_json(F.struct(F.struct(F.collect_list(F.struct(F.col("p_name").alias("title"))).alias("jobs")).alias("props"))), F.lit("</script>"))
    pages = t("part").groupBy("p_size").agg(html.alias("html")).select(F.lit("i").alias("provider"), F.concat(F.lit("supplier-"), F.col("p_size").cast("string")).alias("slug"), F.lit(1).alias("page"), "html")
    return normalise.normalize_island(pages, "props.jobs", "title").select("company_slug", "external_id")


@query("b4_normalize_sitemap", "SELECT 'jobs.example.com/' || CASE p_partkey % 12 WHEN 1 THEN 'jobs/' WHEN 2 THEN 'en/Careers/' WHEN 3 THEN 'vacancies/' WHEN 4 THEN 'x/' END || replace(p_name, ' ', '-') || '-' || CAST(p_partkey + 10000 AS VARCHAR) AS external_id FROM part WHERE p_partkey % 12 BETWEEN 1 AND 4")
def _(v, t):
    # Folders of roles; ids in the query; what is no role: other folders and queries, navigation, files.
    folders = ("about/", "jobs/", "en/Careers/", "vacancies/", "x/", "y/", "roles/", "jobs/category/", "search/jobs/", "jobs/", "jobs/", "jobsite/")
    ends = ("", "", "/", "#top", "?a=1&requisitionId=7", "?req=5", "", "", "", ".pdf", ".woff2", "")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % 12).cast("int") + 1)
    loc = F.concat(F.lit("<url><loc>https://jobs.example.com/"), pick(folders), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), (F.col("p_partkey") + 10000).cast("string"), F.replace(pick(ends), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    files = t("part").groupBy(F.floor(F.col("p_partkey") / 100).alias("f")).agg(F.array_join(F.collect_list(loc), "").alias("body")).select(F.lit("s").alias("provider"), F.col("f").cast("string").alias("slug"), "body")
    return normalise.normalize_sitemap(files).select(F.regexp_replace("external_id", "/$", "").alias("external_id"))


@query("b6_extract_jsonld", "SELECT DISTINCT p_name AS job_title, p_brand AS location FROM part")
def _(v, t):
    node = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("p_name").alias("title"), F.lit("u").alias("url"), F.struct(F.struct(F.col("p_brand").alias("addressLocality")).alias("address")).alias("jobLocation")))
    html = F.concat(F.lit("<script type='application/ld+json'>"), node, F.lit("</script>"))
    return normalise.extract_jsonld(t("part").select(F.col("p_partkey").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))).select("job_title", "location")


# Anchors of pages on their own host, and whether their words or their path speak of jobs.
_ANCHOR = "(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"''][^>]*>(.*?)</a>"
_ANCHORS = f"""WITH a AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, unnest(regexp_extract_all(html, '{_ANCHOR}', 1)) AS href, unnest(regexp_extract_all(html, '{_ANCHOR}', 2)) AS body FROM pages),
    l AS (SELECT page_id, url, regexp_replace(CASE WHEN href LIKE '/%' THEN origin || href ELSE href END, '#.*$', '') AS link, trim(regexp_replace(regexp_replace(body, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM a WHERE href LIKE '/%' OR starts_with(href, origin || '/')),
    links AS (SELECT *, regexp_replace(link, '^[a-z]+://[^/?#]*', '') AS after, rtrim(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') <> rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') AS away FROM l)"""


@query("b16_extract_links", f"""{_ANCHORS} SELECT page_id, link, min(text) AS text FROM links WHERE away AND length(text) BETWEEN 3 AND 200 AND (regexp_matches(lower(after), '{normalise._JOB_URL}') OR regexp_matches(text, '{normalise._ROLE_WORDS}')) GROUP BY 1, 2""")
def _(v, t):
    return normalise.extract_links(t("pages")).select("page_id", "link", "text")


_SAYS, _LEADS = ("(?i)(" + ")|(".join(x) + ")" for x in (normalise.OPENINGS_TEXT, normalise.OPENINGS_URL))


@query("b17_openings_link", f"""{_ANCHORS}, s AS (SELECT page_id, link, CASE WHEN regexp_matches(text, '{_SAYS}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(after, '{_LEADS}') THEN 2 ELSE 0 END AS score FROM links WHERE away)
    SELECT page_id, max(score) AS score FROM s WHERE score >= 2 GROUP BY 1""")  # fmt: skip
def _(v, t):
    return normalise.pick_openings_link(t("pages")).select("page_id", "score")


_TEXT_OF = "trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{0}\\b[^>]*>(.*?)</{0}\\s*>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"


@query("b18_title_hint", f"""SELECT page_id, CASE WHEN length(h) BETWEEN 3 AND 200 THEN h WHEN t = '' THEN NULL WHEN trim(regexp_extract(t, '\\(([^)]+)\\)\\s*$', 1)) <> '' THEN trim(regexp_extract(t, '\\(([^)]+)\\)\\s*$', 1))
    WHEN length(b) BETWEEN 3 AND 200 THEN b ELSE substr(t, 1, 200) END AS hint FROM (SELECT *, trim(regexp_extract(t, '^(.*?)\\s*(?:[|·•–—]|$)', 1)) AS b FROM (SELECT page_id, {_TEXT_OF.format('h1')} AS h, {_TEXT_OF.format('title')} AS t FROM pages))""")  # fmt: skip
def _(v, t):
    return t("pages").select("page_id", normalise.title_hint(F.col("html")).alias("hint"))


_BARE = "html"
for _tag in ("script", "style", "noscript", "nav", "header", "footer", "aside", "form", "iframe"):
    _BARE = f"regexp_replace({_BARE}, '(?is)<{_tag}\\b[^>]*>.*?</{_tag}\\s*>', '', 'g')"
_WHOLE = f"coalesce(nullif(regexp_extract({_BARE}, '(?is)<main\\b[^>]*>(.*)</main\\s*>', 1), ''), nullif(regexp_extract({_BARE}, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|$)', 1), ''), {_BARE})"
_DECODED = f"regexp_replace(regexp_replace({_WHOLE}, '(?i)<br\\s*/?>', chr(10), 'g'), '(?s)<!--.*?-->|<[^>]*>', '', 'g')"
for _entity, _char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&apos;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
    _DECODED = f"replace({_DECODED}, '{_entity}', {_char})"
_MAIN = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_DECODED}, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n[ \\t]+', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("b19_main_text", f"SELECT page_id, {_MAIN} AS body FROM pages")
def _(v, t):
    return t("pages").select("page_id", normalise.main_text(F.col("html")).alias("body"))


_CAREERS = "(?i)\\b(careers?|jobs?|openings?|positions?|vacanc|hiring|join\\s+(us|our\\s+team)|work\\s+with\\s+us|opportunit)"


_CLEAN = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"
_HEADS = _CLEAN.format("array_to_string(regexp_extract_all(html, '(?is)<h[12]\\b[^>]*>(.*?)</h[12]\\s*>', 1), ' ')")
_BODY_TEXT = _CLEAN.format("CASE WHEN regexp_matches(html, '(?i)<body\\b') THEN regexp_extract(html, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|\\z)', 1) ELSE html END")


@query("b20_page_signals", f"""SELECT *, careers_title OR role_words OR has_jsonld AS looks_ok FROM (SELECT page_id, regexp_matches({_TEXT_OF.format('title')}, '{_CAREERS}') OR regexp_matches({_HEADS}, '{_CAREERS}') AS careers_title,
    regexp_matches(substr({_BODY_TEXT}, 1, 4000), '{normalise._ROLE_WORDS}') AS role_words, false AS redirected_to_root, contains(html, 'ld+json') AND contains(html, 'JobPosting') AS has_jsonld FROM pages)""")  # fmt: skip
def _(v, t):
    return normalise.page_signals(t("pages"))


def _hit(mark):
    quoted = mark.replace("'", "''")
    return f"nullif(regexp_extract(html, '(?i)(?:{quoted})', 0), '')"


_QUOTED = lambda mark: f"chr(34) || substr({_hit(mark)}, 1, 80) || chr(34)"
_EVIDENCE = ", ".join([_QUOTED(x) for x in normalise.STRONG_MARKS] + [f"{_QUOTED(x)} || ' + ' || {_QUOTED(y)}" for x, y in normalise.PAIRED_MARKS])


@query("b21_challenge", f"SELECT page_id, coalesce({_EVIDENCE}) AS evidence FROM pages")
def _(v, t):
    return t("pages").select("page_id", normalise.challenge_evidence(F.col("html")).alias("evidence"))


# Pages built from page_id: each strong mark, each pair, the first halves of pairs alone, and no mark; with the evidence due.
CHALLENGE_PAGES = (
    ("Request unsuccessful. INCAPSULA incident ID: 7-9", '"INCAPSULA incident ID"'), ('<body class="cf-browser-verification">', '"cf-browser-verification"'), ('<script src="/cdn-cgi/challenge-platform/h.js">', '"/cdn-cgi/challenge-platform"'),
    ("Checking your browser before accessing a.example", '"Checking your browser before accessing"'), ("Sorry, you have been blocked", '"Sorry, you have been blocked"'), ("Verifying you are human.", '"Verifying you are human"'),
    ("Please enable JS and disable any ad blocker", '"Please enable JS and disable any ad blocker"'), ("https://token.awswaf.com/captcha.js", '"awswaf"'), ("Generated by cloudfront (CloudFront)", '"Generated by cloudfront"'),
    ("<title>Attention Required! | Cloudflare</title>", '"Attention Required!" + "Cloudflare"'), ("Access Denied: you don’t have permission to access this", '"Access Denied" + "you don’t have permission to access"'), ("akamai, Reference #18.2", '"Reference #" + "akamai"'),
    ("Just a moment... Ray ID 5", '"Just a moment..." + "Ray ID"'), ("Incident ID: 5. Access Denied", '"Incident ID:" + "Access Denied"'), ("Request unsuccessful, support ID 5", '"Request unsuccessful" + "support ID"'),
    ("AWS WAF: captcha", '"AWS WAF" + "captcha"'), ("The request could not be satisfied. CloudFront", '"The request could not be satisfied" + "CloudFront"'),
    ("Just a moment...", None), ("Access Denied", None), ("captcha", None), ("Careers at Acme", None),
)
_DUE = " ".join(f"WHEN {i} THEN '{due}'" for i, (_, due) in enumerate(CHALLENGE_PAGES) if due)


@query("b21_challenge_pages", f"SELECT page_id, CASE page_id % {len(CHALLENGE_PAGES)} {_DUE} END AS evidence FROM pages")
def _(v, t):
    bodies = F.array(*[F.lit(body) for body, _ in CHALLENGE_PAGES])
    built = F.concat(F.lit("<html>\n"), F.get(bodies, (F.col("page_id") % len(CHALLENGE_PAGES)).cast("int")), F.lit("\n</html>"))
    return t("pages").select("page_id", normalise.challenge_evidence(built).alias("evidence"))


# Gate and funnel


@query("e2_parse_gate", """SELECT doc_id, CASE WHEN ok THEN (doc_id % 100) / 100.0 END::DOUBLE AS match_score, CASE WHEN ok AND doc_id % 3 = 0 THEN 'soft' END AS deal_breaker_severity, ok AS valid, CASE WHEN ok THEN CASE doc_id % 4 WHEN 0 THEN 'auto: matchScore ' || printf('%.2f', doc_id % 100 / 100.0) WHEN 1 THEN 'why' ELSE repeat('y', 200) END END AS reason
    FROM (SELECT doc_id, doc_id % 5 > 0 AND doc_id % 7 NOT IN (1, 2, 3) AND NOT (doc_id % 11 = 1 AND doc_id % 3 = 0) AS ok FROM documents)""")  # fmt: skip
def _(v, t):
    n = F.col("doc_id")
    score = F.format_string("%.2f", (n % 100) / 100)
    # A part that is text, or out of bounds, or null fails the response, as does a hit that is no text.
    part = F.element_at(F.array(F.lit(""), F.lit(', "skillsMatch": "0.5"'), F.lit(', "domainFit": 1.5'), F.lit(', "roleTypeMatch": null'), F.lit(', "seniorityFit": 1'), F.lit(', "other": "x"'), F.lit(', "skillsMatch": 0')), (n % 7).cast("int") + 1)
    hit = F.when(n % 3 > 0, F.element_at(F.array(F.lit('"none"'), F.lit("null"), F.lit('""')), (n % 2).cast("int") + 1)).otherwise(F.when(n % 11 == 1, F.lit("true")).otherwise('"travel"'))
    why = F.when(n % 4 == 0, F.lit(', "reason": 7')).when(n % 4 == 1, ', "reason": "why"').otherwise(F.concat(F.lit(', "reason": "", "analysis": "'), F.repeat(F.lit("y"), F.lit(300)), F.lit('"')))
    raw = F.when(n % 5 == 0, "{broken").otherwise(F.concat(F.lit('{"matchScore": '), score, F.lit(', "dealBreakerHit": '), hit, part, why, F.lit("}")))
    rows = t("documents").select(F.lit("p").alias("provider"), n.cast("string").alias("external_id"), F.lit("u").alias("profile_id"), raw.alias("raw"))
    return decide.parse_gate(rows).select(F.col("external_id").cast("long").alias("doc_id"), "match_score", "deal_breaker_severity", F.col("gate_error").isNull().alias("valid"), "reason")


@query("e7_decide", f"""WITH l AS (SELECT p.*, lower(company_slug) || '|' || lower(job_title) || '|' || coalesce(lower(location), '') AS key FROM v_postings p WHERE profile_id = 'p0'),
    prior AS (SELECT DISTINCT lower(c.name) || '|' || lower(job_title) || '|' || coalesce(lower(location), '') AS key, true AS hit FROM v_postings p LEFT JOIN v_companies c ON c.provider = p.provider AND c.slug = p.company_slug WHERE notified_at >= TIMESTAMP '{ORDERS_NOW}' - INTERVAL 180 DAY AND profile_id = 'p0'),
    j AS (SELECT l.*, hit IS NOT NULL AS before, discovered_at < TIMESTAMP '1996-01-01' AS known, least(1.0, CASE WHEN job_title LIKE '%ring%' THEN 0.9 ELSE 0 END + CASE WHEN job_title LIKE '%widget%' THEN 0.7 ELSE 0 END) AS score,
      CASE WHEN location IS NULL THEN true WHEN lower(location) LIKE '%nation_9%' THEN false WHEN regexp_matches(lower(location), '\\b(nation_7|nation_8)\\b') THEN false ELSE lower(location) LIKE '%remote%' OR regexp_matches(lower(location), '\\b(nation_1|nation_2|nation_3)\\b') END AS placed FROM l LEFT JOIN prior USING (key)),
    d AS (SELECT *, CASE WHEN NOT placed THEN 'location' WHEN known AND NOT coalesce(drop_stage IN ('no-jd', 'gate-error'), false) THEN 'known' WHEN before THEN 'prior-duplicate' WHEN regexp_matches(job_title, '^red|gear$') THEN 'title-deny' WHEN score < 0.65 THEN 'silent' ELSE 'yellow' END AS decision FROM j)
    SELECT external_id, CASE WHEN decision = 'yellow' AND row_number() OVER (PARTITION BY key, decision ORDER BY company_slug, external_id, provider) > 1 THEN 'duplicate' ELSE decision END AS decision, CASE WHEN decision IN ('silent', 'yellow') THEN score::DOUBLE END AS match_score FROM d""")  # fmt: skip
def _(v, t):
    p = v("v_postings")
    listing = p.where("profile_id = 'p0'").withColumn("company_name", F.col("company_slug")).withColumn("jd_text", F.concat(F.col("job_title"), F.lit(" work, 3 years")))
    keys = reports.prior_notify_keys(p, v("v_companies"), ts(ORDERS_NOW), "p0")
    return decide.decide(listing, p.where("profile_id = 'p0' AND discovered_at < '1996-01-01'"), keys, PROFILE, decide.keyword_scorer({"ring": 0.9, "widget": 0.7}), ts(ORDERS_NOW)).select("external_id", "decision", "match_score")


# Streams


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def _run_stats(spark, sf_dir):
    root = scratch(spark, "stats")
    counts = feed.stream_stats(_stream(spark, sf_dir), "1 day", by="event_type")

    def store(batch, _):
        batch.write.mode("overwrite").parquet(f"{root}/out")

    # Complete mode gives all windows, also the open ones; the last batch's table is the result.
    counts.writeStream.foreachBatch(store).outputMode("complete").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select(F.col("start").cast("date").alias("day"), "event_type", "n")


QUERIES["i24_stream_stats"] = _run_stats
ORACLES["i24_stream_stats"] = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"


def _run_dedup(spark, sf_dir):
    root = scratch(spark, "stream")
    keyed = _stream(spark, sf_dir).select("ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("notify_key"))
    query_ = feed.stream_dedup(keyed).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("notify_key")


QUERIES["i23_stream_dedup"] = _run_dedup
ORACLES["i23_stream_dedup"] = "SELECT DISTINCT 'u' || CAST(user_id AS VARCHAR) AS notify_key FROM events"

__all__ = ["EVENTS_NOW", "ORACLES", "QUERIES"]


# Urls


@query("b15_resolve_job_urls", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'greenhouse' WHEN page_id % 3 = 1 THEN 'ashby' END AS provider, CASE WHEN page_id % 3 < 2 THEN 'acme' END AS slug_hint, CASE WHEN page_id % 3 < 2 THEN 'j' || CAST(page_id AS VARCHAR) END AS external_id FROM pages")
def _(v, t):
    number = F.concat(F.lit("j"), F.col("page_id").cast("string"))
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), number)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://jobs.ashbyhq.com/acme/"), number)).otherwise(F.col("url"))
    return urls.resolve_job_urls(t("pages").select("page_id", url.alias("url")), "url").select("page_id", "provider", "slug_hint", "external_id")


@query("f8_find_postings", "SELECT external_id, profile_id FROM v_postings WHERE profile_id = 'p0'")
def _(v, t):
    p = v("v_postings")
    asked = p.where("profile_id = 'p0'").select(F.concat("job_url", F.lit("?utm=1")).alias("url")).distinct()
    return urls.find_postings(urls.resolve_job_urls(asked, "url"), p, "p0").select("external_id", F.lit("p0").alias("profile_id"))
