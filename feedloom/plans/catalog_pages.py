"""Registered queries of payload normalisation: boards, pages, listings, vendors."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import detect, html_boards, lifecycle, normalise, vendors
from feedloom.plans.catalog import query

#: Items of a page that is built from the part table.
ITEMS = 20


def _pages(t, item, before, after, glue=""):
    """Pages (provider, slug, page, url, html) of ITEMS parts each; item is an expression over part."""
    page = F.floor(F.col("p_partkey") / ITEMS)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("x")))), lambda r: r["x"]), glue)
    made = t("part").groupBy(page.alias("k")).agg(F.concat(F.lit(before), body, F.lit(after)).alias("html"))
    return made.select(F.lit("p").alias("provider"), F.lit("acme").alias("slug"), F.col("k").cast("int").alias("page"), F.lit("https://a.example.com/careers/list").alias("url"), "html")


@query("b2_normalize_html", """SELECT 'j' || p_partkey AS external_id, p_name AS job_title, 'https://a.example.com/j/' || p_partkey AS job_url, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'India' END AS location FROM part WHERE p_partkey % 7 > 0""")
def _(v, t):
    number = F.col("p_partkey").cast("string")
    title = F.when(F.col("p_partkey") % 7 == 0, "General application").otherwise(F.concat(F.lit("Role: "), "p_name"))
    place = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<span class='loc big'> "), "p_brand", F.lit("<br></span>"))).otherwise("")
    item = F.concat(F.lit("<li data-id='j"), number, F.lit("'><h3>"), title, F.lit("</h3>"), place, F.lit("<a href='/j/"), number, F.lit("'>go</a></li>"))
    pages = _pages(t, item, "<ul class='jobs'>", "</ul><ul><li><h3>no</h3></li></ul>")
    board = html_boards.HtmlBoard("ul.jobs li", "h3", "a@href", ".loc", "India", "^General", r"Role: (.*)", "data-id")
    return html_boards.normalize_html(pages, board).select("external_id", "job_title", "job_url", "location")


@query("b5_script_literal", "SELECT 'k' || p_partkey AS external_id, p_name || ' ]' AS job_title, p_brand AS location FROM part")
def _(v, t):
    job = F.to_json(F.struct(F.concat("p_name", F.lit("  ]")).alias("title"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("id"), F.struct(F.col("p_brand").alias("city")).alias("at")))
    pages = _pages(t, job, "<script>var other = '['; var jobs = [", "]; var x = ']';</script>", ",")
    return normalise.normalize_script_literal(pages, "var jobs", "title", "id", "at.city").select("external_id", "job_title", "location")


def _board(t):
    return t("part").select(F.lit("g").alias("provider"), F.lit("acme").alias("company_slug"), F.col("p_partkey").cast("string").alias("external_id"), F.col("p_name").alias("job_title"), F.when(F.col("p_partkey") % 3 == 0, "own text").otherwise("").alias("jd_text"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("location"), F.lit("https://a.example.com/x").alias("job_url"))


@query("b7_enrich_from_detail", """SELECT p_partkey, CASE WHEN k = 0 THEN p_name ELSE 'T ' || p_name END AS job_title, CASE WHEN k = 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'own text' ELSE '' END ELSE 'long ' || p_type END AS jd_text,
    CASE WHEN k = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN p_brand END WHEN k = 2 THEN 'Remote - India' WHEN p_partkey % 2 = 0 THEN 'Pune, India; Goa' ELSE 'Pune, India; Goa' END AS location, k = 2 AS is_remote FROM (SELECT *, p_partkey % 5 AS k5, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 5 = 1 THEN 2 ELSE 1 END AS k FROM part)""")  # fmt: skip
def _(v, t):
    k = F.col("p_partkey") % 5
    place = '{"@type": "Place", "address": {"addressLocality": "Pune", "addressCountry": {"name": "India"}}}, {"address": {"addressLocality": "Goa"}}'
    where = F.when(k == 1, '"jobLocationType": "TELECOMMUTE", "applicantLocationRequirements": {"name": "India"}').otherwise(f'"jobLocation": [{place}]')
    node = F.concat(F.lit('{"@graph": [{"@type": "WebPage"}, {"@type": ["JobPosting"], "title": "T '), "p_name", F.lit('", "description": "long '), "p_type", F.lit('", '), where, F.lit("}]}"))
    html = F.when(k > 0, F.concat(F.lit("<script type='application/ld+json'>"), node, F.lit("</script>"))).otherwise("<p>gone</p>")
    url = F.concat(F.lit("https://a.example.com/"), F.col("p_partkey").cast("string"))
    listing = _board(t).withColumn("job_url", F.concat(F.lit("https://a.example.com/"), "external_id")).withColumn("is_remote", F.lit(False))
    found = normalise.enrich_from_detail(listing, t("part").select(url.alias("url"), html.alias("html")))
    return found.select(F.col("external_id").cast("long").alias("p_partkey"), "job_title", "jd_text", "location", "is_remote")


@query("b8_attach_jd", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'own text' WHEN p_partkey % 4 > 0 THEN 'detail ' || p_type ELSE '' END AS jd_text, CASE WHEN p_partkey % 4 = 1 THEN 'late' WHEN p_partkey % 2 = 0 THEN p_brand END AS location FROM part""")
def _(v, t):
    detail = t("part").where("p_partkey % 4 > 0").select(F.lit("g").alias("provider"), F.lit("acme").alias("company_slug"), F.col("p_partkey").cast("string").alias("external_id"), F.concat(F.lit("detail "), "p_type").alias("jd_text"), F.when(F.col("p_partkey") % 4 == 1, "late").otherwise(" ").alias("location"), F.lit(None).cast("string").alias("job_url"))
    # A detail that was fetched twice counts once.
    return normalise.attach_jd(_board(t), detail.union(detail)).select(F.col("external_id").cast("long").alias("p_partkey"), F.coalesce("jd_text", F.lit("")).alias("jd_text"), "location")


@query("b9_jd_parts", "SELECT p_partkey, concat_ws(chr(10) || chr(10), p_name, CASE WHEN p_partkey % 2 > 0 THEN p_type END, CASE WHEN p_partkey % 3 > 0 THEN p_brand END) AS jd FROM part")
def _(v, t):
    return t("part").select("p_partkey", normalise.jd_parts(F.concat("p_name", F.lit(" ")), F.when(F.col("p_partkey") % 2 > 0, F.col("p_type")).otherwise("  "), F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand"))).alias("jd"))


_RANKED = "SELECT *, row_number() OVER (PARTITION BY company_slug, external_id ORDER BY page, pos) AS first, row_number() OVER (PARTITION BY company_slug, external_id ORDER BY page DESC, pos DESC) AS last FROM v_listing"


@query("b10_assemble_pages", f"SELECT company_slug, external_id, page, pos FROM ({_RANKED}) WHERE first = 1")
def _(v, t):
    return normalise.assemble_pages(v("v_listing"), "external_id").select("company_slug", "external_id", "page", "pos")


@query("b12_merge_partitions", f"SELECT company_slug, external_id, page, pos FROM ({_RANKED}) WHERE last = 1")
def _(v, t):
    return normalise.merge_partitions(v("v_listing")).select("company_slug", "external_id", "page", "pos")


@query("b11_audit_pages", """WITH p AS (SELECT company_slug, page, list_sort(list(external_id)) AS ids, CASE WHEN page > 2 THEN CAST(split_part(company_slug, '-', 2) AS BIGINT) % 60 END AS total FROM v_listing GROUP BY 1, 2),
    pages AS (SELECT * FROM p UNION ALL SELECT company_slug, 8, ids, NULL FROM p WHERE page = 7 AND CAST(split_part(company_slug, '-', 2) AS BIGINT) % 3 = 0),
    marked AS (SELECT *, coalesce(ids = lag(ids) OVER (PARTITION BY company_slug ORDER BY page), false) AS repeat FROM pages),
    boards AS (SELECT company_slug AS slug, len(list_distinct(flatten(list(ids)))) AS collected, max(total) AS total, bool_or(repeat) AS stalled FROM marked GROUP BY 1)
    SELECT slug, CAST(collected AS INT) AS collected, CASE WHEN collected < total THEN CASE WHEN stalled THEN 'stalled-short' ELSE 'short' END WHEN stalled AND total IS NULL THEN 'unverifiable' WHEN stalled THEN 're-served' ELSE 'complete' END AS message,
    CASE WHEN collected < total THEN 'warn' ELSE 'info' END AS level FROM boards""")  # fmt: skip
def _(v, t):
    number = F.split_part("company_slug", F.lit("-"), F.lit(2)).cast("long")
    # A page of a board is one row with its ids, as a crawl gives it.
    pages = v("v_listing").groupBy("provider", "company_slug", "page").agg(F.collect_list("external_id").alias("ids")).withColumn("reported_total", F.when(F.col("page") > 2, number % 60))
    again = pages.where((F.col("page") == 7) & (number % 3 == 0)).withColumn("page", F.lit(8)).withColumn("reported_total", F.lit(None).cast("long"))
    return normalise.audit_pages(pages.unionByName(again).withColumnRenamed("company_slug", "slug")).select("slug", "collected", "message", "level")


@query("b13_gap_fill", """WITH l AS (SELECT DISTINCT company_slug, external_id FROM v_listing WHERE CAST(external_id AS INT) % 4 > 0 AND CAST(split_part(company_slug, '-', 2) AS BIGINT) % 3 < 2), s AS (SELECT DISTINCT company_slug, CASE WHEN CAST(split_part(company_slug, '-', 2) AS BIGINT) % 3 = 1 THEN 'z' ELSE '' END || external_id AS external_id FROM v_listing),
    ok AS (SELECT s.company_slug FROM s LEFT JOIN l ON l.company_slug = s.company_slug AND l.external_id = s.external_id GROUP BY 1 HAVING count(l.external_id) > 0 OR s.company_slug NOT IN (SELECT company_slug FROM l))
    SELECT company_slug, external_id FROM l UNION SELECT company_slug, external_id FROM s WHERE company_slug IN (SELECT company_slug FROM ok)""")  # fmt: skip
def _(v, t):
    number = F.split_part("company_slug", F.lit("-"), F.lit(2)).cast("long")
    ids = v("v_listing").select("provider", "company_slug", "external_id").distinct()
    listing = ids.where((F.col("external_id").cast("int") % 4 > 0) & (number % 3 < 2))
    sitemap = ids.withColumn("external_id", F.when(number % 3 == 1, F.concat(F.lit("z"), "external_id")).otherwise(F.col("external_id")))
    return normalise.gap_fill(listing, sitemap).select("company_slug", "external_id")


_LINKS = (
    ("greenhouse", "https:\\/\\/boards.greenhouse.io\\/Acme{}\\/jobs", "https://boards.greenhouse.io/Acme{}", "Acme{}"),
    ("lever", "https:&#x2F;&#x2F;jobs.lever.co&#47;acme{}&amp;x", "https://jobs.lever.co/acme{}", "acme{}"),
    ("workday", "https://t{}.wd1.myworkdayjobs.com/en-US/Site{}/job", "https://t{}.wd1.myworkdayjobs.com/Site{}", "t{}/Site{}"),
    ("freshteam", "http://c{}.freshteam.com/jobs https://www.freshteam.com", "https://c{}.freshteam.com/jobs", "c{}"),
    ("zohorecruit", "https://z{}.zohorecruit.in/jobs/Join{}/1", "https://z{}.zohorecruit.in/jobs/Join{}", "z{}"),
    ("consider", "fetch('/api-boards/search-jobs')", None, None),
    ("skima", "https://jobs{}.acme.com.skima.ai/x https://api.skima.ai", "https://jobs{}.acme.com/", "jobs{}.acme.com"),
    ("icims", "https://careers-i{}.icims.com/jobs/1", "https://careers-i{}.icims.com/jobs", "i{}"),
)
_CASE = lambda column: " ".join(f"WHEN {i} THEN " + ("NULL" if x[column] is None else "'" + x[column].replace("{}", "' || page_id || '") + "'") for i, x in enumerate(_LINKS))


@query("b14_detect_vendors", f"""SELECT page_id, CASE k {_CASE(0)} END AS provider, CASE WHEN k = 5 THEN 'https://' || host || '/api-boards/search-jobs' ELSE CASE k {_CASE(2)} END END AS url, CASE WHEN k = 5 THEN split_part(host, '.', 1) ELSE CASE k {_CASE(3)} END END AS slug, k NOT IN (5, 7) AS has_adapter
    FROM (SELECT page_id, page_id % {len(_LINKS)} AS k, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)""")  # fmt: skip
def _(v, t):
    number = F.col("page_id").cast("string")
    body = F.coalesce(*[F.when(F.col("page_id") % len(_LINKS) == i, F.replace(F.lit(x[1]), F.lit("{}"), number)) for i, x in enumerate(_LINKS)])
    return detect.detect_vendors(t("pages").select("page_id", "url", F.concat("html", F.lit("<a href='"), body, F.lit("'>")).alias("html")))


@query("b14_detect_in_pages", "SELECT page_id, 'greenhouse' AS provider FROM pages WHERE regexp_matches(html, 'https?://boards\\.greenhouse\\.io/[a-z0-9]')")
def _(v, t):
    return detect.detect_vendors(t("pages")).select("page_id", "provider")


_ANCHORS = """WITH a AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS own, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']+)["''][^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)) AS inner_html FROM {pages}),
    links AS (SELECT page_id, own, origin || regexp_replace(href, '#.*$', '') AS link, trim(regexp_replace(regexp_replace(inner_html, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS text FROM a WHERE href LIKE '/%')"""
# Role words put behind the names in the pages' menus, so that some are links to jobs.
_ROLED = "(SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN replace(html, '</a>', ' Engineer</a>') ELSE replace(html, 'href=\"/', 'href=\"/jobs/') END AS html FROM pages)"


def _roled(t):
    html = F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit("</a>"), F.lit(" Engineer</a>"))).otherwise(F.replace("html", F.lit('href="/'), F.lit('href="/jobs/')))
    return t("pages").select("page_id", "url", html.alias("html"))


@query("b16_candidate_links", f"""{_ANCHORS.format(pages=_ROLED)} SELECT page_id, link, first(text) AS text FROM (SELECT DISTINCT ON (page_id, link) page_id, link, text FROM links WHERE length(text) BETWEEN 3 AND 200 AND (text LIKE '% Engineer' OR link LIKE '%/jobs/%')) GROUP BY 1, 2""")
def _(v, t):
    return normalise.extract_links(_roled(t)).select("page_id", "link", "text")


@query("b17_best_openings_link", "SELECT page_id, 'https://' || host || CASE WHEN page_id % 3 = 0 THEN '/about' ELSE '/careers/open-positions/?x=1' END AS link, CASE WHEN page_id % 3 = 0 THEN 3 ELSE 2 END AS score FROM (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages) WHERE page_id % 3 < 2")
def _(v, t):
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    link = lambda path, says: F.concat(F.lit("<a href='https://"), host, F.lit(path + "'>" + says + "</a>"))
    more = F.when(F.col("page_id") % 3 == 0, F.concat(link("/news", "Read it"), link("/about", "Join us now"), link("/positions/", "here"))).when(F.col("page_id") % 3 == 1, link("/careers/open-positions/?x=1", "here")).otherwise(link("/company", "About the firm"))
    return normalise.pick_openings_link(t("pages").select("page_id", "url", F.concat("html", more).alias("html"))).select("page_id", "link", "score")


_TITLE = "trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{0}\\b[^>]*>(.*?)</{0}\\s*>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"


@query("b18_title_hints", f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN {_TITLE.format('h1')} ELSE 'Data Lead' END AS hint FROM pages WHERE length({_TITLE.format('h1')}) BETWEEN 3 AND 200 OR page_id % 2 = 1")
def _(v, t):
    # Odd pages lose their heading and have a title with the role in brackets.
    html = F.when(F.col("page_id") % 2 == 1, F.regexp_replace(F.regexp_replace("html", r"(?is)<h1\b.*?</h1>", ""), r"(?is)<title>.*?</title>", "<title>Acme | careers (Data Lead)</title>")).otherwise(F.col("html"))
    heading = F.length(normalise._element(F.col("html"), "h1")).between(3, 200)
    return t("pages").where(heading | (F.col("page_id") % 2 == 1)).select("page_id", normalise.title_hint(html).alias("hint"))


@query("b20_signals", """SELECT page_id, page_id % 6 IN (0, 4) AS careers_title, page_id % 6 = 1 AS role_words, page_id % 5 = 0 AS redirected_to_root, page_id % 6 = 2 AS has_jsonld, page_id % 6 IN (0, 1, 2, 4) AS looks_ok FROM pages""")
def _(v, t):
    k = F.col("page_id") % 6
    html = (
        F.when(k == 0, "<html><title>Open positions at Acme</title><body><p>text</p></body></html>").when(k == 1, "<html><title>Acme</title><body><p>We seek an Analyst</p></body></html>")
        .when(k == 2, '<html><title>Acme</title><script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "X"}]}</script><body>x</body></html>').when(k == 3, '<html><title>Acme</title><script type="application/ld+json">{"@type": "JobPosting"}</script><body>JobPosting</body></html>')
        .when(k == 4, "<html><title>Acme</title><body><h1>Hello</h1><h2>About</h2><h2>Join  our\n<b>team</b></h2></body></html>").otherwise("<html><title>Acme</title><body><nav>Jobs</nav><p>text</p></body></html>")
    )
    url = F.when(F.col("page_id") % 5 == 0, "https://a.example.com/").otherwise("https://a.example.com/jobs")
    return normalise.page_signals(t("pages").select("page_id", url.alias("url"), F.lit("https://a.example.com/careers/").alias("requested_url"), html.alias("html")))


@query("b22_shortlist", "SELECT p_partkey, 'u' || p_partkey AS link, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'anchor ' || p_brand END AS title FROM part WHERE p_partkey % 3 > 0")
def _(v, t):
    link = F.concat(F.lit("u"), F.col("p_partkey").cast("string"))
    picks = t("part").select(F.col("p_partkey").alias("page_id"), link.alias("link"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(" ").alias("title"), F.lit(0).alias("pos"))
    candidates = t("part").where("p_partkey % 3 > 0").select(F.col("p_partkey").alias("page_id"), link.alias("link"), F.concat(F.lit("anchor "), "p_brand").alias("text"), F.lit(0).alias("pos"))
    twice = candidates.union(candidates.withColumn("pos", F.lit(1)).withColumn("text", F.lit("later")))
    return normalise.reconcile_shortlist(picks.union(picks.withColumn("title", F.lit("again")).withColumn("pos", F.lit(1))), twice).select(F.col("page_id").alias("p_partkey"), "link", "title")


@query("b23_text_jobs", "SELECT p_partkey, CASE WHEN p_partkey % 8 = 1 THEN 'About us' ELSE p_name END AS title, CASE p_partkey % 7 WHEN 0 THEN p_brand WHEN 1 THEN 'N/A' END AS location FROM part WHERE p_partkey % 8 > 0 AND p_partkey % 8 < 5")
def _(v, t):
    pick = lambda n, *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (F.col("p_partkey") % n).cast("int") + 1)
    name = F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" \n ")), F.lit(" "))
    title = pick(8, "Apply for this Job", "About us", name, name, name, "Page 12", "ab", "view  role")
    place = pick(7, F.col("p_brand"), "N/A", "", "Full-time", "Posted 3 days ago", "14 days ago", "On-site")
    jobs = t("part").select(F.col("p_partkey").alias("page_id"), title.alias("title"), place.alias("location"), F.lit(0).alias("pos"))
    again = jobs.withColumn("title", F.upper("title")).withColumn("pos", F.lit(1))
    return normalise.clean_text_jobs(jobs.union(again)).select(F.col("page_id").alias("p_partkey"), "title", "location")


@query("b24_foreign_links", "SELECT p_partkey FROM part WHERE NOT (p_partkey % 2 = 0 AND p_partkey % 6 IN (2, 4))")
def _(v, t):
    links = ("https://www.ycombinator.com/companies/acme/jobs/1", "https://acme.example.com/jobs/1", "https://ycombinator.com/companies/other/jobs/1", "https://news.ycombinator.com/companies/other", "https://www.ycombinator.com/companies/other", "https://www.ycombinator.com/jobs/other")
    link = F.element_at(F.array(*map(F.lit, links)), (F.col("p_partkey") % 6).cast("int") + 1)
    # An ordinary company's own page keeps all of its links.
    own = F.when(F.col("p_partkey") % 2 == 0, "https://www.ycombinator.com/companies/acme").otherwise("https://acme.example.com/careers")
    return normalise.drop_foreign_links(t("part").select("p_partkey", own.alias("url"), link.alias("link"))).select("p_partkey")


@query("b25_external_ids", """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN '/jobs/' || p_partkey || '?id=7&ref=q' WHEN 1 THEN '/x/' || p_partkey WHEN 2 THEN '/list?job=' || p_partkey WHEN 3 THEN '/apply-form?source=a&src=b&n=' || p_partkey WHEN 4 THEN '/job/' || p_partkey WHEN 5 THEN '/https://b.example.com/y/' || p_partkey
    ELSE replace(p_name, ' ', '-') END AS external_id FROM part""")  # fmt: skip
def _(v, t):
    number = F.col("p_partkey").cast("string")
    urls = F.array(
        F.concat(F.lit("https://a.example.com/jobs/"), number, F.lit("?utm_source=z&id=7&trk=1&ref=q&REFID=k&gclid=2#top")), F.concat(F.lit("https://a.example.com/jobshttps://b.example.com/x/"), number, F.lit("/")), F.concat(F.lit("https://a.example.com/list?job="), number),
        F.concat(F.lit("https://a.example.com/apply-form?source=a&src=b&n="), number), F.concat(F.lit("https://a.example.com/job/"), number, F.lit("/?trackingId=1")), F.concat(F.lit("https://a.example.com/https://b.example.com/y/"), number),
        F.lit("mailto:x@example.com"), F.lit("https://a.example.com/list/?utm_medium=x#a"), F.lit("https://a.example.com"), F.concat(F.lit("https://www.forms.gle/"), number), F.concat(F.lit("https://acme.typeform.com/to/"), number), F.concat(F.lit("https://airtable.com/app12/shr"), number),
    )
    url = F.element_at(urls, (F.col("p_partkey") % 12).cast("int") + 1)
    return t("part").select("p_partkey", normalise.board_external_id(url, F.col("p_name"), F.lit("https://a.example.com/list")).alias("external_id"))


@query("b26_locations", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'Pune, India' WHEN 1 THEN '3 Locations, India' WHEN 2 THEN 'Goa, INDIA' WHEN 3 THEN p_brand || ', India' WHEN 4 THEN 'Indiana, India' WHEN 6 THEN p_brand END AS place FROM part""")
def _(v, t):
    k = F.col("p_partkey") % 8
    said = F.element_at(F.array(F.lit("Pune"), F.lit("3 Locations"), F.lit("Goa, INDIA"), F.lit(None), F.lit("Indiana"), F.lit("12 locations"), F.lit(None), F.lit(None)), k.cast("int") + 1)
    bullets = F.when(k == 7, F.array(F.lit("R_99881"), F.lit("Permanent"), F.lit("40 hrs/week"), F.lit(" "))).otherwise(F.array(F.lit("REQ-12345"), F.lit("own-7"), F.lit("Full time"), F.lit("37.5 hrs per week"), F.concat(F.lit(" "), "p_brand")))
    country = F.when(k < 5, "India")
    return t("part").select("p_partkey", normalise.fix_location(said, country, bullets, F.array(F.lit("own-7"))).alias("place"))


# Vendors


def _vendor_payloads(t):
    """Payloads of three vendors and one that nobody knows, ITEMS jobs a page."""
    number = F.col("p_partkey").cast("string")
    jobs = {
        "greenhouse": F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.concat(F.lit("https://g.example.com/"), number).alias("absolute_url"), F.struct(F.col("p_brand").alias("name")).alias("location"), F.lit("&lt;p&gt;Fine &amp;amp; good&lt;/p&gt;").alias("content"), F.lit("2024-01-05T00:00:00Z").alias("updated_at")),
        "lever": F.struct(number.alias("id"), F.col("p_name").alias("text"), F.concat(F.lit("https://l.example.com/"), number).alias("hostedUrl"), F.lit(1704412800000).alias("createdAt"), F.lit("intro").alias("descriptionPlain"), F.array(F.struct(F.lit("You").alias("text"), F.lit("<li>do</li>").alias("content"))).alias("lists"), F.struct(F.col("p_brand").alias("location")).alias("categories")),
        "keka": F.struct(number.alias("id"), F.col("p_name").alias("title"), F.lit("<b>Fine</b> & good").alias("description"), F.array(F.struct(F.col("p_brand").alias("city"), F.lit("").alias("state"), F.lit("India").alias("countryName"))).alias("jobLocations"), F.lit("2024-01-05").alias("publishedOn")),
    }
    page = F.floor(F.col("p_partkey") / ITEMS).cast("int")
    made = t("part").groupBy(page.alias("page")).agg(*[F.collect_list(x).alias(k) for k, x in jobs.items()])
    body = F.create_map(F.lit("greenhouse"), F.to_json(F.struct(F.col("greenhouse").alias("jobs"))), F.lit("lever"), F.to_json("lever"), F.lit("keka"), F.to_json("keka"), F.lit("mystery"), F.lit("{}"))
    return made.select(F.explode(body).alias("provider", "body"), "page").withColumn("slug", F.lit("acme"))


@query("j1_normalize_all", """SELECT provider, CAST(p_partkey AS VARCHAR) AS external_id, p_name AS job_title, CASE provider WHEN 'greenhouse' THEN p_brand WHEN 'lever' THEN p_brand ELSE p_brand || ', India' END AS location, TIMESTAMP '2024-01-05' AS posted_at,
    CASE provider WHEN 'lever' THEN 'intro' || chr(10) || chr(10) || 'You' || chr(10) || 'do' ELSE 'Fine & good' END AS jd_text FROM part, (VALUES ('greenhouse'), ('lever'), ('keka')) AS x(provider)""")  # fmt: skip
def _(v, t):
    found = normalise.normalize_all(_vendor_payloads(t), {k: vendors.SPECS[k] for k in ("greenhouse", "lever", "keka")})[0]
    return found.select("provider", "external_id", "job_title", "location", "posted_at", "jd_text")


@query("j1_unknown_boards", "SELECT 'mystery' AS provider, 'acme' AS slug, 'config: unknown provider' AS error")
def _(v, t):
    return normalise.normalize_all(_vendor_payloads(t), vendors.SPECS)[1]


@query("j2_json_spec", "SELECT 'w' || p_partkey AS external_id, upper(p_name) AS job_title, p_retailprice > 1000 AS is_remote FROM part WHERE p_size > 10")
def _(v, t):
    spec = normalise.JsonSpec("data struct<rows:array<struct<no:long,name:string,price:double,size:int>>>", "data.rows", {"external_id": "concat('w', item.no)", "job_title": "upper(item.name)", "is_remote": "item.price > 1000"}, "item.size > 10")
    row = F.struct(F.col("p_partkey").alias("no"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"))
    page = F.floor(F.col("p_partkey") / ITEMS).cast("int")
    raw = t("part").groupBy(page.alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(row).alias("rows")).alias("data"))).alias("body")).select(F.lit("w").alias("provider"), F.lit("acme").alias("slug"), "page", "body")
    return normalise.normalize_json(raw, spec).select("external_id", "job_title", "is_remote")


@query("h13_union_latest", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'manual' WHEN s_suppkey % 2 = 0 THEN 'raw' ELSE 'gap' END AS origin FROM supplier")
def _(v, t):
    rows = lambda where, name: t("supplier").where(where).select("s_suppkey", F.lit(name).alias("origin"))
    return lifecycle.union_latest([rows("s_suppkey >= 0", "gap"), rows("s_suppkey % 2 = 0", "raw"), rows("s_suppkey % 3 = 0", "manual")], ["s_suppkey"])


@query("h14_subtract_keys", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(v, t):
    seen = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return lifecycle.subtract_keys(t("orders").select("o_orderkey", "o_custkey"), seen, ["o_custkey"])
