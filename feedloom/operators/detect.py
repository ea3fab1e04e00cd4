"""Which vendor's board a careers page leads to, by the urls it holds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Vendor:
    """A vendor's url shape.

    pattern: of the whole url; its first group is the company, unless `company` names another source of it: `label` (first label
    of the host). url: the board's canonical url, with {host} and {slug}. shared: companies that are the vendor's own hosts.
    """

    provider: str
    pattern: str
    url: str
    company: str = "group"
    shared: tuple[str, ...] = ()
    adapter: bool = True


# Url shapes of vendors, in the order in which they are tried; every shape counts, case does not.
VENDORS = (
    Vendor("greenhouse", r"https?://(?:boards|jobs|job-boards|boards\.[a-z]+)\.greenhouse\.io/([a-z0-9._-]+)", "https://boards.greenhouse.io/{slug}"),
    Vendor("lever", r"https?://jobs\.lever\.co/([a-z0-9._-]+)", "https://jobs.lever.co/{slug}"),
    Vendor("ashby", r"https?://jobs\.ashbyhq\.com/([a-z0-9._-]+)", "https://jobs.ashbyhq.com/{slug}"),
    Vendor("workday", r"https?://[a-z0-9-]+\.[a-z0-9-]+\.myworkdayjobs\.com(?:/(?:en|en-[A-Z]{2}|fr|de|es|ja|zh)(?:-[A-Z]{2})?)?/([A-Za-z0-9_-]+)", "https://{host}/{slug}"),
    Vendor("smartrecruiters", r"https?://(?:careers|jobs|www)\.smartrecruiters\.com/([a-z0-9._-]+)", "https://careers.smartrecruiters.com/{slug}"),
    Vendor("recruitee", r"https?://[a-z0-9-]+\.recruitee\.com\b", "https://{host}", "label"),
    Vendor("pinpoint", r"https?://[a-z0-9-]+\.pinpointhq\.com\b", "https://{host}", "label"),
    Vendor("ainterviews", r"https?://(?:www\.)?ainterviews\.com/(?:api/)?job_board/([a-z0-9._-]+)", "https://ainterviews.com/job_board/{slug}/"),
    Vendor("freshteam", r"https?://[a-z0-9-]+\.freshteam\.com\b", "https://{host}/jobs", "label", ("www",)),
    Vendor("trakstar", r"https?://[a-z0-9-]+\.hire\.trakstar\.com\b", "https://{host}", "label", ("www",)),
    Vendor("mynexthire", r"https?://[a-z0-9-]+\.mynexthire\.com\b", "https://{host}/", "label", ("www",)),
    Vendor("gem", r"https?://jobs\.gem\.com/([a-z0-9._-]+)", "https://jobs.gem.com/{slug}"),
    Vendor("dover", r"https?://app\.dover\.com/jobs/([a-z0-9._-]+)", "https://app.dover.com/jobs/{slug}"),
    Vendor("unberry", r"https?://app\.unberry\.com/careers/([a-f0-9]+)", "https://app.unberry.com/careers/{slug}"),
    Vendor("ycombinator", r"https?://(?:www\.)?ycombinator\.com/companies/([a-z0-9-]+)(?:/jobs)?\b", "https://www.ycombinator.com/companies/{slug}/jobs"),
    Vendor("gohire", r"https?://jobs\.gohire\.io/([a-z0-9._-]+)", "https://jobs.gohire.io/{slug}/"),
    Vendor("jobsoid", r"https?://[a-z0-9-]+\.jobsoid\.com\b", "https://{host}/", "label", ("www",)),
    Vendor("jobvite", r"https?://jobs\.jobvite\.com/([a-z0-9._-]+)", "https://jobs.jobvite.com/{slug}", shared=("search", "job", "api")),
    Vendor("jazzhr", r"https?://[a-z0-9-]+\.applytojob\.com\b", "https://{host}", "label", ("www",)),
    Vendor("webbtree", r"https?://app\.webbtree\.com/company/([a-z0-9._-]+)", "https://app.webbtree.com/company/{slug}/jobs"),
    Vendor("talentrecruit", r"https?://[a-z0-9-]+\.talentrecruit\.com\b", "https://{host}/career-page", "label", ("app", "appcareer", "api", "www")),
    Vendor("ripplehire", r"https?://[a-z0-9-]+\.ripplehire\.com\b", "https://{host}", "label"),
    Vendor("sensehq", r"https?://[a-z0-9-]+\.sensehq\.com\b", "https://{host}/careers", "label", ("www",)),
    Vendor("breezyhr", r"https?://[a-z0-9-]+\.breezy\.hr\b", "https://{host}", "label", ("www",)),
    Vendor("icims", r"https?://(?:careers-)?([a-z0-9-]+)\.icims\.com/jobs\b", "https://{host}/jobs", adapter=False),
    Vendor("successfactors-ui5", r"https?://career\d*\.successfactors\.(?:com|eu)/career\?company=([A-Za-z0-9_-]+)", "https://{host}/career?company={slug}", adapter=False),
    Vendor("consider", r"https?://[a-z0-9.-]+/api-boards/search-jobs\b", "https://{host}/api-boards/search-jobs", "label", adapter=False),
    Vendor("talentzq", r"https?://[a-z0-9-]+\.talentzq\.io\b", "https://{host}", "label", ("www",), adapter=False),
    Vendor("phenom", r"https?://[a-z0-9-]+\.phenompeople\.com\b", "https://{host}", "label"),
    Vendor("eightfold", r"https?://[a-z0-9-]+\.eightfold\.ai\b", "https://{host}", "label", ("app", "static", "www", "vs-errors", "fonts", "cdn")),
    Vendor("avature", r"https?://[a-z0-9-]+\.avature\.net\b", "https://{host}", "label"),
    Vendor("workable", r"https?://apply\.workable\.com/([a-z0-9._-]+)", "https://apply.workable.com/{slug}"),
    Vendor("personio", r"https?://[a-z0-9-]+\.jobs\.personio\.(?:com|de)\b", "https://{host}", "label", adapter=False),
    Vendor("teamtailor", r"https?://[a-z0-9-]+\.teamtailor\.com\b", "https://{host}", "label"),
    Vendor("bamboohr", r"https?://[a-z0-9-]+\.bamboohr\.com/careers\b", "https://{host}/careers", "label"),
    Vendor("kula", r"https?://careers\.kula\.ai/([a-z0-9_-]+)", "https://careers.kula.ai/{slug}", shared=("api",)),
    Vendor("goodfit", r"https?://app\.goodfit\.so/jobs/([a-z0-9_-]+)", "https://app.goodfit.so/jobs/{slug}"),
    Vendor("superworks", r"https?://[a-z0-9-]+\.superworks\.com/job/listing", "https://{host}/job/listing", "label", ("www", "jobs")),
    Vendor("recruiterflow", r"https?://recruiterflow\.com/([a-z0-9_-]+)/jobs\b", "https://recruiterflow.com/{slug}/jobs", shared=("api", "static")),
    Vendor("oracle", r"https?://[a-z0-9-]+\.fa\.[a-z0-9-]+\.oraclecloud\.com\b", "https://{host}", "label"),
    Vendor("keka", r"https?://[a-z0-9-]+\.keka\.com/careers\b", "https://{host}/careers/", "label"),
    Vendor("darwinbox", r"https?://[a-z0-9-]+\.darwinbox\.(?:in|com)\b", "https://{host}", "label"),
    Vendor("greythr", r"https?://[a-z0-9-]+\.greythr\.com\b", "https://{host}/hire/jobs/", "label", ("www",)),
    Vendor("zohorecruit", r"https?://[a-z0-9-]+\.zohorecruit\.(?:com|in)\b(?:/jobs/([^/\s\"'<>?#]+))?", "https://{host}/jobs/{group}", "label", ("www",)),
    Vendor("peoplestrong", r"https?://[a-z0-9-]+\.peoplestrong\.com\b", "https://{host}", "label", ("www",)),
    Vendor("skima", r"https?://([a-z0-9-]+(?:\.[a-z0-9-]+)+)\.skima\.ai\b", "https://{slug}/"),
)
#: What a zohorecruit board's page is called where the url does not say.
_DEFAULT_PAGE = "Careers"


def _unescaped(html: Column) -> Column:
    for escaped, plain in (("\\/", "/"), ("&amp;", "&"), ("&quot;", '"'), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#47;", "/")):
        html = F.replace(html, F.lit(escaped), F.lit(plain))
    return html


def _found(text: Column, vendor: Vendor) -> Column:
    """Array of (provider, url, slug, has_adapter) of a vendor's urls in a text."""
    pattern = "(?i)" + vendor.pattern

    def one(match: Column) -> Column:
        host = F.lower(F.regexp_extract(match, r"^[a-zA-Z]+://([^/?#]+)", 1))
        group = F.regexp_extract(match, pattern, 1) if "(" in vendor.pattern.replace("(?", "") else F.lit("")
        slug = F.split_part(host, F.lit("."), F.lit(1)) if vendor.company == "label" else group
        page = F.when(group != "", group).otherwise(_DEFAULT_PAGE)
        url = F.lit(vendor.url)
        for place, value in (("{host}", host), ("{slug}", slug), ("{group}", page)):
            url = F.replace(url, F.lit(place), value) if place in vendor.url else url
        named = F.concat(F.split_part(host, F.lit("."), F.lit(1)), F.lit("/"), slug) if vendor.provider == "workday" else slug
        return F.struct(F.lit(vendor.provider).alias("provider"), url.alias("url"), named.alias("slug"), F.lit(vendor.adapter).alias("has_adapter"))

    rows = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), one)
    return F.filter(rows, lambda x: (x["slug"] != "") & ~x["slug"].isin(*vendor.shared)) if vendor.shared else F.filter(rows, lambda x: x["slug"] != "")


def detect_vendors(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, provider, url, slug, has_adapter): each board that a page's html or its own url names, once.

    A relative call of a shared widget belongs to the page's own host.
    """
    own = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(https?://[^/?#]+)", 1)
    body = F.regexp_replace(_unescaped(F.coalesce(F.col(html), F.lit(""))), r"(?<![a-zA-Z0-9.-])/api-boards/search-jobs\b", F.concat(own, F.lit("/api-boards/search-jobs")))
    text = pages.select(key, F.concat(body, F.lit(" "), F.coalesce(F.col(url), F.lit(""))).alias("text"))
    # Most pages name no vendor at all: one pass tells.
    domains = r"(?i)greenhouse\.io|lever\.co|ashbyhq|myworkdayjobs|smartrecruiters|recruitee|pinpointhq|ainterviews|freshteam|trakstar|mynexthire|gem\.com|dover\.com|unberry|ycombinator|gohire|jobsoid|jobvite|applytojob|webbtree|talentrecruit|ripplehire|sensehq|breezy\.hr|icims|successfactors|api-boards|talentzq|phenompeople|eightfold|avature|workable|personio|teamtailor|bamboohr|kula\.ai|goodfit|superworks|recruiterflow|oraclecloud|keka|darwinbox|greythr|zohorecruit|peoplestrong|skima"
    named = text.where(F.col("text").rlike(domains))
    rows = named.select(key, F.explode(F.concat(*[_found(F.col("text"), v) for v in VENDORS])).alias("x")).select(key, "x.*")
    return rows.dropDuplicates([key, "provider", "url"])
