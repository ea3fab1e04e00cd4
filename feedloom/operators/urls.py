"""Job urls: which board and posting they name, and lookups by url, as equi-joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


@dataclass(frozen=True)
class UrlRule:
    """host: pattern of the lower-cased host; path: pattern of path and query whose groups hold slug and id.

    slug: the group of the slug, or `label` (first label of the host), `host`, or None; id: the group of the id, 0 for none.
    """

    provider: str | None
    host: str
    path: str
    slug: int | str | None
    id: int
    hint: str | None = None


# Url shapes of job boards, first that fits decides.
RULES = (
    UrlRule("greenhouse", r"^(job-)?boards\.greenhouse\.io$", r"^(?:/[^/?#]+)*?/([^/?#]+)/jobs/([^/?#]+)", 1, 2),
    UrlRule("lever", r"^jobs\.lever\.co$", rf"^/([^/?#]+)/({_UUID})(?:[/?#]|$)", 1, 2),
    UrlRule("ashby", r"^jobs\.ashbyhq\.com$", r"^/([^/?#]+)/([^/?#]+)", 1, 2),
    UrlRule("smartrecruiters", r"^jobs\.smartrecruiters\.com$", r"^/([^/?#]+)/(\d+)", 1, 2),
    UrlRule("workday", r"\.myworkdayjobs\.com$", r"/job/(?:[^/?#]+/)*([^/?#]+)/?(?:[?#]|$)", "label", 1, "the stored id usually differs; look the url up"),
    UrlRule("workday", r"\.myworkdayjobs\.com$", r"", "label", 0, "the stored id usually differs; look the url up"),
    UrlRule("keka", r"\.keka\.com$", r"(?i)^/careers/jobdetails/([^/?#]+)", "label", 1),
    UrlRule("darwinbox", r"\.darwinbox\.(in|com)$", r"(?i)/jobDetails/([0-9a-zA-Z]+)", "label", 1),
    UrlRule("darwinbox", r"\.darwinbox\.(in|com)$", r"(?i)/careers/([0-9a-zA-Z]+)(?:[/?#]|$)", "label", 1, "older shape of the url; look the url up"),
    UrlRule("zohorecruit", r"\.zohorecruit\.(com|in)$", r"^(?:.*)/(\d+)(?=[/?#]|$)", "label", 1),
    UrlRule("zohorecruit", r"\.zohorecruit\.(com|in)$", r"", "label", 0),
    UrlRule("freshteam", r"\.freshteam\.com$", r"^/jobs/([^/?#]+)", "label", 1),
    UrlRule("oracle", r"\.oraclecloud\.com", r"(?i)/job/([^/?#]+)", "host", 1),
    UrlRule("eightfold", r"\.eightfold\.ai$", r"(?i)/careers/job/([^/?#]+)", "label", 1),
    UrlRule("eightfold", r"\.eightfold\.ai$", r"[?&]pid=([^&#]+)", "label", 1, "the vendor's own url; look the url up"),
    UrlRule("bamboohr", r"\.bamboohr\.com$", r"^/careers/(?!list(?:[/?#]|$))([^/?#]+)", "label", 1),
    UrlRule("greenhouse", r"", r"[?&]gh_jid=([^&#]+)", None, 1, "embedded board; find the company by its host"),
    UrlRule(None, r"", r"(?i)/job/[^/?#]+/(\d+)(?:-[^/?#]+)?/?(?:[?#]|$)", "host", 1, "shape of several vendors; find the company by its host"),
)
# Hosts that many companies share.
SHARED_HOSTS = ("boards.greenhouse.io", "job-boards.greenhouse.io", "jobs.lever.co", "jobs.ashbyhq.com", "jobs.smartrecruiters.com")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def site_of(url: Column) -> Column:
    """The lower-cased host with its port, unless that is the scheme's own."""
    site = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1))
    usual = (F.lower(url).startswith("https:") & site.endswith(":443")) | (F.lower(url).startswith("http:") & site.endswith(":80"))
    return F.when(usual, F.regexp_replace(site, r":\d+$", "")).otherwise(site)


def resolve_job_urls(df: DataFrame, url: str, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """Df with provider, slug_hint, external_id and hint of its urls; null where no shape fits."""
    host = host_of(F.col(url))
    rest = F.regexp_replace(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")

    def found(r: UrlRule) -> Column:
        fits = (host != "") & (host.rlike(r.host) if r.host else F.lit(True)) & (rest.rlike(r.path) if r.path else F.lit(True))
        slug = F.lit(None).cast("string") if r.slug is None else host if r.slug == "host" else F.split_part(host, F.lit("."), F.lit(1)) if r.slug == "label" else F.regexp_extract(rest, r.path, r.slug)
        external = F.regexp_extract(rest, r.path, r.id) if r.id else F.lit(None).cast("string")
        return F.when(fits, F.struct(F.lit(r.provider).cast("string").alias("provider"), slug.alias("slug_hint"), external.alias("external_id"), F.lit(r.hint).cast("string").alias("hint")))

    return df.withColumn("__x", F.coalesce(*map(found, rules))).select(*df.columns, "__x.provider", "__x.slug_hint", "__x.external_id", "__x.hint")


#: Length of the grams of a containment join; needles that are shorter are looked up by a gram of their own length.
GRAM = 4
#: Needles that travel to the tasks at most, in place of an index dealt by its grams.
PROBES = 20_000
#: Rows of a key on either side that meet in one task of dealt_join.
BLOCK_ROWS = 2000


def _grams(text: Column, n: int) -> Column:
    """Distinct stretches of n characters."""
    starts = F.sequence(F.lit(1), F.char_length(text) - n + 1)
    return F.when(F.char_length(text) >= n, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str, gram: int = GRAM) -> DataFrame:
    """Pairs (text, needle), each once, in which the text holds the needle: an inverted index of grams in place of all pairs.

    A text that holds a needle holds all of its grams, so the needle is looked up by the one that fewest texts have. Needles of
    fewer characters than `gram` are grams themselves. The candidates are verified. Empty needles and nulls are in nothing.
    Of the index only counts are dealt out, unless there are more than PROBES needles.
    """
    whole = texts.select(F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    asked = needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct()
    sizes = [n for n in range(1, gram)]
    short = {r[0] for r in asked.where(F.char_length("needle") < gram).select(F.char_length("needle")).distinct().collect()}
    lengths = [n for n in sizes if n in short] + [gram]
    index = whole.select("text", F.explode(F.flatten(F.array(*[_grams(F.col("text"), n) for n in lengths]))).alias("gram"))
    own = F.when(F.char_length("needle") < gram, F.array("needle")).otherwise(_grams(F.col("needle"), gram))
    keys = asked.select("needle", F.explode(own).alias("gram"))
    counts = index.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = keys.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
    probes = rarest.where("g.n > 0").select("needle", F.col("g.gram").alias("gram"))
    few = probes.limit(PROBES + 1).collect()
    if len(few) <= PROBES:
        probes = F.broadcast(texts.sparkSession.createDataFrame(few, probes.schema))
    return index.join(probes, "gram").where(F.contains("text", "needle")).select("text", "needle")


def dealt_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """left and right joined by key, where very many rows of both may share one, so that its pairs are their product.

    Rows of such a key are dealt into blocks of about `rows`, and every block of one side meets every block of the other in a
    group of its own. Keys of more than `rows` rows are so few that their table is broadcast. Nothing is done to pairs.
    """

    def blocks(df: DataFrame, name: str) -> DataFrame:
        many = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > rows)
        return F.broadcast(many.select(key, F.ceil(F.col("n") / rows).cast("int").alias(name)))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        wide = df.join(blocks(left, "__i"), key, "left").join(blocks(right, "__j"), key, "left")
        turn = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return wide.select(*df.columns, turn.alias(own), other).select(*df.columns, own, every.alias(other))

    return dealt(left, "__i", "__j").join(dealt(right, "__j", "__i"), [key, "__i", "__j"]).drop("__i", "__j")


def find_companies(resolved: DataFrame, companies: DataFrame, url: str = "url", keep: tuple[str, ...] = ()) -> DataFrame:
    """companies of resolved urls by (provider, slug), else those whose careers page or tenant url holds the url's host.

    A text that is no url is looked up by its slug hint. Hosts that many companies share find none. keep: columns of resolved
    that stay with the url. Urls and companies of one host are as many pairs as their product: companies are told apart per
    host before, so that pairs come last and need neither be compared nor dealt out.
    """
    own = [url, *keep]
    tenant = F.col("tenant_url") if "tenant_url" in companies.columns else F.lit(None).cast("string")
    key = companies.select("provider", "slug", "name", "careers_url", tenant.alias("tenant_url"))
    named = resolved.select(*own, F.col("provider").alias("__p"), F.col("slug_hint").alias("__s")).distinct()
    exact = named.join(key, (F.col("__p") == key["provider"]) & (F.col("__s") == key["slug"])).select(*own, "provider", "slug", "name")
    host = site_of(F.col(url))
    rest = named.join(exact.select(*own).distinct(), own, "left_anti").withColumn("__host", F.coalesce(F.when(host != "", host), "__s")).where(~F.col("__host").isin(*SHARED_HOSTS))
    places = key.select("provider", "slug", "name", F.explode(F.array_distinct(F.array(F.lower("careers_url"), F.lower("tenant_url")))).alias("__text"))
    pairs = contains_join(places, "__text", rest, "__host").withColumnsRenamed({"text": "__text", "needle": "__host"})
    held = pairs.join(places, "__text").select("__host", "provider", "slug", "name").distinct()
    # A url that is asked for without a provider gets all companies; what else asks for it adds none.
    any_provider = F.bool_or(F.col("__p").isNull()).over(Window.partitionBy(*own, "__host"))
    asked = rest.select(*own, "__host", "__p", (F.coalesce(host, F.lit("")) != "").alias("__site")).distinct().withColumn("__any", any_provider).where("__p IS NULL OR NOT __any").drop("__any")

    def found(df: DataFrame) -> DataFrame:
        fits = F.col("__p").isNull() | (F.col("__p") == F.col("provider"))
        return dealt_join(df.select(*own, "__host", "__p"), held, "__host", BLOCK_ROWS).where(fits).select(*own, "provider", "slug", "name")

    # A url has one host, so its companies come once; a text may have many hints, which may find the same company.
    return exact.union(found(asked.where("__site"))).union(found(asked.where("NOT __site")).distinct())


def find_postings(resolved: DataFrame, postings: DataFrame, profile_id: str, url: str = "url") -> DataFrame:
    """F8: postings of resolved urls by (provider, external_id), else those whose url continues the given one's path."""
    own = postings.where(F.col("profile_id") == profile_id)
    ids = resolved.select(url, "provider", "external_id")
    exact = ids.join(own, ["provider", "external_id"]).select(url, "provider", "external_id", "job_url")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+$", "")
    rest = ids.join(exact.select(url).distinct(), url, "left_anti").select(url, bare(F.col(url)).alias("__u"))
    parts = F.split(bare(F.col("job_url")), "/")
    prefixes = F.transform(F.sequence(F.lit(3), F.greatest(F.size(parts), F.lit(3))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    spread = own.select("provider", "external_id", "job_url", F.explode(F.array_distinct(prefixes)).alias("__u"))
    return exact.union(rest.join(spread, "__u").select(url, "provider", "external_id", "job_url"))
