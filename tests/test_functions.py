"""Text, time and filter functions on literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from feedloom.functions import filters, text, times


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "c string")
    row = df.select(*[c.alias(f"x{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


PAY = [
    ("CTC: 12-18 LPA", (1_200_000, 1_800_000, "INR", "year")),
    ("₹12,00,000 - ₹15,00,000 per annum", (1_200_000, 1_500_000, "INR", "year")),
    ("Salary: $120k-$150k", (120_000, 150_000, "USD", "year")),
    ("pay is $25/hr", (52_000, 52_000, "USD", "hour")),
    ("1 - 1.5 Cr", (10_000_000, 15_000_000, "INR", "year")),
    ("budget 20k - 30k", (None, None, None, None)),
    ("Salary range 90k - 120k", (90_000, 120_000, "INR", "year")),
    ("Founded in 2024-2026", None),
    ("", None),
    ("We paid $5 and then € 60,000 per year", (60_000, 60_000, "EUR", "year")),
]


@pytest.mark.parametrize(("said", "want"), [p for p in PAY if p[1] is None or p[1][0] is not None])
def test_salary(spark, said, want):
    got = one(spark, said, filters.extract_salary(F.col("c")))
    assert (None if got is None else (got["annual_min"], got["annual_max"], got["currency"], got["period"])) == want


@pytest.mark.parametrize(
    ("said", "want"),
    [("5+ years of experience", 5), ("3-5 yrs, at least 2 years of SQL", 2), ("Must be 18 years of age", None), ("in business since 20 years", None), ("30 years", None), ("team of 12", None), ("", None), ("0 years, 7 years in Java", 7)],
)
def test_stated_years(spark, said, want):
    assert one(spark, said, filters.stated_yoe_min(F.col("c"))) == want


@pytest.mark.parametrize(("said", "want"), [("TBD", True), ("  n/a. ", True), ("***", True), ("Please enter job description", True), ("", False), ("Real text", False), ("Lorem ipsum dolor", True), (None, False)])
def test_junk(spark, said, want):
    assert one(spark, said, filters.is_junk_jd(F.col("c"))) == want


def test_html(spark):
    html = "<div>A &amp; B<br>x</div><script>var a = '<b>';</script><p>&#8377;5 &#x20AC;6 &#x1F600; &nope; &#99999999;</p>\n\n\n<li>c</li>"
    assert one(spark, html, text.html_to_text(F.col("c"))) == "A & B\nx\n₹5 €6 😀 &nope; &#99999999;\n\nc"
    assert one(spark, "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;", text.html_to_text(F.col("c"))) == "Hi & bye"
    assert one(spark, None, text.html_to_text(F.col("c"))) == ""
    assert one(spark, "&amp;lt; &foo; &#65;", text.decode_attr_entities(F.col("c"))) == "&lt; &foo; A"


def test_names(spark):
    assert one(spark, "Acme, Pvt. Ltd.", text.normalize_company_name(F.col("c")), text.kebab_case(F.col("c"))) == ("acme", "acme-pvt-ltd")
    assert one(spark, "Ltd", text.normalize_company_name(F.col("c"))) == "ltd"
    assert one(spark, "The Big Co Ltd", text.slug_variants(F.col("c"))) == ["the-big-co-ltd", "thebigcoltd", "the-big-co", "thebigco", "big-co-ltd"]
    assert one(spark, "A@x.com / b@y.org, bad, C@Z.net", text.split_emails(F.col("c"))) == ["a@x.com", "b@y.org", "c@z.net"]
    assert one(spark, "x@Acme.co.in", text.domain_label(F.col("c"))) == "acme"
    assert one(spark, "foobar", text.stable_hash(F.col("c"))) == "1h5yxyg"
    assert one(spark, "", text.first_name(F.col("c"))) == "there"
    assert one(spark, "unknown", text.company_for_mention(F.col("c"))) is None
    assert one(spark, "India > Karnataka > india", text.location_hierarchy(F.col("c"), F.lit("Bengaluru"))) == "Bengaluru, India, Karnataka"
    assert one(spark, "x", text.join_location(F.lit(" Pune "), F.lit(None).cast("string"), F.lit(""), F.lit("India"))) == "Pune, India"


def test_template(spark):
    assert one(spark, "Ann", text.compile_template("Hi {{ name }}!", name=F.col("c"))) == "Hi Ann!"
    with pytest.raises(ValueError, match="who"):
        text.compile_template("Hi {{who}}")


def test_json(spark):
    assert one(spark, '{"a": {"b": [1, {"c": "x"}]}}', text.dig(F.col("c"), "a.b.1.c"), text.dig(F.col("c"), "a.z.q")) == ("x", None)
    assert one(spark, "not json", text.dig(F.col("c"), "a"), F.size(text.parse_roles(F.col("c")))) == (None, 0)


def test_times(spark):
    now = F.lit("2024-03-31 12:00:00").cast("timestamp")
    at = lambda d, h=12: datetime.datetime(2024, *d, h)
    assert one(spark, "Posted 3+ weeks ago", times.parse_relative(F.col("c"), now)) == at((3, 10))
    assert one(spark, "Posted Yesterday", times.parse_relative(F.col("c"), now)) == at((3, 30))
    assert one(spark, "soon", times.parse_relative(F.col("c"), now)) is None
    assert one(spark, "about 1 month", times.parse_age(F.col("c"), now)) == at((3, 1))
    assert one(spark, "31-12-2023", times.parse_vendor_date(F.col("c"))) == datetime.datetime(2023, 12, 31)
    assert one(spark, "20231231", times.parse_vendor_date(F.col("c"))) == datetime.datetime(2023, 12, 31)
    assert one(spark, "x", times.parse_vendor_date(F.col("c"))) is None


PROFILE = filters.Profile(cities=("pune",), countries=("india",), remote=("remote",), reject=("us only",), reject_regions=("london",))


@pytest.mark.parametrize(
    ("place", "want"),
    [("Pune", (True, "in-region")), ("London", (False, "geo-rejected")), ("London or Pune", (True, "in-region")), ("Remote (US only)", (False, "geo-rejected")), ("Remote", (True, "remote-accept")), ("", (False, "no-location")), (None, (False, "no-location")), ("Paris", (False, "out-of-region")), ("Punetown", (False, "out-of-region"))],
)
def test_location(spark, place, want):
    assert tuple(one(spark, place, filters.check_location(F.col("c"), F.lit(False), PROFILE))) == want


def test_location_from_text(spark):
    check = lambda title, jd, url="": tuple(one(spark, jd, filters.check_location_text(F.lit(title), F.col("c"), F.lit(url), PROFILE)))
    assert check("Analyst", "x" * 3000 + " US only") == (False, "geo-rejected")
    assert check("Analyst, London", "") == (False, "geo-rejected-title")
    assert check("Analyst", "text", "https://a.example/jobs/london-1") == (False, "geo-rejected-url")
    assert check("Analyst", "About\nLocation: London\nmore") == (False, "geo-rejected-jd-location")
    assert check("Analyst", "work in India") == (True, "in-region-text")
    assert check("", "") == (True, "no-text-defer")


def test_profile_thresholds():
    with pytest.raises(ValueError):
        filters.Profile(match_threshold=0.6)


def test_verdicts(spark):
    rows = [(0.9, None, None, 3.0, 6.0, "silver"), (0.9, "x", "hard", None, None, "a"), (0.3, None, None, None, None, "lead"), (0.3, None, None, 8.0, None, "lead"), (0.9, None, None, None, None, "a"), (0.9, None, None, 5.0, None, "a"), (0.7, None, None, 3.0, 6.0, "a"), (0.9, "y", "soft", 1.0, 9.0, "a"), (0.9, None, None, 7.0, None, "a")]
    df = spark.createDataFrame(rows, "match_score double, deal_breaker_hit string, deal_breaker_severity string, yoe_min double, yoe_max double, job_title string").withColumn("reason", F.lit("ok"))
    got = [tuple(r["v"]) for r in df.select(filters.classify_verdict(filters.Profile(never_silence=("lead",))).alias("v")).collect()]
    assert got == [("green", "ok"), ("silent", "x"), ("yellow", "priority-title, borderline score (0.30)"), ("silent", "score-too-low (0.30)"), ("yellow", "yoe-unknown"), ("yellow", "under-qualified (needs 5+)"), ("yellow", "borderline-score (0.70)"), ("yellow", "soft: y"), ("silent", "needs 7+ years (hard cap 6)")]
