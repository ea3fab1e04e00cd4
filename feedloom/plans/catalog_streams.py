"""Registered queries of the feed's streams with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import decide, normalise, reports
from feedloom.plans.catalog import PROFILE, query, ts
from feedloom.plans.catalog_values import written
from feedloom.plans.tables import scratch
from feedloom.sources import readers
from feedloom.sources.payload_source import PayloadSource
from feedloom.streaming import feed, health, mail

#: Outcomes of boards (users) by event; boards begin in different states.
_OUTCOMES = """SELECT 'p' AS provider, 'user-' || CAST(user_id AS STRING) AS slug, ts AS happened, event_id AS seq,
    CASE event_type WHEN 'purchase' THEN event_id % 5 WHEN 'signup' THEN event_id % 2 WHEN 'view' THEN 0 WHEN 'click' THEN CASE WHEN event_id % 3 > 0 THEN 0 END END AS seen,
    CASE WHEN event_type = 'error' OR (event_type = 'click' AND event_id % 3 = 0) THEN 'failed ' || CAST(event_id AS STRING) END AS error, event_type = 'click' AS transport_fault, user_id, event_id FROM {events}"""
_BOARDS = """SELECT DISTINCT 'p' AS provider, 'user-' || CAST(user_id AS STRING) AS slug, CASE user_id % 5 WHEN 2 THEN 'dormant' WHEN 4 THEN 'denied' ELSE 'active' END AS status,
    CASE user_id % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'llm_scrape' ELSE 'playwright' END AS parsing_strategy, user_id % 4 AS consecutive_failures, user_id % 2 AS zero_yield_streak, user_id % 7 = 0 AS url_suspect, 0 AS postings_seen_total FROM {events}"""
_AT_RISK = "status = 'active' AND parsing_strategy <> 'api' AND zero_yield_streak >= 3"


@written("i8_stream_health", f"""WITH RECURSIVE o AS ({_OUTCOMES.format(events="events")}), b AS ({_BOARDS.format(events="events")}),
    e AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY happened, seq) AS n FROM o),
    h AS (SELECT slug, 0::BIGINT AS n, NULL::TIMESTAMP AS last_at, status, parsing_strategy, consecutive_failures, zero_yield_streak, url_suspect, postings_seen_total, NULL::VARCHAR AS last_error, NULL::TIMESTAMP AS last_success_at FROM b
      UNION ALL SELECT slug, n, happened, CASE WHEN error IS NULL AND seen > 0 AND swept = 'dormant' THEN 'active' WHEN error IS NOT NULL AND NOT transport_fault AND consecutive_failures + 1 >= 5 THEN 'broken' ELSE swept END, parsing_strategy,
        CASE WHEN error IS NULL THEN 0 WHEN transport_fault THEN consecutive_failures ELSE consecutive_failures + 1 END, CASE WHEN error IS NOT NULL THEN zero_yield_streak WHEN seen > 0 THEN 0 ELSE zero_yield_streak + 1 END,
        url_suspect AND NOT (error IS NULL AND seen > 0), postings_seen_total + CASE WHEN error IS NULL THEN seen ELSE 0 END, error, CASE WHEN error IS NULL THEN happened ELSE last_success_at END
      FROM (SELECT e.slug, e.n, e.happened, e.seen, e.error, e.transport_fault, h.* EXCLUDE (slug, n), CASE WHEN date_trunc('day', last_at) < date_trunc('day', e.happened) AND {_AT_RISK} THEN 'dormant' ELSE status END AS swept FROM h JOIN e ON e.slug = h.slug AND e.n = h.n + 1))
    SELECT slug, CASE WHEN {_AT_RISK} THEN 'dormant' ELSE status END AS status, consecutive_failures, zero_yield_streak, url_suspect, postings_seen_total, last_at AS last_fetched_at, last_success_at, last_error
    FROM h QUALIFY row_number() OVER (PARTITION BY slug ORDER BY n DESC) = 1""")  # fmt: skip
def _(spark, v, t):
    root = scratch(spark, "health")
    outcomes = spark.sql(_OUTCOMES, events=t("events")).withColumn("at", F.col("happened").cast("timestamp"))
    boards = spark.sql(_BOARDS, events=t("events"))
    columns = ("provider", "slug", "at", "seq", "seen", "error", "transport_fault")
    # Three arrivals that overlap by half a day; the last one brings time on until all is settled.
    first = outcomes.agg(F.min("at")).first()[0]
    arrival = F.least(F.floor((F.unix_seconds("at") - F.unix_seconds(F.lit(first)) + F.pmod(F.hash("event_id"), F.lit(43200))) / (86400 * 11)), F.lit(2)).cast("int")
    close = outcomes.agg(F.max("at").alias("at")).select(F.lit("p").alias("provider"), F.lit("end").alias("slug"), (F.col("at") + F.expr("INTERVAL 3 DAYS")).alias("at"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("seen"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("transport_fault"))
    outcomes.withColumn("arrival", arrival).select(*columns, "arrival").repartition("arrival").write.partitionBy("arrival").parquet(f"{root}/in")
    close.withColumn("arrival", F.lit(3)).write.mode("append").partitionBy("arrival").parquet(f"{root}/in")
    for turn in range(4):
        # Each arrival is a run of its own, which finds the state that the one before left.
        arrived = spark.readStream.schema(outcomes.select(*columns).schema).parquet(f"{root}/in/arrival=[0-{turn}]")
        with health.rocksdb_state(spark):
            health.health_stream(arrived, boards).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    state = ("status", "consecutive_failures", "zero_yield_streak", "url_suspect", "postings_seen_total", "last_fetched_at", "last_success_at", "last_error")
    last = spark.read.parquet(f"{root}/out").where("slug <> 'end'").groupBy("slug").agg(F.max_by(F.struct(*state), F.col("at")).alias("s"))
    return last.select("slug", "s.*")


# The feed: of each board three snapshots in order, a fourth that comes late; detail pages before and after their postings.
_SIZE = "'size-' || CAST(p_size AS STRING) || '-' || CAST(p_partkey // 1000 AS STRING)"
_ONE, _TWO, _THREE = "p_partkey % 4 <> 3", "p_partkey % 4 <> 1", "p_partkey % 4 <> 0"


def _fed(spark, t):
    root = scratch(spark, "feed")
    spec = normalise.JsonSpec("jobs array<struct<id:string,title:string>>", "jobs", {"external_id": "item.id", "job_title": "item.title", "job_url": "concat('https://a.example.com/', item.id)", "location": "'NATION_1'"})
    parts = t("part").select("p_partkey", F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("title"), F.concat(F.lit("size-"), F.col("p_size").cast("string"), F.lit("-"), F.floor(F.col("p_partkey") / 1000).cast("string")).alias("slug"), "p_name")

    def listing(turn: int, day: str, where: str) -> None:
        jobs = F.to_json(F.struct(F.collect_list(F.when(F.expr(where), F.struct("id", "title"))).alias("jobs")))
        rows = parts.groupBy("slug").agg(jobs.alias("body"))
        rows.select(F.lit("g").alias("provider"), "slug", F.lit(1).alias("page"), ts(day).alias("fetched_at"), F.lit(None).cast("long").alias("reported_total"), F.lit("json").alias("kind"), "body").write.mode("append").json(f"{root}/in/turn={turn}")

    def details(turn: int, day: str, where: str) -> None:
        node = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.concat(F.lit("<p>"), "p_name", F.lit(" work, 3 years</p>")).alias("description")))
        html = F.concat(F.lit('<script type="application/ld+json">'), node, F.lit("</script>"))
        parts.where(where).select(F.lit("g").alias("provider"), "slug", F.concat(F.lit("https://a.example.com/"), "id").alias("url"), ts(day).alias("fetched_at"), html.alias("html")).write.json(f"{root}/pages/turn={turn}")

    own = feed.Feed(f"{root}/feed", PROFILE, decide.keyword_scorer({"ring": 0.9, "widget": 0.7}), lambda raw: normalise.normalize_json(raw, spec, ("fetched_at",)), buckets=8)
    page = "provider string, slug string, url string, fetched_at timestamp, html string"
    arrivals = ((("2024-01-01", _ONE),), ("2023-12-31", "p_partkey % 6 = 0")), ((("2024-01-03", _THREE), ("2024-01-02", _TWO)), ("2024-01-01", "p_partkey % 6 = 3")), ((("2024-01-01 12:00:00", "true"),), ("2024-01-04", "p_partkey % 6 = 2"))
    for turn, (snapshots, (day, where)) in enumerate(arrivals):
        for at, listed in snapshots:
            listing(turn, at, listed)
        details(turn, day, where)
        own.start(readers.stream_payloads(spark, f"{root}/in/*"), spark.readStream.schema(page).json(f"{root}/pages/*")).awaitTermination()
    return own


@written("i22_stream_feed", f"""WITH s AS (SELECT p_partkey, 'part-' || p_partkey AS external_id, p_name, CASE WHEN {_ONE} THEN TIMESTAMP '2024-01-01' ELSE TIMESTAMP '2024-01-02' END AS discovered_at, CASE WHEN {_THREE} THEN TIMESTAMP '2024-01-03' ELSE TIMESTAMP '2024-01-02' END AS last_seen_at,
      CASE WHEN NOT ({_THREE}) THEN TIMESTAMP '2024-01-03' END AS removed_at, p_partkey % 3 = 0 OR p_partkey % 6 = 2 AS told FROM part)
    SELECT external_id, discovered_at, last_seen_at, removed_at, CASE WHEN told THEN p_name || ' work, 3 years' END AS jd_text, CASE WHEN p_name LIKE 'red%' THEN 'title-deny' WHEN told THEN CASE WHEN score >= 0.65 THEN 'yellow' ELSE 'silent' END END AS decision,
      CASE WHEN p_name LIKE 'red%' THEN discovered_at WHEN told THEN CASE WHEN p_partkey % 6 = 2 THEN TIMESTAMP '2024-01-04' ELSE discovered_at END END AS decided_at
    FROM (SELECT *, least(1.0, CASE WHEN p_name LIKE '%ring%' THEN 0.9 ELSE 0 END + CASE WHEN p_name LIKE '%widget%' THEN 0.7 ELSE 0 END) AS score FROM s)""")  # fmt: skip
def _(spark, v, t):
    return _fed(spark, t).read(spark, "postings").select("external_id", "discovered_at", "last_seen_at", "removed_at", "jd_text", "decision", "decided_at")


@written("i22_stream_runs", f"""WITH f AS (SELECT {_SIZE} AS company_slug, {_ONE} AS one, {_TWO} AS two, {_THREE} AS three FROM part), s AS (
      SELECT company_slug, TIMESTAMP '2024-01-01' AS run_at, false AS before, one AS now FROM f UNION ALL SELECT company_slug, TIMESTAMP '2024-01-02', one, two FROM f UNION ALL SELECT company_slug, TIMESTAMP '2024-01-03', two, three FROM f)
    SELECT company_slug, run_at, count(*) FILTER (now AND NOT before) AS added, count(*) FILTER (before AND NOT now) AS removed, count(*) FILTER (now AND before) AS unchanged FROM s GROUP BY 1, 2""")  # fmt: skip
def _(spark, v, t):
    return _fed(spark, t).read(spark, "runs").select("company_slug", "run_at", "added", "removed", "unchanged")


# Drafts and the mailbox, each a stream of its own.
_WITHIN = "address = recruiter_email AND internal_date > drafted_at AND internal_date <= drafted_at + INTERVAL '14' DAY"


@written("f9_stream_mail", f"""WITH m AS (SELECT id, max(CASE WHEN folder = 'sent' THEN {{'t': internal_date, 'id': v_mailbox.message_id}} END) AS s, max(CASE WHEN folder = 'bounce' THEN {{'t': internal_date, 'id': v_mailbox.message_id, 'x': snippet}} END) AS b FROM v_drafts LEFT JOIN v_mailbox ON {_WITHIN} GROUP BY 1)
    SELECT id, s.t AS sent_at, s.id AS message_id, CASE WHEN b.t > s.t THEN b.t END AS bounced_at, CASE WHEN b.t > s.t THEN b.x END AS failure_detail, CASE WHEN s.t IS NULL THEN 'discarded' WHEN b.t > s.t THEN 'bounced' ELSE 'verified' END AS status FROM m""")  # fmt: skip
def _(spark, v, t):
    root = scratch(spark, "mail")
    drafts = v("v_drafts").select("id", "recruiter_email", F.col("drafted_at").cast("timestamp").alias("drafted_at"))
    mailbox = v("v_mailbox").select("message_id", "folder", "address", F.col("internal_date").cast("timestamp").alias("internal_date"), "snippet")
    tenth = lambda c: F.floor(F.dayofmonth(c) / 11).cast("int")
    drafts.withColumn("n", tenth("drafted_at")).write.partitionBy("n").parquet(f"{root}/drafts")
    mailbox.withColumn("n", tenth("internal_date")).write.partitionBy("n").parquet(f"{root}/mailbox")
    # A last draft and a last message, long after all others, end what is open.
    end = spark.range(1).select(ts("2024-06-01").alias("at"))
    end.select(F.lit(-1).cast("long").alias("id"), F.lit("end").alias("recruiter_email"), F.col("at").alias("drafted_at")).write.parquet(f"{root}/drafts/n=9")
    end.select(F.lit("end").alias("message_id"), F.lit("sent").alias("folder"), F.lit("end").alias("address"), F.col("at").alias("internal_date"), F.lit("").alias("snippet")).write.parquet(f"{root}/mailbox/n=9")
    for n in ("0", "[0-1]", "[0-2]", "*"):
        read = lambda what, df: spark.readStream.schema(df.schema).parquet(f"{root}/{what}/n={n}")  # noqa: E731, B023
        mail.follow_drafts(read("drafts", drafts), read("mailbox", mailbox)).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").where("id >= 0").drop("drafted_at")


# Sketches, the scorer in SQL, payloads as a source


@written("g9_sketched_guard", "SELECT provider, company_slug FROM v_postings GROUP BY 1, 2 HAVING count(DISTINCT lower(job_title)) > 10")
def _(spark, v, t):
    listing = v("v_postings").select("provider", "company_slug", F.col("job_title").alias("company_name"), F.to_date("discovered_at").alias("day"))
    path = f"{scratch(spark, 'sketches')}/days"
    # Years arrive one after the other; each adds its sketches to those that are there.
    years = sorted(r[0] for r in listing.select(F.year("day")).distinct().collect())
    for year in years:
        readers.write_table(reports.company_sketches(listing.where(F.year("day") == year), "day").withColumn("year", F.lit(year)), path, ("year",))
    sketches = spark.read.parquet(path)
    return reports.sketched_warnings(sketches, listing).select("provider", "company_slug")


@query("j3_table_function", """SELECT provider, external_id, profile_id, least(1.0, CASE WHEN job_title LIKE '%ring%' THEN 0.9 ELSE 0 END + CASE WHEN job_title LIKE '%widget%' THEN 0.7 ELSE 0 END)::DOUBLE AS match_score, row_number() OVER (PARTITION BY provider, company_slug ORDER BY external_id, profile_id) AS nth FROM v_postings""")
def _(v, t):
    postings = v("v_postings").withColumn("jd_text", F.lit(""))
    spark = postings.sparkSession
    spark.udtf.register("feedloom_score", decide.scoring_function(decide.keyword_scorer({"ring": 0.9, "widget": 0.7})))
    return spark.sql("SELECT provider, external_id, profile_id, match_score, nth FROM feedloom_score(TABLE({rows}) PARTITION BY (provider, company_slug) ORDER BY (external_id, profile_id))", rows=postings)


_FILES = "SELECT 'p' || p_size % 5 AS provider, 'size ' || p_size AS slug, p_partkey AS page, 'kind' AS kind, p_name AS body FROM part"


@written("a8_payload_source", f"SELECT provider, slug, page, body, count(*) AS arrivals FROM ({_FILES} UNION ALL {_FILES} WHERE p_size % 5 IN (1, 3)) GROUP BY ALL")
def _(spark, v, t):
    root = scratch(spark, "boards")
    rows = t("part").select(F.concat(F.lit("p"), (F.col("p_size") % 5).cast("string")).alias("provider"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("slug"), F.col("p_partkey").cast("int").alias("page"), F.lit("kind").alias("kind"), F.col("p_name").alias("body"))
    rows.write.partitionBy("provider", "slug").json(f"{root}/in")
    spark.dataSource.register(PayloadSource)
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", None)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        # The stream takes all boards; the batch read is left to two providers by the source itself.
        spark.readStream.format("board_payloads").load(f"{root}/in").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        some = spark.read.format("board_payloads").load(f"{root}/in").where("provider IN ('p1', 'p3')")
        some.write.parquet(f"{root}/some")
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled") if before is None else spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    both = spark.read.parquet(f"{root}/out").unionByName(spark.read.parquet(f"{root}/some"))
    return both.groupBy("provider", "slug", "page", "body").agg(F.count("*").alias("arrivals"))
