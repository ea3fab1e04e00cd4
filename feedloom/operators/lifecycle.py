"""Incremental state of postings, companies and contacts: each operator maps old tables and news to new tables.

Keys are unique in the tables; news may repeat a key, then the first row by the order given wins. The clock is an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PK = ["provider", "external_id", "profile_id"]
BOARD = ["provider", "company_slug", "profile_id"]


def first_per_key(df: DataFrame, key: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__rn = 1").drop("__rn")


def last_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    return first_per_key(df, key, F.col(order).desc())


def union_latest(frames: list[DataFrame], key: list[str]) -> DataFrame:
    """Union in which later frames replace earlier ones by key."""
    tagged = [df.withColumn("__from", F.lit(i)) for i, df in enumerate(frames)]
    whole = tagged[0]
    for df in tagged[1:]:
        whole = whole.unionByName(df, allowMissingColumns=True)
    return last_per_key(whole, key, "__from").drop("__from")


def subtract_keys(df: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in seen."""
    return df.join(seen.select(*key).distinct(), key, "left_anti")


def insert_new(postings: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """Postings with the unseen rows of a listing, discovered and last seen now."""
    fresh = first_per_key(subtract_keys(listing, postings, PK), PK, "job_url")
    return postings.unionByName(fresh.withColumn("discovered_at", now).withColumn("last_seen_at", now), allowMissingColumns=True)


def mark_seen(postings: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """What the listing holds was seen now and is no longer removed."""
    keys = listing.select(*PK).distinct().withColumn("__seen", F.lit(True))
    joined = postings.join(keys, PK, "left")
    seen = F.col("__seen").isNotNull()
    return joined.withColumn("last_seen_at", F.when(seen, now).otherwise(F.col("last_seen_at"))).withColumn("removed_at", F.when(~seen, F.col("removed_at"))).drop("__seen").select(*postings.columns)


def mark_removed(postings: DataFrame, ok_boards: DataFrame, now: Column) -> DataFrame:
    """Of boards fetched well (key of BOARD, fetch_started_at), rows not seen since the fetch began are removed now."""
    boards = ok_boards.groupBy(*BOARD).agg(F.max("fetch_started_at").alias("__started"))
    joined = postings.join(boards, BOARD, "left")
    gone = F.col("removed_at").isNull() & F.coalesce(F.col("last_seen_at") < F.col("__started"), F.lit(False))
    return joined.withColumn("removed_at", F.when(gone, now).otherwise(F.col("removed_at"))).select(*postings.columns)


def board_diff(before: DataFrame, listing: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """I4: added, removed, unchanged per board; with outcomes (BOARD, error) also status and the error's start."""
    old = before.select(*BOARD, "external_id").distinct().withColumn("__old", F.lit(True))
    new = listing.select(*BOARD, "external_id").distinct().withColumn("__new", F.lit(True))
    both = old.join(new, [*BOARD, "external_id"], "full")
    counts = both.groupBy(*BOARD).agg(
        F.count_if(F.col("__old").isNull()).alias("added"), F.count_if(F.col("__new").isNull()).alias("removed"), F.count_if(F.col("__old") & F.col("__new")).alias("unchanged")
    )
    if outcomes is None:
        return counts
    # A board of several outcomes failed if any of them did.
    joined = counts.join(outcomes.groupBy(*BOARD).agg(F.max("error").alias("error")), BOARD, "full")
    failed = F.col("error").isNotNull()
    zero = [F.when(failed, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("added", "removed", "unchanged")]
    return joined.select(*BOARD, F.when(failed, "error").otherwise("ok").alias("status"), *zero, F.substring("error", 1, 300).alias("error"))


def claim_rechecks(postings: DataFrame, listing: DataFrame, now: Column, no_jd_days: int = 7, gate_minutes: int = 60) -> DataFrame:
    """Rows due for another look, with the listing's columns and the time of the claim."""
    checked = F.coalesce("jd_checked_at", "discovered_at")
    due = ((F.col("drop_stage") == "no-jd") & (checked < now - F.expr(f"INTERVAL {no_jd_days} DAYS"))) | ((F.col("drop_stage") == "gate-error") & (checked < now - F.expr(f"INTERVAL {gate_minutes} MINUTES")))
    fresh = ["job_title", "job_url", "location", "is_remote", "posted_at"]
    news = first_per_key(listing, PK, "job_url").select(*PK, *[F.col(c).alias(f"__{c}") for c in fresh])
    claimed = postings.where(due).join(news, PK)
    return claimed.withColumns({c: F.col(f"__{c}") for c in fresh} | {"jd_checked_at": now}).select(*postings.columns)


RESULTS = ["llm_relevant", "llm_reason", "llm_confidence", "yoe_min", "yoe_max", "drop_stage", "notified_at", "salary_min", "salary_max", "salary_currency", "salary_period"]


def write_results(postings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Result columns of decided postings replaced, null where a decision has none; of a key's decisions the latest run's counts."""
    have = [c for c in RESULTS if c in postings.columns]
    order = [c for c in ("run_id", *have) if c in decisions.columns] or PK
    news = first_per_key(decisions, PK, *[F.col(c).desc_nulls_last() for c in order]).select(*PK, *[(F.col(c) if c in decisions.columns else F.lit(None)).alias(f"__{c}") for c in have], F.lit(True).alias("__decided"))
    joined = postings.join(news, PK, "left")
    return joined.withColumns({c: F.when(F.col("__decided"), F.col(f"__{c}")).otherwise(F.col(c)) for c in have}).select(*postings.columns)


COMPANY = ["provider", "slug"]
STICKY = ("denied", "broken", "dormant")


def upsert_companies(companies: DataFrame, registry: DataFrame, trustworthy: bool, now: Column) -> DataFrame:
    """Registry rows over companies; a sticky status stays, what was discovered stays; prunes only if trustworthy."""
    fresh = ["name", "careers_url", "parsing_strategy", "status", "deny_reason", "tenant_url", "api_meta"]
    fresh = [c for c in fresh if c in companies.columns and c in registry.columns]
    news = first_per_key(registry, COMPANY, *fresh).select(*COMPANY, *[F.col(c).alias(f"__{c}") for c in fresh], F.lit(True).alias("__new"))
    old = companies.withColumn("__old", F.lit(True))
    joined = old.join(news, COMPANY, "full")
    listed, known = F.col("__new").isNotNull(), F.col("__old").isNotNull()
    changes = {c: F.when(listed, F.col(f"__{c}")).otherwise(F.col(c)) for c in fresh}
    if "status" in fresh:
        changes["status"] = F.when(known & F.col("status").isin(*STICKY), F.col("status")).otherwise(changes["status"])
    if "discovered_at" in companies.columns:
        changes["discovered_at"] = F.when(known, F.col("discovered_at")).otherwise(now)
    out = joined.where(listed) if trustworthy else joined
    return out.withColumns(changes).select(*companies.columns)


def apply_outcomes(companies: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """I8: health from outcomes (provider, slug, seen, error, transport_fault); a transport fault counts as no failure, and is told.

    Five failures in a row break a board, whatever its status was.
    Of a board's outcomes one counts: a success before a failure, the one that saw most (resolve_outcomes() settles passes).
    """
    once = first_per_key(outcomes, COMPANY, F.col("error").asc_nulls_first(), F.col("seen").desc_nulls_last(), F.col("transport_fault").desc_nulls_last())
    joined = companies.join(once.select(*COMPANY, "seen", "error", "transport_fault"), COMPANY, "left")
    done = F.col("seen").isNotNull() & F.col("error").isNull()
    tried = F.col("error").isNotNull()
    failed = tried & ~F.coalesce("transport_fault", F.lit(False))
    some = done & (F.col("seen") > 0)
    failures = F.col("consecutive_failures") + 1
    changes = {
        "last_fetched_at": F.when(done | tried, now).otherwise(F.col("last_fetched_at")),
        "last_success_at": F.when(done, now).otherwise(F.col("last_success_at")),
        "last_error": F.when(tried, F.substring("error", 1, 500)).when(~done, F.col("last_error")),
        "consecutive_failures": F.when(done, 0).when(failed, failures).otherwise(F.col("consecutive_failures")),
        "postings_seen_total": F.col("postings_seen_total") + F.when(done, F.col("seen")).otherwise(0),
        "zero_yield_streak": F.when(some, 0).when(done, F.col("zero_yield_streak") + 1).otherwise(F.col("zero_yield_streak")),
        "url_suspect": F.when(some, False).otherwise(F.col("url_suspect")),
        "status": F.when(some & (F.col("status") == "dormant"), "active").when(failed & (failures >= 5), "broken").otherwise(F.col("status")),
    }
    return joined.withColumns({c: x for c, x in changes.items() if c in companies.columns}).select(*companies.columns)


def apply_dormancy(companies: DataFrame, min_streak: int = 3) -> DataFrame:
    """Active scraped boards that gave nothing for long go dormant."""
    quiet = (F.col("status") == "active") & F.col("parsing_strategy").isin("llm_scrape", "playwright") & (F.col("zero_yield_streak") >= min_streak)
    return companies.withColumn("status", F.when(quiet, "dormant").otherwise(F.col("status")))


def bump_matched(companies: DataFrame, decisions: DataFrame) -> DataFrame:
    """Green and yellow decisions counted to their companies."""
    hits = decisions.where(F.col("decision").isin("green", "yellow")).groupBy("provider", F.col("company_slug").alias("slug")).agg(F.count("*").alias("__n"))
    return companies.join(hits, COMPANY, "left").withColumn("postings_matched_total", F.col("postings_matched_total") + F.coalesce("__n", F.lit(0))).select(*companies.columns)


def flag_suspect(companies: DataFrame, signals: DataFrame) -> DataFrame:
    """Companies whose page no longer looks like a careers page (provider, slug, looks_ok)."""
    bad = signals.where(~F.col("looks_ok")).select(*COMPANY).distinct().withColumn("__bad", F.lit(True))
    return companies.join(bad, COMPANY, "left").withColumn("url_suspect", F.coalesce("__bad", "url_suspect")).select(*companies.columns)


def switch_strategy(companies: DataFrame, link_counts: DataFrame, few: int = 3) -> DataFrame:
    """Scraped boards with few candidate links (provider, slug, links) are to be rendered."""
    thin = link_counts.where(F.col("links") <= few).select(*COMPANY).distinct().withColumn("__thin", F.lit(True))
    change = F.when(F.col("__thin") & (F.col("parsing_strategy") == "llm_scrape"), "playwright").otherwise(F.col("parsing_strategy"))
    return companies.join(thin, COMPANY, "left").withColumn("parsing_strategy", change).select(*companies.columns)


def upsert_recruiters(recruiters: DataFrame, contacts: DataFrame) -> DataFrame:
    """Contacts over recruiters by lower-cased email; bounced is final, unverified never replaces a better status."""
    rank = lambda c: F.when(F.col(c) == "bounced", 2).when(F.col(c) == "verified", 1).otherwise(0)
    rest = [c for c in recruiters.columns if c != "email" and c in contacts.columns]
    news = first_per_key(contacts.withColumn("email", F.lower("email")), ["email"], rank("status").desc(), *[c for c in rest if c != "status"])
    joined = recruiters.withColumn("__old", F.lit(True)).join(news.select("email", *[F.col(c).alias(f"__{c}") for c in rest], F.lit(True).alias("__new")), "email", "full")
    changes = {c: F.when(F.col("__new"), F.coalesce(F.col(f"__{c}"), F.col(c))).otherwise(F.col(c)) for c in rest}
    changes["status"] = F.when(F.col("__new").isNull(), F.col("status")).when(F.col("__old").isNull() | (rank("__status") >= rank("status")), F.col("__status")).otherwise(F.col("status"))
    return joined.withColumns(changes).select(*recruiters.columns)


def set_recruiter_status(recruiters: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (email, new_status, and `at` where their order counts), the last per email; a bounced contact stays so."""
    order = [F.col("at").desc_nulls_last()] if "at" in changes.columns else []
    news = first_per_key(changes.withColumn("email", F.lower("email")), ["email"], *order, F.col("new_status") != "bounced", "new_status")
    joined = recruiters.join(news.select("email", "new_status"), "email", "left")
    return joined.withColumn("status", F.when(F.col("status") == "bounced", F.col("status")).otherwise(F.coalesce("new_status", "status"))).select(*recruiters.columns)


def upsert_link_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The newest entry of each board."""
    return last_per_key(cache.unionByName(new), COMPANY, "cached_at")


def log_run(runs: DataFrame, summary: DataFrame) -> DataFrame:
    """The runs of a summary (a row each), numbered after the last by their start."""
    top = runs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    numbered = with_position(summary, ["started_at"], "__i").join(F.broadcast(top)).withColumn("id", F.col("__top") + F.col("__i") + 1).drop("__top", "__i")
    return runs.unionByName(numbered, allowMissingColumns=True)


#: Rows that the cuts of a text column come from.
CUT_SAMPLE = 10_000


def with_position(df: DataFrame, order: list[str], name: str, buckets: int = 256) -> DataFrame:
    """df with its position from 0 in the order of columns; rows equal in all of them are numbered by their other columns.

    Rows are ranked within buckets of the first column, and a bucket starts where those before it end, so no task ranks the whole
    table. Buckets are cut at quantiles: of numbers and times approximate ones, of text those of CUT_SAMPLE rows (the cuts only
    decide speed).
    """
    first = F.col(order[0])
    rest = [c for c in df.columns if c not in order and df.schema[c].dataType.typeName() not in ("map", "variant")]
    kind = df.schema[order[0]].dataType.typeName()
    if kind == "string":
        known = df.where(first.isNotNull())
        sample = sorted((r[0] for r in known.orderBy(F.xxhash64(*order, *rest)).select(first.alias("x")).limit(CUT_SAMPLE).collect()), key=str.encode)
        cuts = sorted({sample[i * len(sample) // buckets] for i in range(1, buckets)}, key=lambda x: x.encode()) if sample else []
        bucket = F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<string>"), lambda e: e <= first))
    else:
        number = F.unix_date(first).cast("double") if kind == "date" else (first.cast("timestamp") if kind.startswith("timestamp") else first).cast("double")
        cuts = df.agg(F.percentile_approx(number, [i / buckets for i in range(1, buckets)], buckets * 10).alias("q")).first()["q"] or []
        bucket = F.size(F.filter(F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<double>"), lambda e: e <= number))
    placed = df.withColumn("__bucket", bucket)
    sizes = placed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    # As many rows as there are buckets.
    before = sizes.select("__bucket", (F.sum("__n").over(Window.orderBy("__bucket")) - F.col("__n")).alias("__before"))
    inside = Window.partitionBy("__bucket").orderBy(*order, *rest)
    return placed.withColumn("__rank", F.row_number().over(inside)).join(F.broadcast(before), "__bucket").withColumn(name, F.col("__before") + F.col("__rank") - 1).drop("__bucket", "__rank", "__before")


def resolve_outcomes(outcomes: DataFrame) -> DataFrame:
    """Boards tried in up to two passes (pass, error, transport_fault): the last pass counts, and a fault in it is real."""
    last = last_per_key(outcomes, COMPANY, "pass")
    return last.withColumn("transport_fault", F.coalesce("transport_fault", F.lit(False)) & (F.col("pass") < 2))
