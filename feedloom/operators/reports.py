"""Health reports, tallies, rankings and joins over the tables of the feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import collapse_ws, notify_key
from feedloom.operators.lifecycle import first_per_key, with_position


def notified_with_company(postings: DataFrame, companies: DataFrame, since: Column, profile_id: str) -> DataFrame:
    """roles notified since a time and still listed, with the company's name (its slug where unknown)."""
    rows = postings.where((F.col("notified_at") >= since) & (F.col("profile_id") == profile_id) & F.col("removed_at").isNull())
    names = companies.select("provider", F.col("slug").alias("company_slug"), "name")
    joined = rows.join(names, ["provider", "company_slug"], "left")
    return joined.select("provider", "external_id", F.coalesce("name", "company_slug").alias("company"), F.coalesce("job_title", F.lit("")).alias("job_title"), "job_url", "location", "llm_confidence", F.when(F.col("drop_stage") == "yellow", "yellow").otherwise("green").alias("severity"))


def prior_notify_keys(postings: DataFrame, companies: DataFrame, now: Column, profile_id: str, days: int = 180) -> DataFrame:
    """identities of roles notified within the window."""
    rows = postings.where((F.col("notified_at") >= now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("profile_id") == profile_id))
    names = companies.select("provider", F.col("slug").alias("company_slug"), "name")
    return rows.join(names, ["provider", "company_slug"], "left").select(notify_key(F.col("name"), F.col("job_title"), F.col("location")).alias("notify_key")).distinct()


def split_prior_duplicates(listing: DataFrame, keys: DataFrame, key: str = "notify_key") -> tuple[DataFrame, DataFrame]:
    """(seen before, new)."""
    return listing.join(keys, key, "left_semi"), listing.join(keys, key, "left_anti")


def with_known_state(listing: DataFrame, postings: DataFrame) -> DataFrame:
    """listing with known, drop_stage and when the text was last looked at."""
    pk = ["provider", "external_id", "profile_id"]
    state = first_per_key(postings, pk, "discovered_at").select(*pk, F.col("drop_stage").alias("known_stage"), F.coalesce("jd_checked_at", "discovered_at").alias("jd_state_at"), F.lit(True).alias("__known"))
    return listing.join(state, pk, "left").withColumn("known", F.coalesce("__known", F.lit(False))).drop("__known")


def status_counts(companies: DataFrame) -> DataFrame:
    """G1."""
    return companies.groupBy(F.coalesce("status", F.lit("(unset)")).alias("status")).agg(F.count("*").alias("n"))


def _reach(companies: DataFrame, by: str, third: str, name: str) -> DataFrame:
    return companies.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col("last_success_at").isNotNull()).alias("reachable"), F.count_if(F.col(third) > 0).alias(name))


def strategy_counts(companies: DataFrame) -> DataFrame:
    """Total, reachable, ever matched."""
    return _reach(companies, "parsing_strategy", "postings_matched_total", "ever_matched")


def provider_counts(companies: DataFrame, status: str = "active") -> DataFrame:
    """Total, reachable, had jobs, of companies of one status."""
    return _reach(companies.where(F.col("status") == status), "provider", "postings_seen_total", "had_jobs")


def health_scalars(companies: DataFrame) -> DataFrame:
    """One row of counts over all companies, in one scan."""
    saw, ok = F.col("postings_seen_total") > 0, F.col("last_success_at").isNotNull()
    return companies.agg(
        F.count("*").alias("total"), F.count_if(saw).alias("ever_saw"), F.count_if(F.col("postings_matched_total") > 0).alias("productive"), F.count_if(ok & ~saw).alias("reachable_zero"),
        F.count_if(F.col("last_fetched_at").isNotNull() & ~ok).alias("never_succeeded"), F.count_if(F.col("last_fetched_at").isNull()).alias("never_fetched"),
        F.count_if("url_suspect").alias("suspect"), F.count_if(F.col("consecutive_failures") >= 3).alias("failing"),
    )


def removed_recently(postings: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """G5."""
    return postings.where(F.col("removed_at") >= now - F.expr(f"INTERVAL {days} DAYS")).groupBy("profile_id").agg(F.count("*").alias("removed"))


def tallies(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, blank ones as (unset)."""
    return df.groupBy(F.coalesce(F.when(F.trim(F.col(col)) != "", F.col(col)), F.lit("(unset)")).alias("value")).agg(F.count("*").alias("n"))


def board_counters(postings: DataFrame, since: Column) -> DataFrame:
    """Per board rows inserted since a time, and rows notified since then that were removed."""
    return postings.groupBy("provider", "company_slug", "profile_id").agg(
        F.count_if(F.col("discovered_at") >= since).alias("inserted"), F.count_if((F.col("notified_at") >= since) & F.col("removed_at").isNotNull()).alias("removed_notified")
    )


def run_summary(decisions: DataFrame, outcomes: tuple[str, ...] = ("green", "yellow", "duplicate", "denied")) -> DataFrame:
    """Per run, what was decided."""
    return decisions.groupBy("run_id").agg(F.count("*").alias("seen"), *[F.count_if(F.col("decision") == x).alias(x) for x in outcomes])


def aggregator_warnings(listing: DataFrame, threshold: int = 10) -> DataFrame:
    """Boards that list many companies, with the first three names."""
    names = listing.where(F.trim("company_name") != "").groupBy("provider", "company_slug", F.lower("company_name").alias("low")).agg(F.min(F.struct("external_id", "company_name")).alias("first"))
    many = names.groupBy("provider", "company_slug").agg(F.count("*").alias("companies")).where(F.col("companies") > threshold)
    # A ranking keeps three names of a board; no board's names are gathered.
    turn = F.row_number().over(Window.partitionBy("provider", "company_slug").orderBy("first"))
    three = names.withColumn("__n", turn).where("__n <= 3").groupBy("provider", "company_slug").agg(F.array_sort(F.collect_list(F.struct("__n", "first.company_name"))).alias("x"))
    return many.join(three, ["provider", "company_slug"]).select("provider", "company_slug", "companies", F.col("x.company_name").alias("sample"))


#: Registers of a sketch, as a power of two, and how far beside the threshold an estimate is not trusted (several times its error).
SKETCH_SIZE, SKETCH_DOUBT = 12, 0.2


def company_sketches(listing: DataFrame, day: str) -> DataFrame:
    """A sketch of a board's company names per day (provider, company_slug, day, names): small, mergeable, to be kept."""
    named = listing.where(F.trim("company_name") != "")
    return named.groupBy("provider", "company_slug", F.col(day).alias("day")).agg(F.hll_sketch_agg(F.lower("company_name"), F.lit(SKETCH_SIZE)).alias("names"))


def sketched_warnings(sketches: DataFrame, listing: DataFrame, threshold: int = 10) -> DataFrame:
    """Boards (provider, company_slug, companies, exact) that list more companies than the threshold over the days of the sketches.

    Sketches of a board are merged, whatever the number of its rows. Boards whose estimate lies near the threshold are counted
    exactly, so the verdicts are those of the exact count; listing holds the rows behind the sketches.
    """
    key = ["provider", "company_slug"]
    merged = sketches.groupBy(*key).agg(F.hll_sketch_estimate(F.hll_union_agg("names")).alias("about"))
    near = merged.where(F.col("about").between(threshold * (1 - SKETCH_DOUBT), threshold * (1 + SKETCH_DOUBT) + 1))
    sure = merged.where(F.col("about") > threshold * (1 + SKETCH_DOUBT) + 1).select(*key, F.col("about").alias("companies"), F.lit(False).alias("exact"))
    rows = listing.where(F.trim("company_name") != "").join(near.select(*key), key, "left_semi")
    counted = rows.groupBy(*key).agg(F.count_distinct(F.lower("company_name")).alias("companies")).where(F.col("companies") > threshold)
    return sure.unionByName(counted.withColumn("exact", F.lit(True)))


#: Characters after which a reason's slugs are no longer shown, and of the whole text at most.
ISSUE_CHARS, ISSUES_CHARS = 220, 1000


def issue_list(failures: DataFrame, limit: int = ISSUE_CHARS) -> DataFrame:
    """Failed boards (slug, reason) by reason: n, and their slugs in order until `limit` characters are shown, `(+k)` for the rest."""
    per = failures.groupBy("reason").agg(F.count("*").alias("n"))
    # Slugs have a character at least, so so many of them fill the limit.
    turn = F.row_number().over(Window.partitionBy("reason").orderBy("slug"))
    first = failures.withColumn("__n", turn).where(F.col("__n") <= limit).groupBy("reason").agg(F.array_sort(F.collect_list(F.struct("__n", "slug"))).alias("x"))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("kept"))

    def add(acc: Column, x: Column) -> Column:
        room = F.length(acc["text"]) < limit
        longer = F.when(acc["kept"] == 0, x["slug"]).otherwise(F.concat(acc["text"], F.lit(", "), x["slug"]))
        return F.struct(F.when(room, longer).otherwise(acc["text"]).alias("text"), (acc["kept"] + F.when(room, 1).otherwise(0)).alias("kept"))

    rows = per.join(first, "reason").withColumn("cut", F.aggregate("x", start, add))
    more = F.col("n") - F.col("cut.kept")
    return rows.select("reason", "n", F.concat(F.col("cut.text"), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise("")).alias("slugs"))


def issue_text(failures: DataFrame, limit: int = ISSUES_CHARS, shown: int = ISSUE_CHARS) -> DataFrame:
    """One row with the issues as lines, most frequent reason first, `limit` characters at most; `none` without failures.

    shown: characters of a reason's slugs (see issue_list); at `limit` or more no line is cut but by the end of the text.
    """
    line = F.concat(F.lit("**"), F.col("reason"), F.lit(" ×"), F.col("n").cast("string"), F.lit("**: "), F.col("slugs"))
    # A line has more than ten characters: a hundred of them fill the text.
    lines = issue_list(failures, shown).orderBy(F.desc("n"), "reason").limit(limit // 10).select((-F.col("n")).alias("k"), "reason", line.alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "reason", "line"))), lambda x: x["line"]), "\n")
    shown = F.when(F.length("text") > limit, F.concat(F.substring("text", 1, limit - 1), F.lit("…"))).otherwise(F.col("text"))
    return lines.agg(text.alias("text")).select(F.when(F.col("text") == "", "none").otherwise(shown).alias("text"))


def progress(outcomes: DataFrame, companies: DataFrame, bucket: str = "provider") -> DataFrame:
    """Scanned and total boards per bucket, and the share in whole percent."""
    done = outcomes.select("provider", "slug").distinct().withColumn("__done", F.lit(1))
    joined = companies.join(done, ["provider", "slug"], "left")
    return joined.groupBy(bucket).agg(F.count("__done").alias("scanned"), F.count("*").alias("total"), F.floor(F.count("__done") * 100 / F.count("*")).alias("percent"))


def last_drafted(outreach: DataFrame) -> DataFrame:
    """G12."""
    return outreach.groupBy("recruiter_email", "profile_id").agg(F.max("drafted_at").alias("last_drafted_at"))


def campaign_stats(records: DataFrame, now: Column) -> DataFrame:
    """Per profile the last batch, its bounce rate, drafts ever, and both gates."""
    real = records.where("status <> 'skipped_invalid'")
    last = real.groupBy("profile_id").agg(F.max("batch").alias("batch"), F.max("at").alias("newest"), F.count("*").alias("drafted_ever"))
    rate = real.join(last.select("profile_id", "batch"), ["profile_id", "batch"]).groupBy("profile_id").agg((F.avg((F.col("status") == "bounced").cast("int")) * 100).alias("bounce_pct"))
    return last.join(rate, "profile_id").select("profile_id", "batch", "drafted_ever", "bounce_pct", (F.col("newest") > now - F.expr("INTERVAL 5 DAYS")).alias("same_week"), (F.col("bounce_pct") > 10).alias("bounced_out"))


def verify_counts(transitions: DataFrame) -> DataFrame:
    """G17."""
    return transitions.groupBy("status").agg(F.count("*").alias("n"))


def registry_sync_counts(before: DataFrame, after: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Synced, denied, pruned, invalid."""
    key = ["provider", "slug"]
    now = after.agg(F.count("*").alias("synced"), F.count_if(F.col("status") == "denied").alias("denied"))
    return now.join(before.join(after, key, "left_anti").agg(F.count("*").alias("pruned"))).join(quarantined.agg(F.count("*").alias("invalid")))


def board_churn(board_runs: DataFrame, last_n: int = 5, top: int = 10) -> DataFrame:
    """H1: boards that changed most in their last runs."""
    recent = retain_runs(board_runs, last_n)
    churn = recent.groupBy("provider", "company_slug").agg(F.sum(F.col("added") + F.col("removed")).alias("churn"))
    return churn.orderBy(F.col("churn").desc(), "provider", "company_slug").limit(top)


def retain_runs(board_runs: DataFrame, keep: int = 60) -> DataFrame:
    """H2, H3: the newest runs of each board."""
    order = Window.partitionBy("provider", "company_slug", "profile_id").orderBy(F.col("run_at").desc(), F.col("run_id").desc())
    return board_runs.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= keep).drop("__rn")


def went_quiet(companies: DataFrame, min_streak: int = 3) -> DataFrame:
    """H4: active boards that gave postings before and give none now."""
    rows = companies.where((F.col("status") == "active") & (F.col("zero_yield_streak") >= min_streak) & (F.col("postings_seen_total") > 0))
    return rows.select("provider", "slug", "zero_yield_streak", "postings_seen_total").orderBy(F.col("postings_seen_total").desc(), "provider", "slug")


def fetchable_companies(companies: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Active boards, and dormant ones not fetched for a week, of the three strategies."""
    due = (F.col("status") == "active") | ((F.col("status") == "dormant") & (F.col("last_fetched_at").isNull() | (F.col("last_fetched_at") <= now - F.expr(f"INTERVAL {days} DAYS"))))
    return companies.where(due & F.col("parsing_strategy").isin("api", "llm_scrape", "playwright")).orderBy("provider", "slug")


def fresh_links(cache: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Cache entries that are young and not empty."""
    return cache.where((F.col("cached_at") > now - F.expr(f"INTERVAL {hours} HOURS")) & (F.size("links") > 0))


def mark_run_duplicates(decisions: DataFrame, key: str = "notify_key") -> DataFrame:
    """H7: of roles with one identity the first (company, external_id) is notified, the rest are duplicates.

    Only what would be notified is ranked, by one map-side combined minimum per identity.
    """
    spot = ["company_name", "external_id", *[c for c in ("provider", "profile_id") if c in decisions.columns]]
    hot = F.col("decision").isin("green", "yellow")
    first = decisions.where(hot).groupBy(F.col(key).alias("__key")).agg(F.min(F.struct(*spot)).alias("__first"))
    joined = decisions.join(first, hot & decisions[key].eqNullSafe(first["__key"]), "left")
    return joined.withColumn("decision", F.when(hot & (F.struct(*spot) > F.col("__first")), "duplicate").otherwise(F.col("decision"))).drop("__key", "__first")


def interleave(df: DataFrame, group: str, order: str, buckets: int = 256) -> DataFrame:
    """H8: round robin over groups in the order they first appear, as (turn, group_first). `order` is a number.

    Rows are ranked within stretches of the order, so a group that holds most rows is still ranked by many tasks.
    """
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / buckets for i in range(1, buckets)], buckets * 10).alias("q")).first()["q"] or []
    bucket = F.size(F.filter(F.lit(sorted(set(cuts))) if cuts else F.array().cast("array<double>"), lambda e: e <= F.col(order)))
    placed = df.withColumn("__bucket", bucket)
    sizes = placed.groupBy(group, "__bucket").agg(F.count("*").alias("__n"), F.min(order).alias("__low"))
    # A row per group and stretch.
    own = Window.partitionBy(group)
    before = sizes.select(group, "__bucket", (F.sum("__n").over(own.orderBy("__bucket")) - F.col("__n")).alias("__before"), F.min("__low").over(own).alias("group_first"))
    rank = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(order))
    return placed.withColumn("__rank", rank).join(before, [group, "__bucket"]).withColumn("turn", F.col("__before") + F.col("__rank")).select(*df.columns, "turn", "group_first").orderBy("turn", "group_first")


def rotate_variants(pool: DataFrame, order: list[str], subjects: list[str], openers: list[str], offset: int = 0) -> DataFrame:
    """H9: subject and opener of the i-th row, counting on from what was drafted before."""
    pick = lambda items, k: F.element_at(F.array(*map(F.lit, items)), k.cast("int") + 1)
    placed = with_position(pool, order, "__i").withColumn("__i", F.col("__i") + offset)
    return placed.withColumn("subject", pick(subjects, F.pmod("__i", F.lit(len(subjects))))).withColumn("opener", pick(openers, F.pmod(F.floor(F.col("__i") / len(subjects)), F.lit(len(openers))))).drop("__i")


def take_batch(pool: DataFrame, order: list[str], limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """(the batch, one row with how many remain)."""
    batch = pool.orderBy(*order).limit(limit)
    return batch, pool.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("remaining"))


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Calls, tokens and share of cached prompt tokens per model, with a warning where caching is poor."""
    rolled = usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("cached_tokens").alias("cached_tokens"))
    pct = F.floor(F.col("cached_tokens") * 100 / F.when(F.col("prompt_tokens") > 0, F.col("prompt_tokens")))
    return rolled.withColumn("cached_pct", F.coalesce(pct, F.lit(0))).withColumn("low_hit", (F.col("calls") >= 50) & (F.col("cached_pct") < 50))


# Words of pages that stand where a description should, tags that are left of markup, sizes at which vendors cut pages.
_ERROR_PAGE = r"(?i)access denied|request unsuccessful|are you a human|captcha|enable javascript|page not found|error 404|session expired|temporarily unavailable|pardon our interruption"
_TAG = r"(?i)</?[a-z][a-z0-9-]*[\s/>]"
PAGE_SIZES = (10, 20, 25, 30, 50, 100)


def diagnose_boards(postings: DataFrame, thin: int = 300, region: str | None = None, page_sizes: tuple[int, ...] = PAGE_SIZES) -> DataFrame:
    """Per board what is missing, doubled, thin, left of markup, an error page or the title again, and whether first, middle and last texts are one.

    The samples are taken, by id, of what is in the region (a pattern of places), remote or without a place, where a board has
    such postings. round_count: as many postings as a page has, or whole hundreds from 200 on, so that pages may be missing. The
    three sample ids come from an aggregation over ids alone; texts are read once and never sorted.
    """
    board = ["provider", "company_slug"]
    absent = {c: t for c, t in (("job_url", "string"), ("posted_at", "timestamp"), ("is_remote", "boolean")) if c not in postings.columns}
    postings = postings.withColumns({c: F.lit(None).cast(t) for c, t in absent.items()})
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    here = F.coalesce(F.col("location").rlike(region), F.lit(False)) if region else F.lit(False)
    near = here | blank("location") | F.coalesce("is_remote", F.lit(False))
    pool = postings.where("external_id <> ''").groupBy(*board, "external_id").agg(F.bool_or(near).alias("near"))
    ids = pool.withColumn("__any", F.bool_or("near").over(Window.partitionBy(*board))).where("near OR NOT __any")
    middle = ids.groupBy(*board).agg(F.min("external_id").alias("first"), F.max("external_id").alias("last"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*board).orderBy("external_id"))
    half = ids.withColumn("__rank", rank).join(middle.select(*board, "n"), board).where(F.col("__rank") == F.floor(F.col("n") / 2) + 1).select(*board, F.col("external_id").alias("half"))
    three = middle.join(half, board).select(*board, F.array("first", "half", "last").alias("__three"))
    text = F.trim(F.coalesce("jd_text", F.lit("")))
    jd = F.length(text)
    chosen = F.array_contains(F.coalesce("__three", F.array().cast("array<string>")), F.coalesce("external_id", F.lit(""))) & (jd > 0)
    rows = postings.join(F.broadcast(three), board, "left") if _few(three) else postings.join(three, board, "left")
    rows = rows.withColumn("__sample", F.when(chosen, F.md5(text)))
    tags = F.size(F.regexp_extract_all("jd_text", F.lit(_TAG), F.lit(0)))
    counted = rows.groupBy(*board).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce("external_id", F.lit("")) == "").alias("missing_ids"), F.count(F.nullif("external_id", F.lit(""))).alias("__ids"), F.count_if(F.coalesce("job_url", F.lit("")) == "").alias("missing_urls"),
        F.count_if(blank("job_title")).alias("missing_titles"), F.count_if(F.coalesce("location", F.lit("")) == "").alias("null_locations"), F.count_if(F.col("posted_at").isNull()).alias("null_dates"), F.count_if(here).alias("in_region"),
        F.count_if(jd == 0).alias("empty_jd"), F.count_if((jd > 0) & (jd < thin)).alias("thin_jd"), F.count_if(F.coalesce(tags, F.lit(0)) > 3).alias("html_residue"),
        F.count_if(F.substring(text, 1, 600).rlike(_ERROR_PAGE)).alias("error_pages"), F.count_if((jd > 0) & (F.lower(text) == F.lower(F.trim("job_title")))).alias("title_only"),
        F.min("__sample").alias("__least"), F.max("__sample").alias("__most"), F.count_distinct(F.when(F.col("__sample").isNotNull(), F.col("external_id"))).alias("__samples"),
    )
    once = postings.where("external_id <> ''").groupBy(*board).agg(F.count_distinct("external_id").alias("__distinct"))
    identical = (F.col("__samples") >= 2) & F.coalesce(F.col("__least") == F.col("__most"), F.lit(False))
    round_count = F.col("n").isin(*page_sizes) | ((F.col("n") >= 200) & (F.col("n") % 100 == 0))
    out = counted.join(once, counted["provider"].eqNullSafe(once["provider"]) & counted["company_slug"].eqNullSafe(once["company_slug"]), "left").drop(once["provider"], once["company_slug"])
    counts = ("missing_ids", "missing_urls", "missing_titles", "null_locations", "null_dates", "in_region", "empty_jd", "thin_jd", "html_residue", "error_pages", "title_only")
    return out.select(*board, "n", (F.col("__ids") - F.coalesce("__distinct", F.lit(0))).alias("duplicate_ids"), *counts, round_count.alias("round_count"), identical.alias("identical_samples"))


def _few(boards: DataFrame, most: int = 100_000) -> bool:
    """Whether a table has so few rows that it may be broadcast."""
    return boards.limit(most + 1).count() <= most
