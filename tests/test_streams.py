"""Streams with state against plain folds, under different splits of their input."""

import glob
import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from feedloom.functions import filters
from feedloom.operators import decide, normalise, reports
from feedloom.plans.tables import scratch
from feedloom.sources import readers
from feedloom.sources.payload_source import PayloadSource
from feedloom.streaming import feed, health, mail

START = datetime(2024, 3, 1)
OUTCOMES = "provider string, slug string, at timestamp, seq long, seen long, error string, transport_fault boolean"


def outcomes(seed, boards=6, n=18):
    rng = random.Random(seed)
    rows = []
    for b in range(boards):
        for i in range(n):
            at = START + timedelta(minutes=rng.choice([rng.randrange(0, 20000), 1440 * rng.randrange(12)]))
            kind = rng.choice(["some", "none", "none", "failed", "failed", "fault"])
            rows.append(("p", f"b{b}", at, b * 1000 + i, {"some": 3, "none": rng.choice([0, None])}.get(kind), {"failed": "x" * 600, "fault": "down"}.get(kind), kind == "fault"))
    # Repeated times are told apart by their number.
    return rows + [("p", "b0", rows[0][2], 5000 + k, 0, None, None) for k in range(3)]


def settled(rows, begin, end):
    """Each board's health by the rules of successes, failures, faults and daily sweeps."""
    day = lambda x: (x - datetime(2000, 1, 1)).days
    out = {}
    for slug in {r[1] for r in rows}:
        h = dict(begin.get(slug, {"status": "active", "strategy": None, "failures": 0, "streak": 0}), total=0, error=None, ok=None, last=None)
        risk = lambda h=h: h["status"] == "active" and h["strategy"] == "llm_scrape" and h["streak"] >= 3
        for _, _, at, _, seen, error, fault in sorted((r for r in rows if r[1] == slug), key=lambda r: (r[2], r[3])):
            if h["last"] and day(h["last"]) < day(at) and risk():
                h["status"] = "dormant"
            h["last"] = at
            if error is None:
                h.update(ok=at, error=None, failures=0, total=h["total"] + (seen or 0), streak=0 if seen else h["streak"] + 1)
                if seen and h["status"] == "dormant":
                    h["status"] = "active"
            else:
                h["error"] = error[:500]
                if not fault:
                    h["failures"] += 1
                    if h["failures"] >= 5:
                        h["status"] = "broken"
        if day(h["last"]) < day(end) and risk():
            h["status"] = "dormant"
        out[slug] = (h["status"], h["failures"], h["streak"], h["total"], h["error"], h["ok"], h["last"])
    return out


@pytest.mark.parametrize("arrivals", [1, 4])
def test_health_does_not_depend_on_batches(spark, arrivals):
    rows, rng = outcomes(arrivals), random.Random(9)
    begin = {"b0": {"status": "active", "strategy": "llm_scrape", "failures": 0, "streak": 2}, "b1": {"status": "dormant", "strategy": "llm_scrape", "failures": 3, "streak": 0}, "b2": {"status": "broken", "strategy": "api", "failures": 7, "streak": 1}, "b3": {"status": "active", "strategy": "llm_scrape", "failures": 0, "streak": 0}}
    boards = spark.createDataFrame([("p", s, b["status"], b["strategy"], b["failures"], b["streak"]) for s, b in begin.items()], "provider string, slug string, status string, parsing_strategy string, consecutive_failures long, zero_yield_streak long")
    root = scratch(spark, "health-test")
    # Out of order by up to 20 hours, which is less than what may be late.
    batches = [[] for _ in range(arrivals)]
    for r in rows:
        moved = (r[2] - START).total_seconds() + rng.randrange(72000)
        batches[min(arrivals - 1, int(moved // (20000 * 60 / arrivals + 1)))].append(r)
    end = max(r[2] for r in rows) + timedelta(days=4)
    batches.append([("p", "end", end, 0, 0, None, None)])
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, OUTCOMES).coalesce(1).write.parquet(f"{root}/in/n={i}")
        stream = spark.readStream.schema(OUTCOMES).parquet(f"{root}/in/*")
        with health.rocksdb_state(spark):
            health.health_stream(stream, boards, health.Rules(scraped=("llm_scrape",))).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    told = spark.read.parquet(f"{root}/out").where("slug <> 'end'").groupBy("slug").agg(F.max_by(F.struct("status", "consecutive_failures", "zero_yield_streak", "postings_seen_total", "last_error", "last_success_at", "last_fetched_at"), F.col("at")).alias("s"))
    assert {r["slug"]: tuple(r["s"]) for r in told.collect()} == settled(rows, begin, end - timedelta(days=1))


# The feed

SPEC = normalise.JsonSpec("jobs array<struct<id:string,title:string>>", "jobs", {"external_id": "item.id", "job_title": "item.title", "job_url": "concat('u/', item.id)", "location": "'Pune'"})
PAGES = "provider string, slug string, url string, fetched_at timestamp, html string"
PROFILE = filters.Profile(cities=("Pune",), countries=(), remote=(), reject=(), reject_regions=(), title_deny=("^no",), never_silence=(), noise_slugs={}, slug_fragments=(), name_patterns=())


def the_feed(root):
    return feed.Feed(f"{root}/feed", PROFILE, decide.keyword_scorer({"spark": 0.9}), lambda raw: normalise.normalize_json(raw, SPEC, ("fetched_at",)), buckets=16)


def payload(slug, day, ids):
    body = json.dumps({"jobs": [{"id": i, "title": t} for i, t in ids]})
    return ("g", slug, 1, START + timedelta(days=day), None, "json", body)


def page(slug, url, day, text):
    return ("g", slug, url, START + timedelta(days=day), f'<script type="application/ld+json">{json.dumps({"@type": "JobPosting", "description": text})}</script>')


def arrive(spark, root, turn, payloads, pages):
    spark.createDataFrame(payloads, readers.PAYLOAD).coalesce(1).write.json(f"{root}/in/turn={turn}")
    spark.createDataFrame(pages, PAGES).coalesce(1).write.json(f"{root}/pages/turn={turn}")


def run(spark, root, own=None):
    own = own or the_feed(root)
    own.start(readers.stream_payloads(spark, f"{root}/in/*"), spark.readStream.schema(PAGES).json(f"{root}/pages/*")).awaitTermination()
    return own


def held(spark, own):
    names = ("company_slug", "external_id", "discovered_at", "last_seen_at", "removed_at", "jd_text", "decision", "decided_at")
    runs = ("company_slug", "run_at", "added", "removed", "unchanged")
    rows = lambda t, n: sorted(map(tuple, own.read(spark, t).select(*n).collect()), key=str)
    return rows("postings", names), rows("runs", runs)


ARRIVALS = [
    ([payload("a", 1, [("a1", "x"), ("a2", "no"), ("a3", "z")]), payload("b", 1, [("b1", "x")])], [page("a", "u/a1", 0, "spark work"), page("a", "u/a9", 0, "spark work"), page("a", "u/a1", 1, "")]),
    ([payload("a", 2, [("a1", "x"), ("a2", "no")]), payload("c", 2, [])], [page("a", "u/a3", 2, "none"), page("b", "u/b1", 2, "other work")]),
    ([payload("a", 3, [("a2", "no"), ("a3", "z"), ("a9", "n")]), payload("a", 1.5, [("late", "x")]), payload("b", 3, [])], [page("b", "u/b1", 3, "spark")]),
]


def day(n):
    return START + timedelta(days=n)


POSTINGS = sorted([
    ("a", "a1", day(1), day(2), day(3), None, None, None), ("a", "a2", day(1), day(3), None, None, "title-deny", day(1)),
    ("a", "a3", day(1), day(3), None, "none", "silent", day(2)), ("a", "a9", day(3), day(3), None, "spark work", "yellow", day(3)), ("b", "b1", day(1), day(1), day(3), "spark", "silent", day(2)),
], key=str)
RUNS = sorted([("a", day(1), 3, 0, 0), ("a", day(2), 0, 1, 2), ("a", day(3), 2, 1, 1), ("b", day(1), 1, 0, 0), ("b", day(3), 0, 1, 0), ("c", day(2), 0, 0, 0)], key=str)


def test_feed_follows_snapshots_and_details(spark):
    root = scratch(spark, "feed-test")
    for turn, (payloads, pages) in enumerate(ARRIVALS):
        arrive(spark, root, turn, payloads, pages)
        own = run(spark, root)
    assert held(spark, own) == (POSTINGS, RUNS)


def test_one_batch_gives_the_same_listing(spark):
    root = scratch(spark, "feed-test")
    for turn, (payloads, pages) in enumerate(ARRIVALS):
        arrive(spark, root, turn, [p for p in payloads if p[3] != day(1.5)], pages)
    postings, runs = held(spark, run(spark, root))
    assert [r[:5] for r in postings] == [r[:5] for r in POSTINGS] and runs == RUNS


def test_a_batch_that_was_killed_is_run_again(spark):
    """Killed while it is computed, then while its tables are put in place."""
    root = scratch(spark, "feed-test")
    for turn, (payloads, pages) in enumerate(ARRIVALS[:2]):
        arrive(spark, root, turn, payloads, pages)
    run(spark, root)
    arrive(spark, root, 2, *ARRIVALS[2])
    for step, after in (("_decided", 0), ("_place", 1)):
        killed, calls = the_feed(root), []

        def fail(*args, own=killed, calls=calls, step=step, after=after):
            calls.append(args)
            if len(calls) > after:
                raise RuntimeError("killed")
            return getattr(feed.Feed, step)(own, *args)

        object.__setattr__(killed, step, fail)
        with pytest.raises(StreamingQueryException):
            run(spark, root, killed)
    assert held(spark, run(spark, root)) == (POSTINGS, RUNS)


def files(root):
    return {p: os.stat(p).st_mtime_ns for t in ("postings", "details", "boards") for p in glob.glob(f"{root}/feed/{t}/bucket=*/*.parquet")}


def test_only_buckets_that_boards_arrive_for_are_written(spark):
    root = scratch(spark, "feed-test")
    many = [payload(f"s{i}", 1, [(f"j{i}", "x")]) for i in range(40)]
    arrive(spark, root, 0, many, [page(f"s{i}", f"u/j{i}", 1, "spark") for i in range(40)])
    run(spark, root)
    before = files(root)
    arrive(spark, root, 1, [payload("s7", 2, [("j7", "x"), ("new", "y")])], [])
    own = run(spark, root)
    after = files(root)
    where = lambda paths: {os.path.basename(os.path.dirname(p)) for p in paths}
    assert len(where(before)) > 8 and len(where(p for p in after if after[p] != before.get(p))) == 1
    assert len([p for p in before if before[p] == after.get(p)]) >= len(before) * 3 // 4
    assert own.read(spark, "postings").count() == 41


# Drafts and the mailbox


def test_drafts_meet_their_mail_and_state_goes(spark):
    rng, root = random.Random(4), scratch(spark, "mail-test")
    hour = timedelta(hours=1)
    drafts = [(i, rng.choice("abc") if i < 55 else f"q{i}", START + rng.randrange(0, 30 * 24) * hour) for i in range(60)]
    box = [(f"m{i}", rng.choice(["sent", "sent", "bounce", "other"]), rng.choice("abcd"), START + rng.randrange(0, 40 * 24) * hour, f"s{i}") for i in range(120)]
    # Mail at the draft's own time does not follow it; mail exactly 14 days later does, an hour later does not.
    drafts += [(100 + k, f"edge{k}", START + 48 * hour) for k in range(3)]
    box += [(f"e{k}", "sent", f"edge{k}", START + 48 * hour + k * 14 * 24 * hour + (k == 2) * hour * (1 - 14 * 24), "") for k in range(3)] + [("e9", "sent", "edge2", START + 49 * hour + 14 * 24 * hour, "")]
    end = START + timedelta(days=90)
    order = sorted([(d[2], 0, d) for d in drafts] + [(m[3], 1, m) for m in box], key=lambda x: x[0])
    for n in range(3):
        part = order[n * len(order) // 3 : (n + 1) * len(order) // 3]
        last = n == 2
        spark.createDataFrame([x for _, k, x in part if k == 0] + [(-1, "end", end)] * last, "id long, recruiter_email string, drafted_at timestamp").coalesce(1).write.parquet(f"{root}/drafts/n={n}")
        spark.createDataFrame([x for _, k, x in part if k == 1] + [("end", "sent", "end", end, "")] * last, mail.MAIL).coalesce(1).write.parquet(f"{root}/mail/n={n}")
        streams = (spark.readStream.schema(s).parquet(f"{root}/{d}/*") for d, s in (("drafts", "id long, recruiter_email string, drafted_at timestamp"), ("mail", mail.MAIL)))
        query = mail.follow_drafts(*streams).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    want = []
    for i, to, at in drafts:
        near = [m for m in box if m[2] == to and at < m[3] <= at + timedelta(days=14)]
        sent = max(((m[3], m[0]) for m in near if m[1] == "sent"), default=None)
        bounce = max(((m[3], m[0], m[4]) for m in near if m[1] == "bounce"), default=None)
        bad = sent and bounce and bounce[0] > sent[0]
        want.append((i, at, *(sent or (None, None)), bounce[0] if bad else None, bounce[2] if bad else None, "discarded" if not sent else "bounced" if bad else "verified"))
    got = sorted(map(tuple, spark.read.parquet(f"{root}/out").where("id >= 0").select("id", "drafted_at", "sent_at", "message_id", "bounced_at", "failure_detail", "status").collect()))
    assert got == sorted(want)
    # What is left are the two rows that ended the streams.
    assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) <= 4


# Payloads as a source


def test_payload_source_reads_boards_and_only_new_files(spark):
    root = scratch(spark, "payload-test")
    spark.dataSource.register(PayloadSource)

    def arrive(turn, boards):
        rows = [(p, s, turn, START + timedelta(days=turn), None, "json", f"é {turn} {p}{s}\nx") for p, s in boards]
        spark.createDataFrame(rows, readers.PAYLOAD.replace(": ", " ")).coalesce(1).write.mode("append").partitionBy("provider", "slug").json(f"{root}/in")

    def stream():
        spark.readStream.format("board_payloads").load(f"{root}/in").writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["provider"], r["slug"], r["page"]) for r in spark.read.parquet(f"{root}/out").collect())

    arrive(1, [("a", "x y"), ("a", "z"), ("b", "q/é")])
    assert stream() == [("a", "x y", 1), ("a", "z", 1), ("b", "q/é", 1)]
    arrive(2, [("a", "z"), ("c", "new")])
    assert stream() == [("a", "x y", 1), ("a", "z", 1), ("a", "z", 2), ("b", "q/é", 1), ("c", "new", 2)] == stream()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        whole = lambda: spark.read.format("board_payloads").load(f"{root}/in")
        got = {tuple(r) for r in whole().where("provider = 'b'").collect()}
        assert got == {("b", "q/é", 1, START + timedelta(days=1), None, "json", "é 1 bq/é\nx")}
        # A partition per board that is asked for; a filter on another column stays with Spark.
        parts = lambda df: df.rdd.getNumPartitions()
        assert [parts(whole()), parts(whole().where("provider = 'a'")), parts(whole().where("slug IN ('z', 'new')")), parts(whole().where("provider = 'a' AND slug = 'z' AND page = 2"))] == [4, 2, 2, 1]
        assert whole().where("slug IN ('z', 'new')").count() == 3 and whole().where("provider = 'a' AND slug = 'z' AND page = 2").count() == 1 and whole().where("provider = 'none'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_scorer_as_a_table_function(spark):
    columns = "provider string, external_id string, profile_id string, job_title string, jd_text string, more int"
    rows = [("p" if i < 7 else "q", f"{i:02d}", "u", "spark" if i % 2 else "x", None, i) for i in range(9)]
    spark.createDataFrame(rows, columns).createOrReplaceTempView("asked")
    spark.udtf.register("score_two", decide.scoring_function(decide.keyword_scorer({"spark": 0.9}), rows=2, most=5))
    got = spark.sql("SELECT * FROM score_two(TABLE(asked) PARTITION BY provider ORDER BY external_id DESC)").collect()
    want = {}
    for i in range(9):
        n = 7 - i if i < 7 else 9 - i
        want[f"{i:02d}"] = (n, None, "beyond the first 5") if n > 5 else (n, 0.9 if i % 2 else 0.0, None)
    assert {r["external_id"]: (r["nth"], r["match_score"], r["gate_error"]) for r in got} == want
    with pytest.raises(Exception, match="lack jd_text"):
        spark.sql("SELECT * FROM score_two(TABLE(SELECT provider, external_id, profile_id, job_title FROM asked))").collect()


def test_sketches_give_the_exact_verdicts(spark):
    rows = [("p", f"b{n}", f"Name {i % n}{' ' * (i % 2)}".strip() if i % 2 else f"NAME {i % n}", i % 4) for n in (1, 8, 9, 10, 11, 12, 13, 40, 3000) for i in range(2 * n + 2)] + [("p", "blank", " ", 0), ("p", "blank", None, 0)]
    listing = spark.createDataFrame(rows, "provider string, company_slug string, company_name string, day int")
    sketches = reports.company_sketches(listing, "day")
    got = {r["company_slug"]: (r["companies"], r["exact"]) for r in reports.sketched_warnings(sketches, listing).collect()}
    assert set(got) == {r["company_slug"] for r in reports.aggregator_warnings(listing.withColumn("external_id", F.lit("x"))).collect()} == {"b11", "b12", "b13", "b40", "b3000"}
    assert got["b11"] == (11, True) and not got["b3000"][1] and abs(got["b3000"][0] - 3000) < 300
