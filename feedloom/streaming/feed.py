"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from feedloom.functions.filters import Profile
from feedloom.operators import decide, normalise
from feedloom.operators.lifecycle import BOARD, PK
from feedloom.sources.readers import exists, read_table, remove, write_table


def _schema(strings: str, times: str = "", longs: str = "", **more: T.DataType) -> T.StructType:
    kinds = {c: kind for names, kind in ((strings, T.StringType()), (times, T.TimestampType()), (longs, T.LongType())) for c in names.split()} | more
    return T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])


#: The feed's tables. decision is null while a posting waits for its text.
POSTINGS = _schema(
    "provider company_slug external_id profile_id company_name job_title job_url location jd_text decision verdict_reason notify_key", "posted_at discovered_at last_seen_at removed_at decided_at",
    is_remote=T.BooleanType(), match_score=T.DoubleType(),
)
DETAILS = _schema("provider company_slug job_url title text place", "posted fetched_at", remote=T.BooleanType())
BOARDS = _schema("provider company_slug profile_id", "last_at", "listed")
RUNS = _schema("provider company_slug profile_id", "run_at", "added removed unchanged")
KEYS = _schema("notify_key", "notified_at")
TABLES = {"postings": POSTINGS, "details": DETAILS, "boards": BOARDS}


def stream_dedup(decisions: DataFrame, at: str = "ts", key: str = "notify_key", days: int = 180) -> DataFrame:
    """The first decision per role within the window; state older than the watermark goes."""
    return decisions.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark([key])


def stream_stats(decisions: DataFrame, width: str = "1 hour", at: str = "ts", late: str = "10 minutes", by: str = "decision") -> DataFrame:
    """Counts per tumbling window and decision."""
    counts = decisions.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n")


@dataclass(frozen=True)
class Feed:
    """Payload files and detail pages into postings with decisions, board by board.

    Boards are hashed to buckets, the partitions of the feed's tables. A batch reads and rewrites the buckets of the boards that
    it brings, and no others. It writes them beside the tables first, complete or not at all, and then puts them in place by
    dynamic partition overwrite: a batch that was stopped before that is computed again from tables it has not touched, one
    that was stopped later is only put in place again.

    Snapshots of a board count in the order of their fetch times, however they are dealt to batches; one that is not later than
    what the feed has seen of its board is ignored. A posting is discovered by the first snapshot that lists it, seen by the
    last, and removed at the first one that does not list it any more (I1-I3). Each snapshot leaves added, removed and unchanged
    counts (I4). The newest detail page of a url is kept until its posting comes, and replaces what the listing says wherever it
    says something (B7). A posting is decided once its text is known (E7), and what is notified stops its repetitions.
    """

    root: str
    profile: Profile
    scorer: decide.Scorer
    #: Payload pages (provider, slug, page, fetched_at, body) to postings with fetched_at.
    normalise: Callable[[DataFrame], DataFrame] = field(default=lambda raw: normalise.normalize_all(raw, carry=("fetched_at",))[0])
    profile_id: str = "p0"
    buckets: int = 64
    prior_days: int = 180

    def start(self, payloads: DataFrame, details: DataFrame | None = None) -> StreamingQuery:
        """payloads: provider, slug, page, fetched_at, body; details: provider, slug, url, fetched_at, html."""
        none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
        arrivals = payloads.select(F.lit("listing").alias("what"), "provider", "slug", F.col("page").cast("int").alias("page"), "fetched_at", "body", *none("url", "html"))
        if details is not None:
            arrivals = arrivals.unionByName(details.select(F.lit("detail").alias("what"), "provider", "slug", F.lit(None).cast("int").alias("page"), "fetched_at", *none("body"), "url", "html"))
        return arrivals.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start()

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """A table of the feed, or its logs: runs, keys."""
        schema, parts = (TABLES[name], "bucket int") if name in TABLES else ({"runs": RUNS, "keys": KEYS}[name], "batch int")
        return read_table(spark, f"{self.root}/{name}", schema, parts)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("provider", "company_slug"), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        staged = f"{self.root}/staged/batch={number}"
        if not exists(spark, f"{staged}/done/_SUCCESS"):
            self._stage(batch, number, staged)
        for name in TABLES:
            self._place(spark, f"{staged}/{name}", name)
        remove(spark, f"{self.root}/staged/batch={number - 1}")

    def _place(self, spark: SparkSession, path: str, name: str) -> None:
        """Put the buckets of a staged table in place of those of the feed's."""
        if exists(spark, f"{path}/_SUCCESS") and exists(spark, f"{path}/bucket=*"):
            write_table(read_table(spark, path, TABLES[name], "bucket int"), f"{self.root}/{name}", ("bucket",))

    def _stage(self, batch: DataFrame, number: int, staged: str) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            # At most `buckets` numbers.
            touched = [r[0] for r in batch.select("provider", F.col("slug").alias("company_slug")).select(self.bucket()).distinct().collect()]
            held = {n: self.read(spark, n).where(F.col("bucket").isin(touched)).drop("bucket") for n in TABLES}
            write = lambda df, name: df.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{staged}/{name}")

            news = self._details(batch.where("what = 'detail'"))
            write(self._newest(held["details"].unionByName(news)), "details")
            details = read_table(spark, f"{staged}/details", DETAILS, "bucket int").drop("bucket")
            snapshots = batch.where("what = 'listing'").select("provider", F.col("slug").alias("company_slug"), "fetched_at").distinct().join(held["boards"].select("provider", "company_slug", "last_at", "listed"), ["provider", "company_slug"], "left").where("last_at IS NULL OR fetched_at > last_at")
            pages = batch.where("what = 'listing'").join(snapshots.select("provider", F.col("company_slug").alias("slug"), "fetched_at"), ["provider", "slug", "fetched_at"], "left_semi")
            listed = self.normalise(pages.select("provider", "slug", "page", "fetched_at", F.lit(None).cast("long").alias("reported_total"), F.lit("json").alias("kind"), "body"))
            listed.write.mode("overwrite").parquet(f"{staged}/listed")
            listed = spark.read.schema(listed.schema).parquet(f"{staged}/listed").withColumn("profile_id", F.lit(self.profile_id))
            postings = self._seen(held["postings"], listed, snapshots)
            self._runs(held["postings"], listed, snapshots).write.mode("overwrite").parquet(f"{self.root}/runs/batch={number}")
            runs = spark.read.schema(RUNS).parquet(f"{self.root}/runs/batch={number}")
            present = runs.groupBy(*BOARD).agg(F.max("run_at").alias("last_at"), F.max_by(F.col("added") + F.col("unchanged"), "run_at").alias("listed"))
            write(held["boards"].join(runs, BOARD, "left_anti").select(BOARDS.names).unionByName(present.select(BOARDS.names)), "boards")
            urls = details.withColumnRenamed("fetched_at", "detail_at")
            known = normalise.apply_details(postings, urls, ("provider", "company_slug", "job_url"))
            clock = urls.select("provider", "company_slug", "job_url", "detail_at")
            decided = self._decided(known.join(clock, ["provider", "company_slug", "job_url"], "left"), number, staged)
            write(decided, "postings")
            spark.range(1).write.mode("overwrite").parquet(f"{staged}/done")
        finally:
            batch.unpersist()

    def _details(self, pages: DataFrame) -> DataFrame:
        """Detail pages read; url stands for the page and its time while it is."""
        keyed = pages.select(F.to_json(F.struct("provider", "slug", "url", F.unix_micros("fetched_at").alias("us"))).alias("url"), "html")
        read = normalise.read_details(keyed)
        key = F.from_json("job_url", "provider string, slug string, url string, us long")
        named = read.withColumn("k", key).select("k.provider", F.col("k.slug").alias("company_slug"), F.col("k.url").alias("job_url"), "title", "text", "place", "posted", F.timestamp_micros("k.us").alias("fetched_at"), "remote")
        return named.select(DETAILS.names)

    @staticmethod
    def _newest(details: DataFrame) -> DataFrame:
        key = ["provider", "company_slug", "job_url"]
        rest = [c for c in DETAILS.names if c not in key]
        return details.groupBy(*key).agg(F.max(F.struct("fetched_at", *[c for c in rest if c != "fetched_at"])).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest]).select(DETAILS.names)

    def _seen(self, old: DataFrame, listed: DataFrame, snapshots: DataFrame) -> DataFrame:
        """Postings after the snapshots: those listed are seen, the others of the same boards removed."""
        content = ["job_title", "job_url", "location", "is_remote", "jd_text", "posted_at"]
        news = listed.groupBy(*PK, "company_slug").agg(F.min_by(F.struct(*content), "fetched_at").alias("__c"), F.min("fetched_at").alias("__first"), F.max("fetched_at").alias("__last"))
        times = snapshots.groupBy("provider", "company_slug").agg(F.array_sort(F.collect_set("fetched_at")).alias("__times"))
        joined = old.withColumn("__old", F.lit(True)).join(news, [*PK, "company_slug"], "full").join(times, ["provider", "company_slug"], "left")
        new, seen = F.col("__old").isNull(), F.col("__last").isNotNull()
        missed = F.try_element_at(F.filter("__times", lambda t: t > F.col("__last")), F.lit(1))
        first_missed = F.coalesce("removed_at", F.try_element_at("__times", F.lit(1)))
        changes = {c: F.when(new, F.col(f"__c.{c}")).otherwise(F.col(c)) for c in content} | {
            "company_name": F.coalesce("company_name", "company_slug"), "discovered_at": F.coalesce("discovered_at", "__first"),
            "last_seen_at": F.coalesce("__last", "last_seen_at"), "removed_at": F.when(seen, missed).otherwise(first_missed),
        }
        return joined.withColumns(changes).select(POSTINGS.names)

    def _runs(self, old: DataFrame, listed: DataFrame, snapshots: DataFrame) -> DataFrame:
        """I4 per snapshot: against the one before it, which may be the last of an earlier batch."""
        order = Window.partitionBy("provider", "company_slug").orderBy("fetched_at")
        counts = listed.groupBy("provider", "company_slug", "fetched_at").agg(F.count("*").alias("n"))
        shots = snapshots.join(counts, ["provider", "company_slug", "fetched_at"], "left").fillna(0, ["n"])
        shots = shots.select("provider", "company_slug", "fetched_at", "n", F.coalesce(F.lag("fetched_at").over(order), "last_at").alias("before"), F.coalesce(F.lag("n").over(order), "listed", F.lit(0)).alias("n_before"))
        present = listed.select("provider", "company_slug", "external_id", F.col("fetched_at").alias("before")).unionByName(old.where("removed_at IS NULL").select("provider", "company_slug", "external_id", F.col("last_seen_at").alias("before")))
        stayed = listed.select("provider", "company_slug", "external_id", "fetched_at").join(shots.select("provider", "company_slug", "fetched_at", "before"), ["provider", "company_slug", "fetched_at"]).join(present.distinct(), ["provider", "company_slug", "external_id", "before"], "left_semi")
        same = stayed.groupBy("provider", "company_slug", "fetched_at").agg(F.count("*").alias("unchanged"))
        all_ = shots.join(same, ["provider", "company_slug", "fetched_at"], "left").fillna(0, ["unchanged"])
        return all_.select("provider", "company_slug", F.lit(self.profile_id).alias("profile_id"), F.col("fetched_at").alias("run_at"), (F.col("n") - F.col("unchanged")).alias("added"), (F.col("n_before") - F.col("unchanged")).alias("removed"), "unchanged")

    def _decided(self, known: DataFrame, number: int, staged: str) -> DataFrame:
        """E7 for what waits: a posting without text waits on unless something else decides it."""
        spark = known.sparkSession
        known.write.mode("overwrite").parquet(f"{staged}/known")
        known = spark.read.schema(known.schema).parquet(f"{staged}/known")
        waiting = known.where("decision IS NULL")
        at = F.greatest("discovered_at", "detail_at")
        now = waiting.agg(F.coalesce(F.max(at), F.lit(0).cast("timestamp"))).first()[0]
        none = spark.createDataFrame([], T.StructType.fromDDL("provider string, external_id string, profile_id string, discovered_at timestamp, drop_stage string, jd_checked_at timestamp"))
        # Keys of earlier batches only, so that a batch that is computed again finds what it found.
        keys = self.read(spark, "keys").where(F.col("batch") < number)
        keys = keys.where(F.col("notified_at") >= F.lit(now) - F.expr(f"INTERVAL {self.prior_days} DAYS"))
        asked = waiting.select(*PK, "company_slug", "company_name", "job_title", "job_url", "location", "is_remote", "jd_text")
        fresh = decide.decide(asked, none, keys, self.profile, self.scorer, F.lit(now)).where("decision <> 'jd-missing'")
        told = fresh.select(*PK, *[F.col(c).alias(f"__{c}") for c in ("decision", "verdict_reason", "match_score", "notify_key")])
        out = known.join(told, PK, "left").withColumn("decided_at", F.when(F.col("__decision").isNotNull(), at).otherwise(F.col("decided_at")))
        out = out.withColumns({c: F.coalesce(c, f"__{c}") for c in ("decision", "verdict_reason", "match_score", "notify_key")})
        out.write.mode("overwrite").parquet(f"{staged}/decided")
        out = spark.read.schema(out.schema).parquet(f"{staged}/decided")
        hot = out.where(F.col("__decision").isin("green", "yellow"))
        hot.groupBy("notify_key").agg(F.max("decided_at").alias("notified_at")).write.mode("overwrite").parquet(f"{self.root}/keys/batch={number}")
        return out.select(POSTINGS.names)


def windowed_failures(events: DataFrame, at: str = "ts", width: str = "1 day", failed: Column | None = None) -> DataFrame:
    """I8 as a stream: fetches and failures per board and day."""
    bad = failed if failed is not None else F.col("status") == "error"
    return events.withWatermark(at, "1 hour").groupBy(F.window(at, width).alias("w"), "provider", "company_slug").agg(F.count("*").alias("fetches"), F.count_if(bad).alias("failures")).select(F.col("w.start").alias("day"), "provider", "company_slug", "fetches", "failures")
