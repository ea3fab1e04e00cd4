"""Gate responses, prompts, the scorer hook and the decision funnel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from feedloom.functions.filters import Profile, check_location, check_title, classify_verdict, is_junk_jd, late_location, stated_yoe_min
from feedloom.functions.text import compile_template, notify_key
from feedloom.operators.lifecycle import PK, first_per_key
from feedloom.operators.reports import mark_run_duplicates, with_known_state

#: Batches of postings in, batches of GATE rows out.
Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
GATE = "provider string, external_id string, profile_id string, match_score double, deal_breaker_hit string, deal_breaker_severity string, reason string, yoe_min double, yoe_max double, gate_error string"


def build_prompts(postings: DataFrame, template: str, chars: int = 18_000, **values: str) -> DataFrame:
    """A prompt per posting, the description cut to fit."""
    known = {k: F.lit(v) for k, v in values.items()}
    prompt = compile_template(template, jobTitle=F.coalesce("job_title", F.lit("(unknown)")), companyName=F.coalesce("company_name", F.lit("(unknown)")), jdText=F.substring("jd_text", 1, chars), **known)
    return postings.select(*PK, prompt.alias("prompt"))


def parse_gate(responses: DataFrame) -> DataFrame:
    """Responses (PK, raw) to gate columns; hit and severity made coherent, a reason found, bad ones flagged gate_error."""
    v = F.try_parse_json("raw")
    text = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    kind = lambda k: F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
    is_text, is_number = lambda k: kind(k) == "STRING", lambda k: kind(k).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    blank = lambda k: F.when(~(is_text(k) & text(k).isin("", "none", "null")) & (kind(k) != "VOID"), text(k))
    hit, severity = blank("dealBreakerHit"), blank("dealBreakerSeverity")
    score = F.try_variant_get(v, "$.matchScore", "double")
    said = lambda k: F.when(is_text(k) & (text(k) != ""), text(k))
    number = F.when(is_number("matchScore"), score)
    reason = F.coalesce(said("reason"), F.substring(said("analysis"), 1, 200), F.concat(F.lit("auto: matchScore "), F.coalesce(F.format_string("%.2f", number), F.lit("?"))))
    coherent = F.when(hit.isNotNull(), F.coalesce(severity, F.lit("soft")))
    valid = F.coalesce(number.between(0, 1), F.lit(False)) & F.coalesce(coherent.isin("hard", "soft"), F.lit(True))
    # What is there must be of its kind: texts are no numbers, and numbers no texts.
    valid = valid & (hit.isNull() | is_text("dealBreakerHit")) & (coherent.isNull() | severity.isNull() | is_text("dealBreakerSeverity")) & F.coalesce(is_text("analysis"), F.lit(True))
    for part in ("skillsMatch", "domainFit", "seniorityFit", "roleTypeMatch"):
        valid = valid & (kind(part).isNull() | (is_number(part) & F.coalesce(F.try_variant_get(v, f"$.{part}", "double").between(0, 1), F.lit(False))))
    valid = F.coalesce(valid, F.lit(False))
    keep = lambda c: F.when(valid, c)
    return responses.select(*PK, keep(score).alias("match_score"), keep(hit).alias("deal_breaker_hit"), keep(coherent).alias("deal_breaker_severity"), keep(reason).alias("reason"), F.when(~valid, "gate output failed schema validation").alias("gate_error"))


def parse_extract(responses: DataFrame) -> DataFrame:
    """Stated experience; numbers in quotes count, placeholders are null."""
    v = F.try_parse_json("raw")
    number = lambda k: F.try_variant_get(v, f"$.{k}", "string").try_cast("double")
    return responses.select(*PK, number("yoeMin").alias("yoe_min"), number("yoeMax").alias("yoe_max"))


def score(df: DataFrame, fn: Scorer, schema: str = GATE) -> DataFrame:
    """E5: a user's scorer over batches of postings."""
    return df.mapInPandas(fn, schema)


#: GATE with the posting's place among its partition's rows, as a table function returns it.
SCORED = T.StructType([
    *[T.StructField(c, T.StringType()) for c in PK], T.StructField("match_score", T.DoubleType()), *[T.StructField(c, T.StringType()) for c in ("deal_breaker_hit", "deal_breaker_severity", "reason")],
    T.StructField("yoe_min", T.DoubleType()), T.StructField("yoe_max", T.DoubleType()), T.StructField("gate_error", T.StringType()), T.StructField("nth", T.LongType()),
])


def scoring_function(fn: Scorer, rows: int = 1000, most: int | None = None):
    """A scorer as a table function for SQL, to be registered by spark.udtf.register(name, scoring_function(...)).

        SELECT * FROM score(TABLE(postings) PARTITION BY (provider, company_slug) ORDER BY external_id)

    It takes any table that has PK, job_title and jd_text, and says so when one of them is missing. Postings of a partition go to
    the scorer in their order, `rows` at a time, and no batch mixes partitions; beyond `most` of a partition they are not
    scored, and say why.
    """

    class Score:
        @staticmethod
        def analyze(postings: AnalyzeArgument) -> AnalyzeResult:
            if not postings.isTable:
                raise ValueError("a table of postings is asked for")
            if missing := sorted({*PK, "job_title", "jd_text"} - set(postings.dataType.names)):
                raise ValueError(f"postings lack {', '.join(missing)}")
            return AnalyzeResult(schema=SCORED)

        def __init__(self):
            self.waiting, self.seen = [], 0

        def eval(self, row):
            self.seen += 1
            if most is not None and self.seen > most:
                yield *(row[c] for c in PK), None, None, None, None, None, None, f"beyond the first {most}", self.seen
                return
            self.waiting.append(row.asDict())
            if len(self.waiting) >= rows:
                yield from self.scored()

        def terminate(self):
            yield from self.scored()

        def scored(self):
            if self.waiting:
                asked, self.waiting = pd.DataFrame(self.waiting), []
                # The scorer may give rows in another order, or fewer.
                at = {tuple(k): i for i, k in enumerate(asked[PK].itertuples(index=False, name=None), min(self.seen, most or self.seen) - len(asked) + 1)}
                for told in fn(iter([asked])):
                    told = told.astype(object).where(told.notna(), None)
                    for r in told[[f.name for f in SCORED][:-1]].itertuples(index=False, name=None):
                        yield *r, at[r[:3]]

    return udtf(Score)


def keyword_scorer(words: dict[str, float]) -> Scorer:
    """E5: a deterministic scorer for tests: the weights of the words that a description holds, 1 at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = (b["job_title"].fillna("") + " " + b["jd_text"].fillna("")).str.lower()
            total = sum((text.str.contains(w, regex=False) * x for w, x in words.items()), pd.Series(0.0, index=b.index)).clip(upper=1.0)
            yield pd.DataFrame({"provider": b["provider"], "external_id": b["external_id"], "profile_id": b["profile_id"], "match_score": total, "deal_breaker_hit": None, "deal_breaker_severity": None, "reason": "keywords", "yoe_min": None, "yoe_max": None, "gate_error": None})

    return run


def decide(listing: DataFrame, postings: DataFrame, prior_keys: DataFrame, profile: Profile, scorer: Scorer, now, no_jd_days: int = 7, gate_minutes: int = 60) -> DataFrame:
    """One decision per listed posting, in the order of the funnel; only what passes the cheap tests is scored."""
    once = first_per_key(listing, PK, "job_url")
    known = with_known_state(once, postings)
    known = known.withColumn("notify_key", notify_key(F.col("company_name"), F.col("job_title"), F.col("location")))
    known = known.join(prior_keys.select("notify_key").distinct().withColumn("__prior", F.lit(True)), "notify_key", "left")
    placed = (F.coalesce(F.col("location"), F.lit("")) != "") & ~check_location(F.col("location"), F.col("is_remote"), profile)["accept"]
    wait = F.when(F.col("known_stage") == "gate-error", F.expr(f"INTERVAL {gate_minutes} MINUTES")).otherwise(F.expr(f"INTERVAL {no_jd_days * 1440} MINUTES"))
    due = F.coalesce(F.col("known_stage").isin("no-jd", "gate-error"), F.lit(False)) & (F.col("jd_state_at") < now - wait)
    title = check_title(F.col("job_title"), profile.title_deny)
    late = late_location(F.col("location"), F.col("is_remote"), F.col("job_title"), F.col("jd_text"), F.col("job_url"), profile)
    years = stated_yoe_min(F.col("jd_text"))
    early = (
        F.when(placed, "location").when(F.col("known") & ~due, "known").when(F.col("__prior"), "prior-duplicate").when(title["skip"], "title-deny")
        .when(F.col("jd_text").isNull(), "jd-missing").when(~late["accept"], "late-location").when(F.col("jd_text") == "", "no-jd").when(is_junk_jd(F.col("jd_text")), "junk-jd")
        .when(years >= profile.hard_yoe_cap, "yoe-deny")
    )
    staged = known.withColumn("early", early)
    scored = score(staged.where("early IS NULL").select(*PK, "job_title", "company_name", "jd_text"), scorer)
    joined = staged.join(scored, PK, "left")
    verdict = classify_verdict(profile)
    decision = F.coalesce("early", F.when(F.col("gate_error").isNotNull() | F.col("match_score").isNull(), "gate-error").when(F.col("deal_breaker_severity") == "hard", "hard-deal-breaker").otherwise(verdict["severity"]))
    why = F.when(F.col("early").isNull(), F.coalesce("gate_error", verdict["reason"]))
    out = joined.withColumn("decision", decision).withColumn("verdict_reason", why)
    return mark_run_duplicates(out).select(*PK, "company_slug", "company_name", "job_title", "job_url", "location", "notify_key", "decision", "verdict_reason", "match_score", "yoe_min", "yoe_max")
