"""URL filters: rules first, then naive Bayes over host names split into words.

A rule names a host and the start of a path; it fits that host and its subdomains; the longest that fits decides. Other
urls are judged by a multinomial naive Bayes over the words of host and path. Host names are split by a unigram model: word
counts come from the visible text of all pages and from the names in all hosts that hyphens set apart; every substring of a
distinct name is looked up by a join, and Viterbi picks the likeliest split.

The classifier learns from the pages themselves. A name that many hosts share (COMMON) says nothing. Of the others, a name
that strings set-apart words together of which no page's visible text has a single one is bait: hosts with such a name are the
examples to block. Hosts whose names are words that the texts use are the examples to allow; all other hosts teach nothing
and are only judged. Counts cover all pages. Scores are found once per distinct (host, path shape) and joined back; without
examples of both kinds nothing but the rules blocks.

Null urls and urls without `://` have an empty host and path, fit no rule and are judged by the prior alone; null html
counts as empty; repeated rows are judged alike; an empty table gives an empty result; other columns are carried along, and
get `_in` behind their name where a result has it. A run of more than LABEL letters cannot be a host's name and stays whole.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import saved, set_aside, spread_join

#: Letters of a host's label at most.
LABEL = 63
#: Names on more than this share of the hosts, and on so many hosts at least, are common.
COMMON, COMMON_HOSTS = 0.1, 10
#: Smoothing of the counts of a word.
SMOOTH = 1.0


@dataclass(frozen=True)
class Rule:
    """text: host, a slash and the start of the path, without the path's first slash."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


# The rules of the registered query.
RULES = (Rule("com/en/", "block"), Rule("example.com/en/7", "allow"), Rule("net/de/", "allow"), Rule("example.net/de/8", "block"), Rule("org/es/", "block"))


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: str, path: str, rules: tuple[Rule, ...]) -> Column:
    """Struct (text, verdict) of the longest rule that fits, or null."""
    fits = [F.when(((F.col(host) == r.host) | F.endswith(F.col(host), F.lit("." + r.host))) & F.startswith(F.col(path), F.lit(r.path)), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))) for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<text:string,verdict:string>")


def word_counts(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """word, n, used, apart: in the visible text of all pages (used) and in the hyphenated names of all hosts (apart); n is their sum.

    Host names within the text are no words of it.
    """
    visible = F.regexp_replace(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    visible = F.regexp_replace(F.lower(visible), r"[a-z0-9-]+(\.[a-z0-9-]+)+", " ")
    text = pages.select(F.explode(F.regexp_extract_all(visible, F.lit(r"[a-z]{2,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("used"))
    set_apart = hosts.select(F.explode(F.regexp_extract_all("host", F.lit(r"(?<=-)[a-z]+|[a-z]+(?=-)"), F.lit(0))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("apart"))
    both = text.select("word", "used", F.lit(0).cast("long").alias("apart")).unionByName(set_apart.select("word", F.lit(0).cast("long").alias("used"), "apart"))
    return both.groupBy("word").agg(F.sum("used").alias("used"), F.sum("apart").alias("apart")).withColumn("n", F.col("used") + F.col("apart"))


def _viterbi(total: float):
    def split(names: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for name, rows in zip(names, known, strict=True):
            cost = {r["piece"]: np.log(total / r["n"]) for r in rows}
            best = [(0.0, 0)]
            for i in range(1, len(name) + 1):
                # A word never seen costs ten times more with each letter.
                best.append(min((best[j][0] + cost.get(name[j:i], np.log(total) + 2.3 * (i - j)), j) for j in range(i)))
            words, i = [], len(name)
            while i:
                words.append(name[best[i][1] : i])
                i = best[i][1]
            out.append(words[::-1])
        return pd.Series(out)

    return F.pandas_udf(split, "array<string>")


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name, words for distinct names of a-z: LABEL letters at most, so some 2000 substrings of a name, are looked up."""
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    long = names.where(F.char_length("name") > LABEL).select("name", F.array("name").alias("words"))
    names = names.where(F.char_length("name") <= LABEL)
    starts = F.explode(F.sequence(F.lit(1), F.char_length("name"))).alias("i")
    pieces = names.select("name", starts).select("name", "i", F.explode(F.sequence(F.lit(1), F.char_length("name") - F.col("i") + 1)).alias("k"))
    pieces = pieces.select("name", F.expr("substring(name, i, k)").alias("piece")).distinct()
    known = pieces.join(counts.select(F.col("word").alias("piece"), "n"), "piece").groupBy("name").agg(F.collect_list(F.struct("piece", "n")).alias("known"))
    joined = names.join(known, "name", "left")
    empty = F.array().cast(known.schema["known"].dataType)
    return joined.select("name", _viterbi(total)("name", F.coalesce("known", empty)).alias("words")).unionByName(long)


def name_kinds(names: DataFrame, split: DataFrame, counts: DataFrame, hosts: int) -> DataFrame:
    """name, words, kind: `bait`, `plain` (the texts use its words) or null, for each distinct name of names (host, name)."""
    common = names.groupBy("name").agg(F.count("*").alias("hosts")).where((F.col("hosts") > COMMON * hosts) & (F.col("hosts") >= COMMON_HOSTS)).select("name", F.lit(True).alias("common"))
    words = split.select("name", F.explode("words").alias("word"))
    of = words.join(counts, "word", "left").groupBy("name").agg(
        F.max(F.coalesce(F.col("used") > 0, F.lit(False))).alias("used"), F.min(F.coalesce(F.col("used") > 0, F.lit(False))).alias("all_used"), F.min(F.coalesce(F.col("apart") > 0, F.lit(False))).alias("apart")
    )
    kind = F.when(F.col("common"), None).when(F.col("all_used"), "plain").when(~F.col("used") & F.col("apart"), "bait")
    return split.join(of, "name", "left").join(common, "name", "left").select("name", "words", kind.alias("kind"))


RESULTS = ("host", "path", "rule", "verdict", "spam_score")


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", html: str = "html") -> DataFrame:
    """pages, without their html, with host, path, rule, verdict and spam_score (log odds of block)."""
    pages = set_aside(pages, RESULTS)
    body = pages.select(F.col(html).alias("html") if html in pages.columns else F.lit("").alias("html"))
    host, path = host_of(F.col(url)), path_of(F.col(url))
    placed = pages.drop(html).withColumn("host", host).withColumn("path", path)
    placed = placed.withColumn("__shape", F.regexp_replace(F.lower("path"), r"\d+", "0"))
    kinds = saved(placed.groupBy("host", F.col("__shape").alias("shape")).agg(F.count("*").alias("n")), "kinds")
    hosts = saved(kinds.groupBy("host").agg(F.sum("n").alias("n")), "hosts")
    names = saved(hosts.select("host", F.explode(F.array_distinct(F.regexp_extract_all("host", F.lit(r"[a-z]+(?:-[a-z]+)*"), F.lit(0)))).alias("name")), "names")
    # A name is a run of words between dots or digits; its parts between hyphens are split further.
    counts = saved(word_counts(body, hosts), "words")
    parts = names.select("name").distinct().select("name", F.posexplode(F.split("name", "-")).alias("at", "part"))
    parts = saved(parts, "parts")
    split = segmented(parts.select(F.col("part").alias("name")).distinct(), counts).withColumnRenamed("name", "part")
    joined = parts.join(split, "part").groupBy("name").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    named = saved(name_kinds(names, saved(joined, "split"), counts, hosts.count()), "named")
    of_host = spread_join(names, named, ["name"], ["host"]).groupBy("host").agg(
        F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"), F.max(F.coalesce(F.col("kind") == "bait", F.lit(False))).alias("bait"), F.max(F.coalesce(F.col("kind") == "plain", F.lit(False))).alias("plain")
    )
    label = F.when(F.col("bait"), 1).when(F.col("plain"), 0)
    shown = spread_join(kinds, of_host.select("host", "words", label.alias("bad")), ["host"], ["shape"], "left", counts=kinds.groupBy("host").agg(F.count("*").alias("__rows")))
    tokens = F.concat(F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)), F.transform(F.regexp_extract_all("shape", F.lit(r"[^/._~-]+"), F.lit(0)), lambda w: F.concat(F.lit("p:"), w)))
    known = saved(shown.select("host", "shape", "n", "bad", F.array_distinct(tokens).alias("tokens")), "known")

    sizes = known.where("bad IS NOT NULL").groupBy("bad").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.size("tokens")).alias("tokens")).collect()
    size = {r["bad"]: (r["n"], r["tokens"]) for r in sizes}
    spread = saved(known.select("host", "shape", "n", "bad", F.explode("tokens").alias("token")), "tokens")
    heard = F.col("bad").isNotNull().cast("long") * F.col("n")
    by_token = saved(spread.groupBy("token").agg(F.sum(heard * F.col("bad")).alias("b"), F.sum(heard * (1 - F.col("bad"))).alias("a"), F.count("*").alias("__rows")), "by_token")
    (nb, tb), (na, ta) = size.get(1, (0, 0)), size.get(0, (0, 0))
    vocabulary = by_token.where("a + b > 0").count()
    seen = lambda c: F.coalesce(F.col(c), F.lit(0)) + F.lit(SMOOTH)
    ratio = F.log(seen("b") / F.lit(float(tb + vocabulary or 1))) - F.log(seen("a") / F.lit(float(ta + vocabulary or 1)))
    # A word of no example says nothing.
    weights = by_token.select("token", F.when(F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0)) > 0, ratio).otherwise(0.0).alias("w"))
    prior = float(np.log((nb + 1) / (na + 1))) if nb and na else 0.0
    summed = spread_join(spread, weights, ["token"], ["host", "shape"], counts=by_token.select("token", "__rows")).groupBy("host", "shape").agg(F.sum("w").alias("w"))
    score = kinds.join(summed, ["host", "shape"], "left").select("host", F.col("shape").alias("__shape"), F.coalesce("w", F.lit(0.0)).alias("__w"))
    rows = kinds.select("host", F.col("shape").alias("__shape"), F.col("n").alias("__rows"))
    total = hosts.agg(F.sum("n")).first()[0] or 0
    out = spread_join(placed, score, ["host", "__shape"], ["path", url], "left", counts=rows, total=total)
    out = out.withColumn("spam_score", F.col("__w") + F.lit(prior) if nb and na else F.lit(0.0)).withColumn("__rule", fitting_rule("host", "path", rules))
    out = out.withColumn("rule", F.col("__rule.text")).withColumn("verdict", F.coalesce("__rule.verdict", F.when(F.col("spam_score") > 0, "block").otherwise("allow")))
    return out.select(*[c for c in pages.columns if c != html], *RESULTS)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages).select("page_id", "host", "path", "rule", "verdict", "spam_score")
