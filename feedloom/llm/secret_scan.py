"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds one row per (blob, rule, rule
version) that was ever scanned, with what the rule found in it; a scan reads the versions given, keeps one text per blob,
subtracts the pairs that the ledger has, runs the rest and appends. Findings are joined back to all paths of a blob. All
of it is DataFrame expressions.

Positions count code points, ends exclusive. A rule's matches are leftmost and do not overlap; a match whose value is
too short is dropped after matching, so that it still uses up its text. Null texts count as empty, null ids are ids of
their own, repeated rows give repeated result rows, an empty table gives an empty result. Other columns are carried along, and
get `_in` behind their name where a result (blob, found) has it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import scratch_path, set_aside, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: Java pattern, the group that is the secret's value, the fewest characters of that value."""

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1
    #: A literal that every match holds, where there is one: a cheap test before the pattern runs.
    needs: str | None = None
    base: bool = True


# The three base patterns, and the well-known shapes that the method adds.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, needs="AKIA"),
    # Runs are maximal, so asking for the length in the pattern finds the same ones as dropping short runs.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, needs="PRIVATE KEY-----", base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, needs="gh", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, needs="eyJ", base=False),
)

#: gap: code points since the end of the match before (or the text's start); size: of the match; keep: long enough.
RUNS = T.ArrayType(T.StructType([T.StructField("gap", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("keep", T.BooleanType())]))
LEDGER = T.StructType([T.StructField("blob", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("version", T.IntegerType()), T.StructField("runs", RUNS)])


def blob_of(text: Column) -> Column:
    return F.sha2(text, 256)


def find_runs(text: Column, rule: Rule) -> Column:
    """All matches of a rule as RUNS: what stands between the matches gives the gaps."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    values = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    rows = F.zip_with(F.arrays_zip(gaps.alias("gap"), sizes.alias("size")), values, lambda x, v: F.struct(x["gap"].alias("gap"), x["size"].alias("size"), (v >= rule.least).alias("keep")))
    found = F.filter(rows, lambda x: x["size"].isNotNull())
    has = text.rlike(rule.pattern)
    return F.when(F.contains(text, F.lit(rule.needs)) & has if rule.needs else has, found).otherwise(F.array().cast(RUNS))


class BlobLedger:
    """What was scanned before, kept as Parquet under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def scan(self, versions: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the pairs of blob and rule version not yet in the ledger, and append them in one write."""
        wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        body = text_or_empty(text)
        blobs = versions.select(blob_of(body).alias("blob"), body.alias("body")).dropDuplicates(["blob"])
        seen = self.read().groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>"))))
        pending = todo.where(F.size("todo") > 0)
        entries = [
            F.when(F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), find_runs(F.col("body"), r).alias("runs")))
            for r in rules
        ]
        rows = pending.select("blob", F.explode(F.array_compact(F.array(*entries))).alias("x")).select("blob", "x.*")
        rows.write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, kind, start, end of what the rules in their present versions found."""
        order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
        now = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        held = self.read().where(F.array_contains(now, F.struct("kind", "version")) & (F.size("runs") > 0))
        spread = held.dropDuplicates(["blob", "kind"]).select("blob", "kind", F.posexplode("runs").alias("at", "run"))
        upto = F.sum(F.col("run.gap") + F.col("run.size")).over(Window.partitionBy("blob", "kind").orderBy("at"))
        placed = spread.select("blob", "kind", upto.alias("end"), F.col("run.size").alias("size"), F.col("run.keep").alias("keep"))
        return placed.where("keep").select("blob", "kind", (F.col("end") - F.col("size")).alias("start"), "end", order[F.col("kind")].alias("rank"))


def join_paths(versions: DataFrame, findings: DataFrame, text: str = "text") -> DataFrame:
    """Each version's row without its text, with blob and found: an array of (start, rank, kind, end) in order, empty if none."""
    by_blob = findings.groupBy(F.col("blob").alias("__blob")).agg(F.array_sort(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("__hits"))
    paths = set_aside(versions, ("blob", "found"))
    carried = [c for c in paths.columns if c != text]
    joined = paths.withColumn("__blob", blob_of(text_or_empty(text))).drop(text).join(by_blob, "__blob", "left")
    return joined.select(*carried, F.col("__blob").alias("blob"), F.coalesce("__hits", F.array().cast(by_blob.schema["__hits"].dataType)).alias("found"))


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, a count per base kind, all spans as text, and the hash of the base kinds' spans."""
    def count_of(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(rows: Column) -> Column:
        return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = [r.kind for r in rules if r.base]
    own = F.filter("found", lambda x: x["kind"].isin(base))
    return found.select("doc_id", *map(count_of, base), F.sha2(joined(own), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ledger = BlobLedger(spark, scratch_path(spark, "ledger"))
    ledger.scan(docs)
    return digest(join_paths(docs, ledger.findings()))
