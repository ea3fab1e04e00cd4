"""Readers and writers: registry, contacts, campaign state, payloads, projections, and the table store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The registry's columns in order, and its allowed values.
REGISTRY_COLUMNS = ("name", "careers_url", "source", "source_slug", "parsing_strategy", "status", "reason", "discovered_via", "discovered_at", "evidence", "tenant_url", "api_meta", "category", "employer_type")
STRATEGIES = ("api", "llm_scrape", "playwright", "manual")
STATUSES = ("active", "dormant", "broken", "denied")


def read_csv_rows(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """A4: RFC 4180 rows as text columns; quotes are doubled, line ends within quotes are kept."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.csv(path, schema=schema, header=header, enforceSchema=True, quote='"', escape='"', multiLine=True)


def write_csv_rows(df: DataFrame, path: str) -> None:
    """A4."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def decode_registry(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A1: (valid rows with api_meta as a map, quarantined rows with up to three issues)."""
    trimmed = rows.select(*[F.when(F.trim(c) != "", F.trim(c)).alias(c) for c in REGISTRY_COLUMNS], *[c for c in rows.columns if c not in REGISTRY_COLUMNS])
    meta = F.from_json("api_meta", "map<string,string>", {"mode": "PERMISSIVE"})
    bad_json = F.col("api_meta").isNotNull() & F.try_parse_json("api_meta").isNull()
    bad_meta = F.col("api_meta").isNotNull() & ~bad_json & (F.schema_of_variant(F.try_parse_json("api_meta")).startswith("OBJECT").__invert__() | meta.isNull())
    issue = lambda test, message: F.when(test, message)
    issues = F.array_compact(F.array(
        issue(F.col("name").isNull(), "name: required"),
        issue(F.col("careers_url").isNull() | ~F.col("careers_url").rlike(r"^https?://[^\s/]+"), "careers_url: not a url"),
        issue(F.col("tenant_url").isNotNull() & ~F.col("tenant_url").rlike(r"^https?://[^\s/]+"), "tenant_url: not a url"),
        issue(F.col("parsing_strategy").isNull() | ~F.col("parsing_strategy").isin(*STRATEGIES), "parsing_strategy: unknown value"),
        issue(F.col("status").isNull() | ~F.col("status").isin(*STATUSES), "status: unknown value"),
        issue(bad_json, "api_meta: not valid JSON"),
        issue(bad_meta, "api_meta: not an object of strings"),
    ))
    marked = trimmed.withColumn("issues", F.array_join(F.slice(issues, 1, 3), "; "))
    return marked.where("issues = ''").drop("issues").withColumn("api_meta", meta), marked.where("issues <> ''")


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A1."""
    return decode_registry(read_csv_rows(spark, path, list(REGISTRY_COLUMNS)))


def read_registry_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A2: a JSON array of entries; no file gives no rows, a malformed one is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("source_kind", F.lit("cache"))
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True).withColumn("source_kind", F.lit("cache"))


def encode_registry(df: DataFrame) -> DataFrame:
    """A3: all columns as text, null as empty, the map as JSON."""
    meta = F.to_json("api_meta") if isinstance(df.schema["api_meta"].dataType, T.MapType) else F.col("api_meta")
    return df.select(*[F.coalesce(meta if c == "api_meta" else F.col(c).cast("string"), F.lit("")).alias(c) for c in REGISTRY_COLUMNS])


def read_blast_state(spark: SparkSession, glob: str, record: str, lines: bool = False) -> DataFrame:
    """Campaign records of all profiles; a malformed file is an error.

    The profile is the file's name (`p0.json`), or its folder's (`profile_id=p0`) where Spark wrote it; lines: a state per line.
    """
    raw = spark.read.schema(f"records array<struct<{record}>>").option("mode", "FAILFAST").json(glob, multiLine=not lines)
    folder = F.regexp_extract(F.input_file_name(), r"/profile_id=([^/]+)/", 1)
    profile = F.when(folder != "", folder).otherwise(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    return raw.select(profile.alias("profile_id"), F.explode("records").alias("r")).select("profile_id", "r.*").orderBy("profile_id")


def read_diag(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; a broken line (the last one of a run cut short) is dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


PAYLOAD = "provider string, slug string, page int, fetched_at timestamp, reported_total long, kind string, body string"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """A8."""
    return spark.read.schema(PAYLOAD).json(path)


def stream_payloads(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A8, as a stream of files."""
    return spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", files_per_trigger).json(path)


def project_blast_log(records: DataFrame) -> DataFrame:
    """Campaign records of all profiles as one flat log."""
    return records.select("profile_id", "batch", "email", "company", "status", "variant", "at", F.coalesce("note", F.lit("")).alias("note"))


def append_undrafted(undrafted: DataFrame, run_id: int, path: str) -> None:
    """Exactly one run's rows; writing them again replaces them."""
    rows = undrafted.where(F.col("run_id") == run_id)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, which may hold *, is there."""
    fs, where = _fs(spark, path)
    return bool(fs.globStatus(where)) if "*" in path else fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def read_table(spark: SparkSession, path: str, schema: T.StructType, partitions: str = "", backfill: dict[str, Column] | None = None) -> DataFrame:
    """A Parquet folder as a table of this schema; a folder that is not there is an empty table.

    Columns that older files lack are null, or what backfill says. partitions: DDL of the partition columns.
    """
    schema = T.StructType([*schema, *(T.StructType.fromDDL(partitions) if partitions else [])])
    df = spark.read.schema(schema).parquet(path) if exists(spark, f"{path}/*") else spark.createDataFrame([], schema)
    return df.withColumns({c: F.coalesce(F.col(c), x) for c, x in (backfill or {}).items()})


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Df in place of the table; with partitions, in place of those that df has rows of. df must not read the table itself."""
    writer = df.write.mode("overwrite")
    (writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by) if partition_by else writer).parquet(path)


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), force: bool = False, least: float = 0.5) -> None:
    """write_table, unless df is empty or much smaller than the table. df may read the table: it is written beside it first."""
    spark, beside = df.sparkSession, f"{path}.new"
    df.write.mode("overwrite").parquet(beside)
    waiting = spark.read.schema(df.schema).parquet(beside)
    new, old = waiting.count(), spark.read.parquet(path).count() if exists(spark, f"{path}/*") else 0
    try:
        if not force and (new == 0 or new < least * old):
            raise ValueError(f"{path}: refusing to replace {old} rows by {new}")
        write_table(waiting, path, partition_by)
    finally:
        remove(spark, beside)
