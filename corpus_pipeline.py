"""From raw documents to token ids: five stages over whole tables, each written as Parquet before the next one reads it.

All stages but the last return the columns of documents. Every stage works on all that the one before it kept. Null and empty
texts pass the first stage by the classifier's score of no features, the second and third as they are; rows may repeat, share
or lack an id, and carry further columns of any name but those that start with two underscores, which are refused; an empty
table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import bpe, line_dedup, ngram_join, quality, source_mix
from feedloom.llm.common import saved

#: Near duplicates: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def _carried(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, which an operator carries along first and in order, under their own names."""
    return found.select(*found.columns[: len(docs.columns)]).toDF(*docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, fitted on the labels of the same data set."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _carried(quality.scored(docs, model).where("predicted = 1"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in earlier ones; those of which nothing is left go. n_chars follows the text."""
    cleaned = line_dedup.dedup_lines(docs, characters=True)
    left = cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return _carried(left.withColumn("n_chars", n_chars), docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id; documents without words or without an id stay.

    Id and text together are the document: the join runs over hashes of texts, so texts that share an id stand on their own.
    """
    keyed = docs.withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
    known, unnamed = keyed.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = ngram_join.jaccard_components(known.select("__text", "text"), "__text", width=SHINGLE, percent=PERCENT)
    least = known.where(~wordless).groupBy("__text").agg(F.min("doc_id").alias("doc_id"))
    placed = least.join(found.select("__text", "component_id").distinct(), "__text")
    first = placed.groupBy("component_id").agg(F.min(F.struct("doc_id", "__text")).alias("first")).select("first.*")
    kept = known.where(~wordless).join(first, ["doc_id", "__text"], "left_semi").unionByName(known.where(wordless))
    return kept.dropDuplicates(["doc_id", "__text"]).select(*docs.columns).unionByName(unnamed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: by position over the part files, and within each."""
    placed = source_mix.mix(docs)
    return _carried(placed.repartitionByRange("mix_position").sortWithinPartitions("mix_position"), docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, part and row (the document's place in the mix), n_tokens, ids, and the hash of the decoded text."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
    placed = docs.select(F.struct("doc_id", part.alias("part"), F.col("_metadata.row_index").alias("row")).alias("key"), "text")
    found = bpe.encode(placed, bpe.tokenizer_file(), "key", "text", bpe.ids_and_digest, "ids array<int>, decoded_sha256 string")
    return found.select("key.doc_id", "key.part", "key.row", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

#: A fitted classifier, an EDF schedule and BPE merges are beyond SQL; tests/llm hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
