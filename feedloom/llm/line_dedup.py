"""Line dedup by deletion neighbourhoods over words and characters.

A line is its words (runs other than space and 0x09-0x0D). Lines that repeat, and lines within one unit's edit (one inserted,
deleted or replaced) of a line that stands earlier, are removed; the earliest stays. The edit is a tenth of the longer of
the two lines at most: a word where that one has NEAR_WORDS words or more; else, with `characters`, a character (of the
words with one space between) where it has NEAR_CHARS or more; below that only repeats count. Without `characters` near
lines are sought among those of NEAR_WORDS words or more alone. Earlier means a smaller doc_id (null first), then the
text's hash, then the line's number; rows of equal id and text count as one document. Blank lines always stay.

1. Every line gives a 128-bit hash, and hashes of its first and last half (in each unit it may be near in) for two lengths. One edit spares a half,
   so a line can only be near another one if it shares such a key with a different line. Keys are counted with map-side
   combining; those that different lines share are marked in a bitmap of fixed size (collisions only add work).
2. Lines with a marked key, once each, emit their deletion variants as hashed keys: (rest, length, place) meets lines that
   differ in that unit, (rest, length) meets the line that equals the rest. Whatever meets under one key lies within the
   bound, so the earliest line of a key is all that the others need: no pairs within a group.
3. The earliest partner of each line is verified by its words or characters.
4. Line numbers to remove are collected per document and joined to the texts.

A line goes where an earlier one is near, also where that one goes itself: what is near is a property of two lines alone, so
that the result does not hang on an order of removals; first_docs names the document of the earlier line.

Null and empty texts stay as they are; a text of one very long line is compared like any other; rows of equal id and text
are cleaned alike; an empty table gives an empty result; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import bitmap_of, in_bitmap, saved, set_aside, small_batches, spread_join
from feedloom.llm.hashing import BASES, ByteWords, Powers, Sequence, mix, signed, stretch_ids

EXACT_WORDS, NEAR_WORDS, NEAR_CHARS = 1, 10, 10
#: Keeps the keys of characters apart from those of words.
CHARS = np.uint64(0xD6E8FEB86659FD93)
#: Rows of one line that go to one task.
COMMON_ROWS = 4096
#: Characters of text that are hashed in one go.
GROUP_CHARS = 200_000


def _spaced(line: bytes) -> str:
    """The words of a line with one space between."""
    return b" ".join(line.split()).decode("utf-8", "surrogatepass")


def _char_values(text: str) -> np.ndarray:
    return mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1))


def _halves(line: Sequence, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Hashes of the first and last half of the stretches, as the longer and as the shorter of a pair; 0 for pairs below `least`."""
    keys = []
    for size in (b - a, b - a + 1):
        half = np.maximum(size - 1, 0) // 2
        for side, (x, y) in enumerate(((a, a + half), (b - half, b))):
            keys.append(np.where(size >= least, mix(line.stretch(x, y) + mix((size * 2 + side).astype(np.uint64))), np.uint64(0)))
    return np.stack(keys, axis=1)


class _Lines:
    """Hashes of many texts' lines at once."""

    def __init__(self, characters: bool) -> None:
        self.words, self.powers, self.characters = ByteWords(), Powers(BASES[1]), characters

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, number, both hashes and keys of each line that counts; keys are 0 where a line is short."""
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        many = np.array([d.count(b"\n") + 1 for d in data])
        whole = b"\n".join(data)
        values, starts = self.words.of(whole)
        breaks = np.flatnonzero(np.frombuffer(whole, dtype=np.uint8) == 10)
        sizes = np.bincount(np.searchsorted(breaks, starts), minlength=many.sum())
        ends = np.cumsum(sizes)
        at = np.flatnonzero(sizes >= EXACT_WORDS)
        n, b = sizes[at], ends[at]
        a = b - n
        ids = stretch_ids(values, a, b)
        shared = _halves(Sequence(values, self.powers), a, b, NEAR_WORDS)
        if self.characters:
            shared = np.concatenate([shared, self._of_characters(whole, at, n)], axis=1)
        else:
            shared[n < NEAR_WORDS] = 0
        owner = np.repeat(np.arange(len(texts)), many)[at]
        return owner, at - (np.cumsum(many) - many)[owner], ids, shared

    def _of_characters(self, whole: bytes, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        keys, few = np.zeros((len(at), 4), np.uint64), np.flatnonzero(n < NEAR_WORDS)
        if len(few):
            lines = whole.split(b"\n")
            bodies = [_spaced(lines[i]) for i in at[few].tolist()]
            ends = np.cumsum([len(x) for x in bodies])
            found = _halves(Sequence(_char_values("".join(bodies)), self.powers), np.concatenate([[0], ends[:-1]]), ends, NEAR_CHARS)
            keys[few] = np.where(found != 0, mix(found ^ CHARS), np.uint64(0))
        return keys


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Stretches of texts of about GROUP_CHARS characters, with where they start."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text)
        if total >= GROUP_CHARS:
            yield start, texts[start : i + 1]
            start, total = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def _scan(characters: bool):
    """(doc, tie, text) -> doc, tie, line, h1, h2, keys."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Lines(characters)
        for batch in batches:
            for start, texts in _groups(batch.column(2).to_pylist()):
                owner, number, ids, shared = reader.read(texts)
                who = pa.array(owner + start)
                spread = np.concatenate([[0], np.cumsum((shared != 0).sum(axis=1))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(spread), pa.array(signed(shared[shared != 0])))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(who), batch.column(1).take(who), pa.array(number.astype(np.int32)), pa.array(signed(np.ascontiguousarray(ids[:, 0]))), pa.array(signed(np.ascontiguousarray(ids[:, 1]))), lists],
                    names=["doc", "tie", "line", "h1", "h2", "keys"],
                )

    return rows


def _suspects(keys: np.ndarray, ties: np.ndarray, characters: bool):
    """(doc, tie, text) -> h1, h2, doc, tie, line, body: lines that have a marked key, of marked texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Lines(characters)
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(ties, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))))
            for start, texts in _groups(batch.column(2).to_pylist()):
                owner, number, ids, shared = reader.read(texts)
                hits = np.flatnonzero((in_bitmap(keys, shared) & (shared != 0)).any(axis=1))
                who = pa.array(owner[hits] + start)
                bodies = [texts[i].split("\n")[k] for i, k in zip(owner[hits].tolist(), number[hits].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(np.ascontiguousarray(ids[hits, 0]))), pa.array(signed(np.ascontiguousarray(ids[hits, 1]))), batch.column(0).take(who), batch.column(1).take(who), pa.array(number[hits].astype(np.int32)), pa.array(bodies, pa.string())],
                    names=["h1", "h2", "doc", "tie", "line", "body"],
                )

    return rows


def _variants(characters: bool, marked: np.ndarray | None = None):
    """(h1, h2, body) -> h1, h2, kind, key: the deletion neighbourhood of a line, or what of it is marked.

    Kinds: 0, a unit may be replaced; 1, one unit fewer; 2, the line itself.
    """
    return lambda batches: _neighbours(batches, characters, marked)


def _deletions(values: np.ndarray, a: np.ndarray, b: np.ndarray, powers: Powers, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Lines, keys and kinds of many lines at once, [a, b) of the units each, for pairs of which the longer has `least` units or more."""
    line, n = Sequence(values, powers), b - a
    few = np.flatnonzero(n + 1 >= least)
    yield few, mix(line.stretch(a[few], b[few]) + (n[few].astype(np.uint64) << np.uint64(20))), np.full(len(few), 2, np.int8)
    full = np.flatnonzero(n >= least)
    ends = np.cumsum(n[full])
    # A unit of the lines that count at a time; a line of very many units is told in pieces.
    for x in range(0, int(n[full].sum()), GROUP_CHARS):
        unit = np.arange(x, min(x + GROUP_CHARS, ends[-1]))
        who = np.searchsorted(ends, unit, side="right")
        place = unit - (ends - n[full])[who]
        who = full[who]
        start, size = a[who], n[who].astype(np.uint64)
        at = start + place
        rest = (line.sums[at] - line.sums[start] + (line.sums[b[who]] - line.sums[at + 1]) * line.down[1]) * line.down[start]
        yield who, mix(mix(rest + size) + place.astype(np.uint64) + np.uint64(1)), np.zeros(len(who), np.int8)
        yield who, mix(rest + ((size - np.uint64(1)) << np.uint64(20))), np.ones(len(who), np.int8)


def _neighbours(batches: Iterator[pa.RecordBatch], characters: bool, marked: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    words, powers = ByteWords(), Powers(BASES[0])
    for batch in batches:
        for start, bodies in _groups(batch.column(2).to_pylist()):
            data = [x.encode("utf-8", "surrogatepass") for x in bodies]
            # A line holds no line break, so the words of all lines are found in one go.
            values, firsts = words.of(b"\n".join(data))
            after = np.cumsum([len(x) + 1 for x in data])
            ends = np.searchsorted(firsts, after)
            sizes = np.diff(ends, prepend=0)
            for who, key, kind in _deletions(values, ends - sizes, ends, powers, NEAR_WORDS):
                yield from _told(batch, who + start, key, kind, marked)
            few = np.flatnonzero(sizes < NEAR_WORDS)
            if characters and len(few):
                spaced = [_spaced(data[i]) for i in few.tolist()]
                ends = np.cumsum([len(x) for x in spaced])
                for who, key, kind in _deletions(_char_values("".join(spaced)), np.concatenate([[0], ends[:-1]]), ends, powers, NEAR_CHARS):
                    yield from _told(batch, few[who] + start, mix(key ^ CHARS), kind, marked)


def _told(batch: pa.RecordBatch, who: np.ndarray, key: np.ndarray, kind: np.ndarray, marked: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    if marked is not None:
        keep = in_bitmap(marked, key)
        who, key, kind = who[keep], key[keep], kind[keep]
    for x in range(0, len(key), 50_000):
        part = pa.array(who[x : x + 50_000])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(part), batch.column(1).take(part), pa.array(kind[x : x + 50_000]), pa.array(signed(key[x : x + 50_000]))], names=["h1", "h2", "kind", "key"])


def within_one_edit(a: list | str, b: list | str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def near_lines(a: str, b: str) -> bool:
    """Whether one edit leads from a to b: of a word where the longer has NEAR_WORDS words, else of a character."""
    x, y = (t.encode("utf-8", "surrogatepass") for t in (a, b))
    if max(len(x.split()), len(y.split())) >= NEAR_WORDS:
        return within_one_edit(x.split(), y.split())
    p, q = _spaced(x), _spaced(y)
    return max(len(p), len(q)) >= NEAR_CHARS and within_one_edit(p, q)


def _verify(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near_lines(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _sources(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id_col).alias("doc"), F.xxhash64(body).alias("tie"), body.alias("text"))


def _place() -> Column:
    """Struct that orders lines; a null id stands first."""
    return F.struct(F.col("doc").isNotNull().alias("known"), F.col("doc"), F.col("tie"), F.col("line"))


def _met_by_two(keys: DataFrame) -> DataFrame:
    """Keys (key, h1) that two lines or more have."""
    return keys.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")


def _with_marked_key(bitmap: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(5).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(5)).to_numpy(zero_copy_only=False))
            yield batch.filter(pa.array(np.bincount(owner[in_bitmap(bitmap, keys)], minlength=batch.num_rows) > 0))

    return rows


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int | None = None, characters: bool = False) -> DataFrame:
    """doc, tie, line, first_doc for each line to remove; first_doc is the document of the line it repeats."""
    id_type = docs.schema[id_col].dataType.simpleString()
    source = _sources(docs, id_col, text)
    lines = saved(source.mapInArrow(_scan(characters), f"doc {id_type}, tie long, line int, h1 long, h2 long, keys array<long>"), "lines")

    shared = _met_by_two(lines.select(F.explode("keys").alias("key"), "h1"))
    keys = bitmap_of(saved(shared, "shared"), "key", bits)
    marked = lines.where(F.size("keys") > 0).mapInArrow(_with_marked_key(keys), lines.schema)
    places = saved(marked.groupBy("h1", "h2").agg(F.min(_place()).alias("place")).select(F.col("place.tie").alias("key")).distinct(), "places")
    suspects = source.mapInArrow(_suspects(keys, bitmap_of(places, "key", bits), characters), f"h1 long, h2 long, doc {id_type}, tie long, line int, body string")
    suspects = saved(suspects.groupBy("h1", "h2").agg(F.min(_place()).alias("place"), F.first("body").alias("body")), "suspects")

    one = F.struct("place", "h1", "h2")
    bodies, neighbours = suspects.select("h1", "h2", "body"), "h1 long, h2 long, kind tinyint, key long"
    held = bitmap_of(saved(_met_by_two(bodies.mapInArrow(_variants(characters), neighbours).select("key", "h1")), "held"), "key", bits)
    met = saved(bodies.mapInArrow(_variants(characters, held), neighbours).join(suspects.select("h1", "h2", "place"), ["h1", "h2"]), "met")
    least = met.groupBy("key").agg(*[F.min(F.when(F.col("kind") == k, one)).alias(c) for k, c in ((0, "s"), (1, "d"), (2, "f"))])
    partner = F.when(F.col("kind") == 0, F.col("s")).when(F.col("kind") == 1, F.col("f")).otherwise(F.col("d"))
    pairs = met.join(least, "key").withColumn("partner", partner).where("partner.place < place")
    pairs = pairs.groupBy("h1", "h2").agg(F.min("partner").alias("partner"))
    other = suspects.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("body").alias("other"))
    pairs = pairs.select("h1", "h2", F.col("partner.h1").alias("p1"), F.col("partner.h2").alias("p2"), F.col("partner.place.doc").alias("near_doc"))
    near = pairs.join(suspects.select("h1", "h2", "body"), ["h1", "h2"]).join(other, ["p1", "p2"]).where(F.pandas_udf(_verify, "boolean")("body", "other")).select("h1", "h2", "near_doc")

    firsts = lines.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    status = firsts.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").where("n > 1 OR near")
    status = saved(status, "status")
    # Lines that very many rows share are dealt to several tasks.
    hit = spread_join(lines.drop("keys"), status, ["h1", "h2"], ["doc", "tie", "line"], counts=status.select("h1", "h2", F.col("n").alias("__rows")), rows=COMMON_ROWS)
    here = _place()
    gone = hit.where(F.col("near").isNotNull() | (here > F.col("first")))
    return gone.select("doc", "tie", "line", F.when(F.col("near").isNotNull(), F.col("near_doc")).otherwise(F.col("first.doc")).alias("first_doc"))


RESULTS = ("n_lines", "n_removed", "first_docs")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bits: int | None = None, characters: bool = False) -> DataFrame:
    """docs with the text cleaned, n_lines, n_removed (long) and first_docs (the documents that hold what was removed).

    Columns of docs that bear the name of a result get `_in` behind it.
    """
    docs = set_aside(docs, RESULTS)
    # Every step in Python is written before this returns, so its workers hold few texts at a time.
    with small_batches(docs.sparkSession):
        gone = removed_lines(docs, id_col, text, bits, characters)
    per_doc = gone.groupBy(F.col("doc").alias("__doc"), F.col("tie").alias("__tie")).agg(F.collect_set("line").alias("__gone"), F.array_sort(F.collect_set("first_doc")).alias("__firsts"))
    keyed = docs.withColumn("__key", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(per_doc, (F.col("__key") == F.col("__tie")) & F.col(id_col).eqNullSafe(F.col("__doc")), "left")
    split = joined.withColumn("__lines", F.split(F.col(text), "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    split = split.withColumn("__stay", F.when(F.col("__gone").isNotNull(), stay))
    clean = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform("__stay", lambda i: F.get(F.col("__lines"), i)), "\n"))
    lines = F.when(F.col(text).isNull() | (F.col(text) == ""), F.lit(0)).otherwise(F.size("__lines")).cast("long")
    # The text is replaced last: other columns are found from it.
    out = split.withColumn("__n", lines).withColumn("__clean", clean)
    firsts = F.coalesce("__firsts", F.array().cast(per_doc.schema["__firsts"].dataType))
    return out.select(*[F.col("__clean").alias(c) if c == text else F.col(c) for c in docs.columns], F.col("__n").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"), firsts.alias("first_docs"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, characters=True).withColumn("first_docs", F.array_join("first_docs", ","))
