"""Alignment of two tokenizers' tokens by byte ranges, scored by inverted pair bitmaps.

A (byte-level BPE, over a space and the text) and B (pieces with byte fallback, over the text, to which it adds the space)
cover the same bytes. An A token and a B token whose byte ranges overlap are a link; byte offsets where both end cut the tokens
into groups. A pair of ids counts as many documents as hold it linked.

Neither tokenizer joins what lies before and behind a space or newline that follows another character, so texts are cut there,
and each distinct segment of a task is encoded and aligned once. A task closes a block when its texts reach BLOCK_CHARS or
BLOCK_TEXTS. Within a block, texts have numbers, and each pair has bitmaps over them: plane k holds the texts in which bit k of
the pair's multiplicity is set. Planes are kept compressed; their OR, popcounted, gives how many documents of the block hold the
pair, and they give back the links of each. A block has one posting row per distinct pair, so no pair has more rows than there
are blocks, however common it is. Rows are summed by pair; the highest count per A id is a table of the vocabulary's size
(broadcast: A_LIMIT rows at most); posting rows take the scores back to their block, whose planes spread them over its texts.

Texts that are null, empty, or of which a segment is not given back byte for byte (B reads U+2581 as a space) have no tokens:
zeros, and '' for the groups. Very long texts are read in pieces of PIECE characters and more. Repeated rows, and rows with repeated or null ids, are
documents of their own; other columns are not read, so no name can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from feedloom.llm.common import saved, small_batches

#: Characters and number of the texts of a block at most (one text may go beyond the first).
BLOCK_CHARS, BLOCK_TEXTS = 6 << 20, 4096
#: Characters of a text read at a time.
PIECE = 1 << 20
#: Distinct segments, and their characters, that a task keeps from block to block.
KEPT_SEGMENTS, KEPT_CHARS = 600_000, 12 << 20
#: Segments that are encoded at a time.
ENCODED = 50_000
#: Ids of A are below this, those of B below 1 << 16; a pair is one number.
A_LIMIT, SHIFT = 1 << 20, 16
#: Pairs whose bitmaps are packed together.
CHUNK_PAIRS = 4096

#: A space or newline behind another character.
_CUT = re.compile(r"(?<=\S)(?=[ \n])")

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def tokenizer_files() -> tuple[str, bytes]:
    """Contents of the installed public files of A and B."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read()


class Tokenizers:
    """Ids of segments by A and B, and the bytes of each id."""

    def __init__(self, spec: str, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        assert set(byte_of) == set(ByteLevel.alphabet())
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = ((self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b.get_piece_size()))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces]
        assert len(self.bytes_a) <= A_LIMIT and len(self.bytes_b) <= 1 << SHIFT

    def of(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids. A newline in front keeps B from adding a space of its own to the segment: it takes two tokens."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        return a, [ids[2:] for ids in self.b.encode(["\n" + s for s in segments], num_threads=1)]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class _Places(dict):
    """Places of segments by first sight, and those that are new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        self.new.append(segment)
        return n


class Segments:
    """Distinct segments with their alignment: counts of tokens, groups and links, the groups as text, the linked pairs."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.lengths = tuple(np.array([len(x) for x in t], np.int64) for t in (tokenizers.bytes_a, tokenizers.bytes_b))
        names = (range(len(tokenizers.bytes_a)), range(len(tokenizers.bytes_b)))
        # Ids as text with what follows them: within a group, at the end of its A side, within and at the end of its B side.
        self.labels = [b"%d%s" % (i, end) for side, ends in zip(names, (b",|", b",;"), strict=True) for end in (ends[:1], ends[1:]) for i in side]
        self.clear()

    def clear(self) -> None:
        self.places, self.chars = _Places(), 0
        self.groups: list[bytes] = []
        self.wrong: set[int] = set()
        self.counts = np.zeros((0, 4), np.int64)
        self.starts, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def place(self, segments: list[str]) -> np.ndarray:
        return np.fromiter(map(self.places.__getitem__, segments), np.int64, len(segments))

    def settle(self) -> None:
        """Align the segments that are new since the last time."""
        new, self.places.new = self.places.new, []
        self.chars += sum(map(len, new))
        for at in range(0, len(new), ENCODED):
            self._align(new[at : at + ENCODED])

    def _align(self, new: list[str]) -> None:
        t = self.tokenizers
        ids_a, ids_b = t.of(new)
        (a, n_a), (b, n_b) = _flat(ids_a), _flat(ids_b)
        if not self._whole(new, (a, n_a), (b, n_b)):
            for i, s in enumerate(new):
                if not b"".join(map(t.bytes_a.__getitem__, ids_a[i])) == b"".join(map(t.bytes_b.__getitem__, ids_b[i])) == s.encode():
                    self.wrong.add(len(self.groups) + i)
                    ids_a[i], ids_b[i] = [], []
            (a, n_a), (b, n_b) = _flat(ids_a), _flat(ids_b)
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = (end_a[at_a] == ends) & (end_b[at_b] == ends) if len(ends) else np.zeros(0, bool)
        shared = ends[both]
        # Every stretch between two ends lies in one token of either side, and no two stretches in the same two tokens.
        segment = np.repeat(np.arange(len(new)), n_a)[at_a]
        links = np.bincount(segment, minlength=len(new))
        counts = np.stack([n_a, n_b, np.bincount(segment[both], minlength=len(new)), links], axis=1)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        order = np.zeros(len(a) + len(b), np.int64)
        size_a, size_b = len(self.lengths[0]), len(self.lengths[1])
        order[np.arange(len(a)) + np.searchsorted(group_b, group_a)] = a + size_a * np.isin(end_a, shared)
        order[np.arange(len(b)) + np.searchsorted(group_a, group_b, "right")] = 2 * size_a + b + size_b * np.isin(end_b, shared)
        cuts = np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        said = list(map(self.labels.__getitem__, order.tolist()))
        self.groups += [b"".join(said[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
        self.counts = np.concatenate([self.counts, counts])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(links)])
        self.pairs = np.concatenate([self.pairs, a[at_a] << SHIFT | b[at_b]])

    def _whole(self, new: list[str], *sides: tuple[np.ndarray, np.ndarray]) -> bool:
        """Whether both tokenizers give back every segment byte for byte."""
        data = [s.encode() for s in new]
        ends, whole = np.cumsum([len(x) for x in data]), b"".join(data)
        for (ids, sizes), lengths, tokens in zip(sides, self.lengths, (self.tokenizers.bytes_a, self.tokenizers.bytes_b), strict=True):
            reached = np.concatenate([[0], np.cumsum(lengths[ids])])
            if not (np.array_equal(reached[np.cumsum(sizes)], ends) and b"".join(map(tokens.__getitem__, ids.tolist())) == whole):
                return False
        return True

    def pairs_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The linked pairs of the places in order, and how many each place has."""
        sizes = self.starts[places + 1] - self.starts[places]
        first = np.cumsum(sizes) - sizes
        return self.pairs[np.repeat(self.starts[places] - first, sizes) + np.arange(int(sizes.sum()))], sizes


def pieces_of(text: str) -> Iterator[str]:
    """The text in pieces of PIECE characters and more, cut where segments are."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + PIECE) if at + PIECE < len(text) else None
        yield text[at : (end := cut.start() if cut else len(text))]
        at = end


def planes_of(pair: np.ndarray, doc: np.ndarray, times: np.ndarray, texts: int) -> tuple[list[tuple[int, int, bytes]], np.ndarray]:
    """(chunk, plane, compressed bitmaps) for entries sorted by pair (numbered from 0), and the documents of each pair: the popcounts of the planes' OR."""
    n = int(pair[-1]) + 1 if len(pair) else 0
    width = -(-texts // 64) * 64
    packed, held = [], np.zeros(n, np.int64)
    cuts = np.searchsorted(pair, np.arange(0, n + CHUNK_PAIRS, CHUNK_PAIRS))
    for chunk, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
        at, m = (pair[x:y] - chunk * CHUNK_PAIRS) * width + doc[x:y], times[x:y]
        rows = min(CHUNK_PAIRS, n - chunk * CHUNK_PAIRS)
        merged = np.zeros(rows * width // 8, np.uint8)
        for plane in range(int(m.max()).bit_length()):
            bits = np.zeros(rows * width, bool)
            bits[at[(m >> plane) & 1 == 1]] = True
            if (one := np.packbits(bits)).any():
                merged |= one
                packed.append((chunk, plane, pa.compress(one.tobytes(), codec="zstd", asbytes=True)))
        held[chunk * CHUNK_PAIRS : chunk * CHUNK_PAIRS + rows] = np.bitwise_count(merged.view(np.uint64)).reshape(rows, -1).sum(axis=1)
    return packed, held


def entries_of(plane: bytes, pairs: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The set bits of a compressed plane: pair within the chunk, document."""
    width = -(-texts // 64) * 64
    bits = np.frombuffer(pa.decompress(plane, decompressed_size=pairs * width // 8, codec="zstd", asbytes=True), np.uint8)
    at = np.flatnonzero(np.unpackbits(bits))
    return at // width, at % width


class _Block:
    """Texts read so far: their ids, and the places of their segments."""

    def __init__(self, table: Segments):
        self.table = table
        self.ids: list[pa.Array] = []
        self.places: list[tuple[int, np.ndarray]] = []
        self.texts = self.chars = 0

    def read(self, text: str | None) -> None:
        text = " " + text if text else ""
        self.chars += len(text)
        self.places += [(self.texts, self.table.place(_CUT.split(piece))) for piece in pieces_of(text)]
        self.texts += 1

    def settle(self) -> list[tuple]:
        """A row of counts and the groups' digest per text; the places of texts without tokens go."""
        self.table.settle()
        counts, digests = np.zeros((self.texts, 4), np.int64), [hashlib.sha256() for _ in range(self.texts)]
        wrong = {d for d, places in self.places if not self.table.wrong.isdisjoint(places.tolist())} if self.table.wrong else set()
        self.places = [p for p in self.places if p[0] not in wrong]
        begun = set()
        for d, places in self.places:
            counts[d] += self.table.counts[places].sum(axis=0)
            digests[d].update((b";" if d in begun else b"") + b"".join(map(self.table.groups.__getitem__, places.tolist()))[:-1])
            begun.add(d)
        return [(*c, digests[d].hexdigest() if d in begun else "") for d, c in enumerate(counts.tolist())]

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """doc << 48 | pair of all links, in order, and how many there are of each; few enough places at a time."""
        keys, times, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while at < len(self.places):
            end, n = at, 0
            while end < len(self.places) and n < PIECE:
                n += len(self.places[end][1])
                end += 1
            docs = np.repeat([d for d, _ in self.places[at:end]], [len(p) for _, p in self.places[at:end]])
            pairs, per_place = self.table.pairs_of(np.concatenate([p for _, p in self.places[at:end]]))
            key, n_links = np.unique(np.repeat(docs.astype(np.int64) << 48, per_place) | pairs, return_counts=True)
            keys.append(key)
            times.append(n_links)
            at = end
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, place, np.concatenate(times))
        return key, total

    def row(self, number: int) -> pa.RecordBatch:
        rows = self.settle()
        key, times = self.entries()
        names, pair = np.unique(key & ((1 << 48) - 1), return_inverse=True)
        doc = key >> 48
        order = np.lexsort((doc, pair))
        packed, held = planes_of(pair[order], doc[order], times[order], self.texts)
        fields = list(zip(*rows, strict=True))
        texts = pa.StructArray.from_arrays([pa.concat_arrays(self.ids), *(pa.array(f, pa.int64()) for f in fields[:4]), pa.array(fields[4], pa.string())], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        planes = [one(pa.array([p[i] for p in packed], t)) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), one(texts), one(pa.array(names)), one(pa.array(held)), *planes], names=["block", "texts", "pairs", "held", "chunk", "plane", "bits"])


def _read(spec: str, model: bytes):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, table, block = (context.partitionId() if context else 0) << 32, None, None
        for batch in batches:
            table = table or Segments(Tokenizers(spec, model))
            for i in range(batch.num_rows):
                block = block or _Block(table)
                block.ids.append(batch.column(0).slice(i, 1))
                block.read(batch.column(1)[i].as_py())
                if block.chars >= BLOCK_CHARS or block.texts >= BLOCK_TEXTS:
                    yield block.row(number)
                    number, block = number + 1, None
                    if len(table.places) > KEPT_SEGMENTS or table.chars > KEPT_CHARS:
                        table.clear()
        if block:
            yield block.row(number)

    return rows


def _spread(kind: pa.Schema):
    """The scores of a block's pairs, spread over its texts by the planes."""

    def rows(key: tuple, block: pa.Table, scores: pa.Table) -> pa.Table:
        if not block.num_rows:
            return kind.empty_table()
        own = block.slice(0, 1).to_batches()[0]
        texts = own.column("texts").flatten()
        n = len(texts)
        count, best = (np.zeros(len(own.column("pairs")[0]), np.int64) for _ in range(2))
        at = scores.column("at").to_numpy()
        count[at], best[at] = scores.column("docs").to_numpy(), scores.column("best").to_numpy()
        n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for chunk, plane, bits in zip(*(own.column(c)[0].as_py() for c in ("chunk", "plane", "bits")), strict=True):
            pair, doc = entries_of(bits, min(CHUNK_PAIRS, len(count) - chunk * CHUNK_PAIRS), n)
            pair += chunk * CHUNK_PAIRS
            np.add.at(n_best, doc, best[pair] << plane)
            np.add.at(count_sum, doc, count[pair] << plane)
        fields = {f: texts.field(f) for f in ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
        return pa.table(fields | {"n_best": n_best, "count_sum": count_sum}).select(kind.names).cast(kind)

    return rows


def aligned(docs: DataFrame, spec: str, model: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The id column and COLUMNS, a row per document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    named = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = f"block long, texts array<struct<id:{id_type},n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>, pairs array<long>, held array<long>, chunk array<int>, plane array<int>, bits array<binary>"
    with small_batches(docs.sparkSession, 256):
        blocks = saved(named.mapInArrow(_read(spec, model), schema), "aligned")
    postings = blocks.select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("at", "p")).select("block", "at", F.col("p.pairs").alias("pair"), F.col("p.held").alias("held"))
    counts = saved(postings.groupBy("pair").agg(F.sum("held").alias("docs")), "pairs")
    # At most A_LIMIT rows: one per id of A.
    highest = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("docs").alias("highest"))
    scored = counts.join(F.broadcast(highest), F.shiftright("pair", SHIFT) == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("highest")).cast("long").alias("best"))
    scores = postings.drop("held").join(scored, "pair").select(F.col("block").alias("of"), "at", "docs", "best")
    results = f"id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    kind = to_arrow_schema(docs.sparkSession.createDataFrame([], results).schema)
    content = blocks.select("block", "texts", "pairs", "chunk", "plane", "bits")
    found = content.groupBy("block").cogroup(scores.groupBy("of")).applyInArrow(_spread(kind), results)
    return found.withColumnRenamed("id", id_col)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), *tokenizer_files())
