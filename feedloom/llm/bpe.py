"""BPE encoding and decoding over a table of distinct words.

Each task splits its texts into words and closes a block when the block's vocabulary reaches BLOCK_WORDS words, or its texts
BLOCK_TEXTS or BLOCK_BYTES. A block gives one row per distinct word (block, place, word) and one row per text with the places
of its words. The word rows of all blocks meet by word, where each distinct word is encoded once; its ids are joined to the
vocabulary's pieces, one row per id, which decodes it; ids and decoded words go back to the blocks by (block, place), and
every text's ids and decoded text follow from its places. A block is named by its partition, its number there and its
vocabulary, so a recomputed task names its blocks alike, no two blocks meet, and texts whose block has no ids raise an error.

No token of the tokenizer file reaches across white space, so texts are cut there first. Pieces of code points below U+0300
are then lower-cased and split by the file's pattern, which is what its normaliser and splitter do to them; other pieces,
and those that may hold a special token, are words as they stand. Either way the file's own tokenizer encodes the words.
Null and empty texts have no ids. Repeated rows and repeated or null ids give a row each; an empty table gives an empty
result; columns other than id and text are not read, so no name can clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import saved

#: Distinct words of a block at most (one text may go beyond it).
BLOCK_WORDS = 400_000
#: Texts of a block at most, and bytes of their packed places (one text may go beyond them).
BLOCK_TEXTS, BLOCK_BYTES = 50_000, 32 << 20
#: Word rows that are encoded, and sent back, at a time.
CHUNK_WORDS = 100_000

#: Texts with other code points are not lower-cased here; composing could change what lower case is.
_BEYOND = re.compile("[^\x00-\u02ff]")
#: White space to str.split() but not to the tokenizer file.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PIECES = re.compile("[^\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# The word pattern of the tokenizer file, for text without white space.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+"


def tokenizer_file(path: str | None = None) -> str:
    """Contents of the tokenizer file; the default is the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


class WordSplitter:
    """Text -> words."""

    def __init__(self) -> None:
        self.pattern = regex.compile(_WORD, regex.V1)

    def pieces(self, text: str) -> tuple[list[str], bool]:
        """The pieces, and whether they are to be split further."""
        plain = "<|" not in text and not _BEYOND.search(text)
        if plain:
            text = text.lower()
        return _PIECES.findall(text) if _SEPARATORS.search(text) else text.split(), plain

    def __call__(self, text: str) -> list[str]:
        pieces, plain = self.pieces(text)
        return [w for p in pieces for w in self.pattern.findall(p)] if plain else pieces


def word_encoder(spec: str) -> Callable[[list[str]], list[list[int]]]:
    """Words -> ids."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]


def pieces_of(spec: str) -> list[str]:
    parsed = json.loads(spec)
    ids = parsed["model"]["vocab"] | {t["content"]: t["id"] for t in parsed["added_tokens"]}
    out = [""] * (max(ids.values()) + 1)
    for piece, i in ids.items():
        out[i] = piece
    return out


def piece_table(spark: SparkSession, spec: str) -> DataFrame:
    """id, piece: a row per entry of the vocabulary."""
    pieces = pieces_of(spec)
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(pieces)), pa.int32()), "piece": pa.array(pieces, pa.string())}))


def id_type_of(spec: str) -> str:
    """Two bytes hold the ids of a vocabulary of this size, or four."""
    return "<u2" if len(pieces_of(spec)) <= 1 << 16 else "<u4"


class _Places(dict):
    """Places of words in a block, by first sight, and of the words of each piece."""

    def __init__(self) -> None:
        super().__init__()
        self.of_piece: dict[str, tuple[int, ...]] = {}

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def read(self, text: str, split: WordSplitter) -> np.ndarray:
        pieces, plain = split.pieces(text)
        if not plain:
            return np.fromiter(map(self.__getitem__, pieces), dtype=np.uint32, count=len(pieces))
        known = self.of_piece
        for p in set(pieces).difference(known):
            known[p] = tuple([self[w] for w in split.pattern.findall(p)])
        return np.array(list(chain.from_iterable(map(known.__getitem__, pieces))), dtype=np.uint32)


def _pack(places: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Byte planes, so that the high bytes, mostly zero, squeeze well."""
    return squeeze.compress(_planes(places))


def _unpack(packed: bytes, expand: zstandard.ZstdDecompressor) -> np.ndarray:
    planes = np.frombuffer(expand.decompress(packed), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[tuple[int, list[str], list[tuple[object, bytes]]]]:
    """(name, words in order of place, (id, packed places) per text) of each block."""
    split, squeeze = WordSplitter(), zstandard.ZstdCompressor(level=3)
    places, texts, held, number = _Places(), [], 0, 0
    task = TaskContext.get()
    partition = task.partitionId() if task else 0

    def closed() -> tuple[int, list[str], list[tuple[object, bytes]]]:
        words = list(places)
        name = hashlib.blake2b(f"{partition} {number}\n".encode() + "\n".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        return int.from_bytes(name, "little", signed=True), words, texts

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            packed = _pack(places.read(text or "", split), squeeze)
            texts.append((key, packed))
            held += len(packed)
            if len(places) >= block_words or len(texts) >= BLOCK_TEXTS or held >= BLOCK_BYTES:
                yield closed()
                places, texts, held, number = _Places(), [], 0, number + 1
    if texts:
        yield closed()


def block_words(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = BLOCK_WORDS) -> DataFrame:
    """block, place, word: one row per distinct word of each block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, words, _ in _blocks(batches, size):
            for a in range(0, len(words), 20_000):
                part = words[a : a + 20_000]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(part), pa.int64()), "place": pa.array(range(a, a + len(part)), pa.int32()), "word": pa.array(part, pa.string())})

    return docs.select(id_col, text).mapInArrow(rows, "block long, place int, word string")


def block_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = BLOCK_WORDS) -> DataFrame:
    """block, id, places: one row per text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, texts in _blocks(batches, size):
            for a in range(0, len(texts), 2000):
                part = texts[a : a + 2000]
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(part), pa.int64()), "id": pa.array([k for k, _ in part], id_type), "places": pa.array([p for _, p in part], pa.binary())})

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema[id_col].dataType)
    return docs.select(id_col, text).mapInArrow(rows, f"block long, id {docs.schema[id_col].dataType.simpleString()}, places binary")


def encode_words(words: DataFrame, spec: str) -> DataFrame:
    """block, part: packed places, ids and decoded words of blocks.

    Rows of one word meet in one task, in order. A task takes CHUNK_WORDS rows at a time: each distinct word of a chunk is
    encoded once, and the chunk, one row, is written to the shared folder. Its ids become a row each and are joined to their
    pieces (broadcast: the vocabulary's size is the bound); the rows keep their order through that join, so the pieces of a
    word are put together in the same task.
    """
    kind = id_type_of(spec)
    pieces = F.broadcast(piece_table(words.sparkSession, spec))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze = word_encoder(spec), zstandard.ZstdCompressor(level=3)
        for batch in _chunks(batches):
            runs = pc.dictionary_encode(batch.column("word"))
            ids = encode(runs.dictionary.to_pylist())
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
            block, place, word = (batch.column("block").to_numpy(), batch.column("place").to_numpy(), runs.indices.to_numpy())
            names, owner = np.unique(block, return_inverse=True)
            # Where the chunk's words belong; numbers of blocks and places in byte planes, which squeeze well.
            head = squeeze.compress(b"".join((np.array([len(block), len(sizes), len(names)], np.int64).tobytes(), names.astype(np.int64).tobytes(), _planes(owner), _planes(place), word.astype(np.int32).tobytes(), sizes.tobytes())))
            yield pa.RecordBatch.from_pydict({"head": pa.array([head], pa.binary()), "ids": pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))})

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze, expand = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        held, have, chunk = [], 0, None
        for batch in batches:
            starts = set(np.flatnonzero(batch.column("at").to_numpy() == -1).tolist())
            cuts = sorted({0, *starts, batch.num_rows})
            for a, b in zip(cuts, cuts[1:]):
                if a in starts:
                    chunk, held, have, a = _Chunk(expand.decompress(batch.column("head")[a].as_py())), [], 0, a + 1
                part = batch.slice(a, b - a)
                if part.num_rows and (chunk is None or part.column("at")[0].as_py() != have):
                    raise ValueError("rows of a chunk are out of order")
                held.append(part)
                have += part.num_rows
                if have == chunk.due:
                    yield chunk.parts(pa.Table.from_batches(held), kind, squeeze)
                    held, chunk = [], None
        if chunk is not None:
            raise ValueError("a chunk lacks rows")

    met = words.repartition("word").sortWithinPartitions("word")
    chunks = saved(met.mapInArrow(encoded, "head binary, ids array<int>"), "encoded")
    none = lambda t: F.lit(None).cast(t)
    first = F.array(F.struct(F.lit(-1).alias("at"), none("int").alias("id"), F.col("head")))
    spread = chunks.select(F.inline(F.concat(first, F.transform("ids", lambda x, i: F.struct(i.alias("at"), x.alias("id"), none("binary").alias("head"))))))
    return spread.join(pieces, "id", "left").select("at", "id", "head", "piece").mapInArrow(gathered, "block long, part binary")


def _planes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of CHUNK_WORDS rows and more."""
    held, n = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, CHUNK_WORDS):
            part = batch.slice(a, CHUNK_WORDS)
            held.append(part)
            n += part.num_rows
            if n >= CHUNK_WORDS:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class _Chunk:
    """What the head of a chunk says: per row its block, place and distinct word, and per distinct word how many ids it has."""

    def __init__(self, head: bytes):
        n, m, k = np.frombuffer(head, np.int64, 3).tolist()
        names, at = np.frombuffer(head, np.int64, k, 24), 24 + 8 * k
        numbers = lambda at: np.ascontiguousarray(np.frombuffer(head, np.uint8, 4 * n, at).reshape(4, n).T).view("<u4").ravel()
        self.block, self.place = names[numbers(at)], numbers(at + 4 * n).astype(np.int32)
        self.word, self.sizes = np.frombuffer(head, np.int32, n, at + 8 * n), np.frombuffer(head, np.int32, m, at + 12 * n)
        self.due = int(self.sizes.sum())

    def parts(self, rows: pa.Table, kind: str, squeeze: zstandard.ZstdCompressor) -> pa.RecordBatch:
        """block, part: a row per block with its places, ids and decoded words."""
        ends = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int32)
        ids, spoken = rows.column("id").to_numpy().astype(kind), rows.column("piece").combine_chunks()
        decoded = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), spoken), " ")
        order = np.argsort(self.block, kind="stable")
        names, packed = [], []
        for of in np.split(order, np.flatnonzero(np.diff(self.block[order])) + 1):
            mine = self.word[of]
            own = np.concatenate([ids[ends[w] : ends[w + 1]] for w in mine.tolist()])
            texts = decoded.take(pa.array(mine)).cast(pa.binary())
            body = b"".join((np.array([len(mine), len(own)], np.int64).tobytes(), self.place[of].tobytes(), self.sizes[mine].tobytes(), pc.binary_length(texts).to_numpy().astype(np.int32).tobytes(), own.tobytes(), b"".join(texts.to_pylist())))
            names.append(int(self.block[of[0]]))
            packed.append(squeeze.compress(body))
        return pa.RecordBatch.from_pydict({"block": pa.array(names, pa.int64()), "part": pa.array(packed, pa.binary())})


def assemble(texts: DataFrame, words: DataFrame, spec: str, build: Callable, columns: str) -> DataFrame:
    """Joins encoded words back by (block, place). build(places, table) -> a result row; table has ids and decoded words by place."""
    kind = id_type_of(spec)
    schema = f"id {texts.schema['id'].dataType.simpleString()}, {columns}"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        table = WordTable(kind)
        for part in right.column("part").to_pylist():
            table.put(expand.decompress(part))
        size, out = len(table.ids), []
        for key, packed in zip(left.column("id").to_pylist(), left.column("places").to_pylist(), strict=True):
            places = _unpack(packed, expand)
            if len(places) and int(places.max()) >= size:
                raise ValueError("a block of texts has no ids: the input gave other rows when it was read again")
            out.append((key, *build(places.tolist(), table)))
        del table
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)] if out else [pa.array([], f.type) for f in target], schema=target)

    return texts.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(join, schema)


class WordTable:
    """By place: a word's ids, the ids as decimal text, and the word decoded."""

    def __init__(self, kind: str):
        self.kind = kind
        self.ids: list[list[int]] = []
        self.numbers: list[bytes] = []
        self.decoded: list[bytes] = []
        self.silent = False

    def put(self, part: bytes) -> None:
        n, m = np.frombuffer(part, np.int64, 2).tolist()
        places, sizes, lengths = np.frombuffer(part, np.int32, 3 * n, 16).reshape(3, n).tolist()
        at = 16 + 12 * n
        ids = np.frombuffer(part, self.kind, m, at).tolist()
        at += m * np.dtype(self.kind).itemsize
        if n and max(places) >= len(self.ids):
            more = max(places) + 1 - len(self.ids)
            self.ids += [[]] * more
            self.numbers += [b""] * more
            self.decoded += [b""] * more
        a = 0
        for place, size, length in zip(places, sizes, lengths, strict=True):
            own = ids[a : a + size]
            self.ids[place] = own
            self.numbers[place] = b" ".join([b"%d" % i for i in own]) if size > 1 else b"%d" % own[0] if size else b""
            self.decoded[place] = part[at : at + length]
            self.silent |= not size
            a, at = a + size, at + length

    def spoken(self, places: list[int]) -> list[int]:
        """Places of words that have ids."""
        return [p for p in places if self.ids[p]] if self.silent else places


def _digest(places: list[int], table: WordTable) -> tuple[int, str, str]:
    places = table.spoken(places)
    numbers = b" ".join(map(table.numbers.__getitem__, places))
    decoded = b" ".join(map(table.decoded.__getitem__, places))
    n = numbers.count(b" ") + 1 if places else 0
    return n, hashlib.sha256(numbers).hexdigest(), hashlib.sha256(decoded).hexdigest()


def ids_and_digest(places: list[int], table: WordTable) -> tuple[list[int], str]:
    places = table.spoken(places)
    decoded = b" ".join(map(table.decoded.__getitem__, places))
    return [i for p in places for i in table.ids[p]], hashlib.sha256(decoded).hexdigest()


def _ids(places: list[int], table: WordTable) -> tuple[list[int]]:
    return ([i for p in places for i in table.ids[p]],)


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text: str = "text", build: Callable = _ids, columns: str = "ids array<int>") -> DataFrame:
    """The id column and, by default, ids; build and columns may ask for other results of a text's words."""
    words = block_words(docs, id_col, text)
    found = assemble(block_texts(docs, id_col, text), encode_words(words, spec), spec, build, columns)
    return found.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, spec: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The id column (unique) and decoded, by a join of ids to pieces; the vocabulary's size bounds what is broadcast."""
    pieces = piece_table(encoded.sparkSession, spec).withColumnRenamed("id", "__id")
    spread = encoded.select(id_col, F.posexplode_outer(ids).alias("__at", "__id")).join(F.broadcast(pieces), "__id", "left")
    joined = spread.groupBy(id_col).agg(F.array_sort(F.collect_list(F.when(F.col("__at").isNotNull(), F.struct("__at", "piece")))).alias("x"))
    return joined.select(id_col, F.array_join(F.col("x.piece"), " ").alias("decoded"))


def digests(docs: DataFrame, spec: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return encode(docs, spec, id_col, text, _digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file())
