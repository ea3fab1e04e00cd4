"""Alignment of two tokenizers against the libraries on whole texts, link by link."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from feedloom.llm import token_alignment
from feedloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", *token_alignment.COLUMNS]


@pytest.fixture(scope="module")
def files():
    return token_alignment.tokenizer_files()


@pytest.fixture(scope="module")
def libraries(files):
    return token_alignment.Tokenizers(*files)


def tokens(text, t):
    if not text:
        return [], []
    a = t.a.encode(" " + text, add_special_tokens=False).ids
    b = t.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(t.bytes_a[i] for i in a) != whole or b"".join(t.bytes_b[i] for i in b) != whole:
        return [], []
    return a, b


def placed(ids, sizes):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(sizes[i]), i))
        at += len(sizes[i])
    return out


def brute(rows, t):
    """doc_id and the results of each row: every A token against every B token that overlaps it."""
    links, held, read = [], defaultdict(int), []
    for _, text in rows:
        a, b = tokens(text, t)
        pa, pb = placed(a, t.bytes_a), placed(b, t.bytes_b)
        own, j = [], 0
        for x, y, i in pa:
            while j < len(pb) and pb[j][1] <= x:
                j += 1
            k = j
            while k < len(pb) and pb[k][0] < y:
                own.append((i, pb[k][2]))
                k += 1
        cuts = sorted({y for _, y, _ in pa} & {y for _, y, _ in pb})
        groups, last = [], 0
        for c in cuts:
            side = lambda p, last=last, c=c: ",".join(str(i) for x, y, i in p if last <= x and y <= c)
            groups.append(f"{side(pa)}|{side(pb)}")
            last = c
        for pair in set(own):
            held[pair] += 1
        links.append(own)
        read.append((len(a), len(b), len(cuts), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return Counter((d, n_a, n_b, n_g, len(own), sum(held[p] == best[p[0]] for p in own), sum(held[p] for p in own), sha) for (d, _), own, (n_a, n_b, n_g, sha) in zip(rows, links, read, strict=True))


def found(df):
    return Counter(map(tuple, df.select(*COLUMNS).collect()))


ALPHABET = ["a", "B", "the", " ", " ", "  ", "\n", "\n\n", "\t", "\r", "'s", "1", "23", ".", "...", "é", "é", "ﬁ", "日本", "😀", " ", " ", "　", "\x1c", "\x85", "​", "\x00", "<s>", "</s>", "<|endoftext|>", "<0x0A>", "ß", "İ", "﻿", "�", "ا", "ไทย"]


def test_texts_of_all_kinds(spark, files, libraries):
    rng = random.Random(12)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    texts += [None, "", " ", "  ", "\n", " \n ", "a ", "a  \n", "▁", "a ▁b", "x" * 3000, "ab " * 4000, "the the the", "the the the", "\n\nthe", "a\x1c b", "a  b"]
    rows = [(i if i % 50 else None, x) for i, x in enumerate(texts)] + [(3, "the cat"), (3, "the cat"), (3, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, n_a string, `__block` long").repartition(3)
    assert found(token_alignment.aligned(docs, *files)) == brute(rows, libraries)


def test_small_blocks_and_pieces_change_nothing(spark, files, libraries, monkeypatch):
    rng = random.Random(5)
    words = ["lorem", "ipsum,", "dolor", "sit\namet", "Élan", "x1", "--"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 300])))) for i in range(60)]
    want = brute(rows, libraries)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for name, value in (("BLOCK_CHARS", 2000), ("PIECE", 64), ("KEPT_SEGMENTS", 4), ("CHUNK_PAIRS", 3)):
        monkeypatch.setattr(token_alignment, name, value)
    assert found(token_alignment.aligned(docs, *files)) == want


def test_empty_table(spark, files):
    df = token_alignment.aligned(spark.createDataFrame([], "doc_id long, text string"), *files)
    assert df.columns and set(df.columns) == set(COLUMNS) and df.count() == 0


def test_bitmaps_give_back_their_entries():
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 9000 * 70, 20000))
    pair, doc, times = *np.divmod(key, 70), rng.integers(1, 40, len(key))
    pair = np.unique(pair, return_inverse=True)[1]
    packed, held = token_alignment.planes_of(pair, doc, times, 70)
    assert held.tolist() == np.bincount(pair).tolist()
    total = Counter()
    for chunk, plane, bits in packed:
        n = min(token_alignment.CHUNK_PAIRS, len(held) - chunk * token_alignment.CHUNK_PAIRS)
        for p, d in zip(*token_alignment.entries_of(bits, n, 70), strict=True):
            total[(p + chunk * token_alignment.CHUNK_PAIRS, d)] += 1 << plane
    assert total == Counter({(p, d): m for p, d, m in zip(pair.tolist(), doc.tolist(), times.tolist(), strict=True)})


def test_registered_query_on_whole_documents(spark, libraries):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op12_token_alignment"](spark, DATA)) == brute(rows, libraries)
