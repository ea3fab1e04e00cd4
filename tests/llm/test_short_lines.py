"""Lines of few words and of scripts without spaces: none is exempt from the dedup."""

import random

import numpy as np
import pyarrow as pa
import pytest

from feedloom.llm import line_dedup, ngram_join
from feedloom.llm.hashing import ByteWords, Sequence, stretch_ids


def brute(rows):
    first, near, places = {}, set(), {}
    for k, text in sorted(rows):
        for i, line in enumerate(text.split("\n")):
            if words := tuple(line.encode().split()):
                first.setdefault(words, (k, i))
                places[k, i] = words
    order = sorted(first, key=first.get)
    for at, a in enumerate(order):
        for b in order[:at]:
            x, y = (a, b) if max(len(a), len(b)) >= 10 else (b" ".join(a).decode(), b" ".join(b).decode())
            if max(len(x), len(y)) >= 10 and line_dedup.within_one_edit(x, y):
                near.add(a)
    gone = {p for p, w in places.items() if w in near or first[w] != p}
    return {k: "\n".join(x for i, x in enumerate(t.split("\n")) if (k, i) not in gone) for k, t in rows}


def cleaned(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, characters=True).collect()}


def test_no_line_is_exempt_for_its_word_count(spark):
    nine = "one two three four five six seven eight nine"
    chinese = "春眠不覺曉處處聞啼鳥夜來風雨聲"
    rows = [
        (1, f"All rights reserved.\n{nine}\n{chinese}\nHome page of us\nyes\n\nno"),
        (2, "All  rights reserved."),  # three words
        (3, f"{nine} ten"),  # a word from a line of nine
        (4, f"{chinese[:7]}花{chinese[8:]}"),  # a character
        (5, "Home pages of us\nyet\n\n yes "),
    ]
    assert cleaned(spark, rows) == {1: rows[0][1], 2: "", 3: "", 4: "", 5: "yet\n"}


def test_short_lines_against_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("ab é漢") for _ in range(rng.randrange(1, 30))) for _ in range(14)]
    base += [" ".join(rng.choice(["ab", "é", "漢字"]) for _ in range(n)) for n in (8, 9, 10, 11)]

    def edited(line):
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randrange(len(line) + 1)
            line = line[:at] + rng.choice(["", "a", "漢", " b "]) + line[at + rng.randrange(2) :]
        return line

    rows = [(k, "\n".join(edited(rng.choice(base)) for _ in range(rng.randrange(1, 6)))) for k in range(60)]
    assert cleaned(spark, rows) == brute(rows)


def test_pipeline_drops_documents_of_short_repeats_only(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "All rights reserved.\nsome more", 30), (2, "All rights reserved.\n", 21)], "doc_id long, text string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()] == [1]


def thue_morse(n, a, b):
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [a if x == 0 else b for x in bits]


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_and_lines_that_sums_of_powers_mistake_for_one_another(spark, n):
    one, other = thue_morse(n, "a", "b"), thue_morse(n, "b", "a")
    rows = [(1, "".join(one)), (2, "".join(other)), (3, " ".join(one)), (4, " ".join(other)), (5, "".join(one))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, characters=True).collect()}
    assert {k: v for k, v in texts.items() if k < 5} == dict(rows[:4]) and texts[5] == ""
    words = docs.where("doc_id IN (1, 2, 5)")
    assert sorted((r["doc_id"], r["component_id"]) for r in ngram_join.jaccard_components(words).collect()) == [(1, 1), (2, 2), (5, 1)]


def test_hashes_of_words_tell_lengths_and_bytes_apart():


    words = [b"a" * n for n in range(1, 40)] + [b"a" * n + b"\x00" for n in range(1, 20)] + [b"x", "é".encode(), b"ax" * 8, b"xa" * 8]
    found, starts = ByteWords().of(b" ".join(words) + b"\n")
    again, _ = ByteWords().of(b"zz " + b"\t".join(words))
    assert len(set(found.tolist())) == len(words) == len(starts) and (again[1:] == found).all()
    assert ByteWords().of(b"")[0].size == 0 and ByteWords().of(b" \n")[0].size == 0
    ids = stretch_ids(found, np.array([0, 1, 0, 3]), np.array([2, 3, 2, 3]))
    assert (ids[0] == ids[2]).all() and len({tuple(x) for x in ids.tolist()}) == 3


def test_workers_of_the_line_dedup_get_few_texts_at_a_time(spark, monkeypatch):
    scan = line_dedup._scan

    def checked(characters):
        read = scan(characters)

        def few(batches):
            def each():
                for batch in batches:
                    if batch.num_rows > 1000:
                        raise ValueError(f"{batch.num_rows} texts in a batch")
                    yield batch

            return read(each())

        return few

    monkeypatch.setattr(line_dedup, "_scan", checked)
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "concat('one line for all\n', id, ' ', id * 7919) AS text")
    assert line_dedup.dedup_lines(docs, characters=True).where("n_removed = 1").count() == 2999


def test_deletion_variants_are_hashed_for_many_lines_at_once(monkeypatch):
    rng = random.Random(5)
    lines = ["".join(rng.choice("ab é漢") for _ in range(rng.randrange(1, 40))) + "x" for _ in range(400)]
    lines += [" ".join(rng.choice(["ab", "é", "漢字", "a"]) for _ in range(n)) for n in range(1, 40)] + ["春眠不覺曉處處聞啼鳥夜來風雨聲" * 40, "a b " * 300]
    made = []
    monkeypatch.setattr(line_dedup, "Sequence", lambda *args: made.append(args) or Sequence(*args))

    def variants(numbers):
        rows = pa.array(numbers, pa.int64())
        batch = pa.RecordBatch.from_arrays([rows, rows, pa.array([lines[i] for i in numbers])], names=["h1", "h2", "body"])
        return sorted(tuple(r.values()) for out in line_dedup._variants(True)(iter([batch])) for r in out.to_pylist())

    together = variants(range(len(lines)))
    # Words and characters, for the one group of lines that this batch is.
    assert len(made) == 2
    assert together == sorted(row for i in range(len(lines)) for row in variants([i]))
    monkeypatch.setattr(line_dedup, "GROUP_CHARS", 100)
    assert variants(range(len(lines))) == together
