"""Clashing names, ids that are missing or shared, and very long texts, in every operator and stage."""

import random

import pytest

from feedloom.llm import bpe, common, embedding_dedup, fingerprint, language, line_dedup, ngram_join, quality, secret_scan, source_mix, url_filter

LABELS = "doc_id long, quality int"
LONG = " ".join(f"word{i % 997} x{i}" for i in range(60_000))


def documents(spark, **more):
    rows = [(1, "alpha beta gamma", "s", "en", 16), (1, "delta epsilon", "s", "en", 13), (2, None, None, None, None), (None, "no id", "t", "en", 5), (3, "", "s", "fr", 0), (4, "alpha beta gamma", "s", "en", 16), (4, "alpha beta gamma", "s", "en", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size long")
    for name, value in more.items():
        docs = docs.withColumn(name, common.F.lit(value))
    return docs


def labels(spark):
    return spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 1), (3, 0)], LABELS)


def secrets(spark, docs):
    ledger = secret_scan.BlobLedger(spark, common.scratch_path(spark, "t"))
    ledger.scan(docs)
    return secret_scan.join_paths(docs, ledger.findings())


OPERATORS = {
    "secrets": (secrets, ["blob", "found", "hits", "kind", "runs", "body", "todo", "seen"]),
    "language": (lambda spark, d: language.identified(d, language.train(d)), ["lang_pred", "score"]),
    "quality": (lambda spark, d: quality.scored(d, quality.train(d, labels(spark))), ["score", "predicted", "draw", "codes"]),
    "mix": (lambda spark, d: source_mix.mix(d, block_rows=2, period=20), ["mix_source_rank", "mix_block", "mix_slot", "mix_position", "n"]),
    "fingerprint": (lambda spark, d: fingerprint.compared(d), ["n_chars", "edited", "near_edited", "near_next", "next_text", "own_ties", "changed_at", "first"]),
    "lines": (lambda spark, d: line_dedup.dedup_lines(d, characters=True), ["n_lines", "n_removed", "first_docs", "doc", "tie", "line", "place", "h1", "key"]),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_are_kept_apart(spark, name):
    run, names = OPERATORS[name]
    docs = documents(spark, **dict.fromkeys(names, "mine"))
    got = run(spark, docs)
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    rows = got.collect()
    assert len(rows) == docs.count()
    plain = run(spark, documents(spark))
    fresh = [c for c in plain.columns if c not in documents(spark).columns]
    for c in names:
        kept = f"{c}_in" if c in fresh else c
        assert all(r[kept] == "mine" for r in rows), c
    if name != "mix":  # rows that share an id are ordered by all their columns
        assert sorted(map(str, got.select(*fresh).collect())) == sorted(map(str, plain.select(*fresh).collect()))


def test_reserved_names_are_refused(spark):
    with pytest.raises(ValueError, match="reserved"):
        common.set_aside(documents(spark, __x=1), ["a"])


def test_operators_that_read_two_columns_ignore_all_others(spark):
    docs = documents(spark, key=1, id=2, size=3, component=4, block=5, places=6, ids=7, word=8, v=9, row=10)
    assert ngram_join.jaccard_components(docs).count() == docs.count()
    assert bpe.encode(docs, bpe.tokenizer_file()).count() == docs.count()
    pages = spark.createDataFrame([(1, "http://a.example.com/x", "<p>a</p>", "mine", "mine", "mine", "mine")], "page_id long, url string, html string, w string, host string, path string, token string")
    row = url_filter.judged(pages).first()
    assert (row["w"], row["host_in"], row["path_in"], row["token"], row["host"]) == ("mine", "mine", "mine", "mine", "a.example.com")
    vectors = spark.createDataFrame([(1, [1.0, 0.0], 0, 5, "mine"), (2, [1.0, 0.0], 0, 5, "mine"), (None, [1.0, 0.0], 0, 5, "mine"), (2, [0.0, 1.0], 0, 5, "mine")], "vec_id long, embedding array<double>, label int, id int, kept string")
    got = embedding_dedup.near_duplicates(vectors).collect()
    assert all(r["id"] == 5 and r["kept_in"] == "mine" for r in got)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"]) == [(1, 2, 1), (2, 0, 1), (2, 2, 1)]
    assert [r["component_id"] for r in got if r["vec_id"] is None] == [None]


def test_very_long_texts(spark):
    other = LONG.replace("x59999", "y")
    docs = spark.createDataFrame([(1, LONG, "s", "en"), (2, other, "s", "en"), (3, LONG.replace(" ", "\n"), "s", "en"), (4, "short", "s", "en")], "doc_id long, text string, source string, lang string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(docs, characters=True).collect()}[2] == 1
    assert {r["doc_id"]: round(r["near_next"], 3) > 0.99 for r in fingerprint.compared(docs).where("doc_id < 3").collect()} == {1: True, 2: True}
    assert secrets(spark, docs.withColumn("text", common.F.concat("text", common.F.lit(" token=abcdefgh")))).where("size(found) = 1").count() == 4
    assert bpe.encode(docs, bpe.tokenizer_file()).where("size(ids) > 100000").count() == 3
    assert language.identified(docs, language.train(docs)).where("lang_pred = 'en'").count() == 4
    assert quality.scored(docs, quality.train(docs, labels(spark))).count() == 4


def test_mix_deviates_less_than_a_block_and_places_ties_alike(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(200), f"t{i}", rng.choice("aaab")) for i in range(800)] + [(None, f"n{i}", "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"a": 3.0, "b": 1.0}
    got = sorted(source_mix.mix(docs, weights, block_rows=4, period=20).collect(), key=lambda r: r["mix_position"])
    again = sorted(source_mix.mix(docs.repartition(3), weights, block_rows=4, period=20).collect(), key=lambda r: r["mix_position"])
    assert [r["text"] for r in got] == [r["text"] for r in again]
    left = {k: sum(r["source"] == k for r in got) for k in "ab"}
    share, seen = {"a": 0.75, "b": 0.25}, dict.fromkeys("ab", 0)
    for n, r in enumerate(got, 1):
        seen[r["source"]] += 1
        # While both sources have blocks left.
        if all(seen[k] < left[k] for k in "ab"):
            assert all(abs(seen[k] - share[k] * n) < 2 * 4 for k in "ab")
    slots = {}
    for r in got:
        slots.setdefault(r["mix_slot"], r["source"])
    full = [slots[i] for i in range(min(left["a"] // 12, left["b"] // 4) * 4)]
    for t in range(1, len(full) + 1):
        assert all(abs(full[:t].count(k) - share[k] * t) < 1 for k in "ab")


def test_more_sources_than_a_schedule_holds_are_refused(spark):
    docs = spark.range(600).selectExpr("id AS doc_id", "cast(id AS string) AS source")
    with pytest.raises(ValueError, match="sources"):
        source_mix.mix(docs)


def test_blocks_of_equal_vocabulary_do_not_meet(spark):
    docs = spark.range(0, 4000, 1, 8).selectExpr("id AS doc_id", "cast(NULL AS string) AS text")
    assert bpe.block_texts(docs).select("block").distinct().count() == 8


def test_many_rows_of_one_key_are_dealt_to_tasks(spark):
    left = common.saved(spark.range(1000).selectExpr("CASE WHEN id < 700 THEN 1 ELSE id END AS k", "id AS x"), "t")
    right = spark.range(1000).selectExpr("id AS k", "id * 2 AS y")
    got = common.spread_join(left, right, ["k"], ["x"], rows=50)
    assert "__parts" not in got.columns and sorted(map(tuple, got.collect())) == sorted((1 if i < 700 else i, i, 2 if i < 700 else 2 * i) for i in range(1000))


def test_components_without_hubs_look_for_none(spark, monkeypatch):
    """A round writes four tables and asks one question: the driver keeps the threads and plans of each query for a while."""
    saved, written = common.saved, []
    monkeypatch.setattr(common, "saved", lambda df, name: written.append(name) or saved(df, name))
    edges = spark.range(6000).where("id % 3 > 0").selectExpr("id - 1 AS a", "id AS b")
    got = {tuple(r) for r in common.connected_components(edges).collect()}
    assert got == {(i, i - i % 3) for i in range(6000)}
    rounds = written.count("point")
    assert rounds >= 1 and len(written) == 4 * rounds + 3 and set(written) == {"edges", "labels", "step", "point"}


def test_components_of_large_hubs(spark):
    star = spark.range(1, 9000).selectExpr("0L AS a", "id AS b")
    second = spark.range(1, 5000).selectExpr("10000L + id AS a", "10000L AS b")
    tail = spark.range(20000, 20100).selectExpr("id AS a", "id + 1 AS b")
    got = {tuple(r) for r in common.connected_components(star.union(second).union(tail)).collect()}
    assert got == {(i, 0) for i in range(9000)} | {(10000 + i, 10000) for i in range(5000)} | {(i, 20000) for i in range(20000, 20101)}
