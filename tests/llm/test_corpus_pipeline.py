"""The pipeline and its near-copy stage against brute force, with ids that several texts share."""

import hashlib
import random

import corpus_pipeline
from feedloom.llm import bpe, line_dedup, quality, source_mix


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows):
    texts = sorted({t for k, t in rows if k is not None and shingles(t or "")})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = shingles(a), shingles(b)
            if len(x & y) * 100 >= 80 * len(x | y):
                root[find(a)] = find(b)
    ids, kept = {}, []
    for k, t in set(rows):
        if k is None or not shingles(t or ""):
            kept.append((k, t))
        else:
            ids.setdefault(find(t), []).append(k)
    return kept, {find(t): min(ids[find(t)]) for t in texts}, find


def test_texts_of_one_id_are_documents_of_their_own(spark):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(300)}" for _ in range(60)] for _ in range(8)]
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six"), (1, "one two three four five six"), (2, "one two three four five six"), (3, None), (3, " "), (None, "one two three four five six")]
    for _ in range(60):
        words = list(rng.choice(base))
        if rng.random() < 0.6:
            words[rng.randrange(60)] = "x"
        rows.append((rng.randrange(10, 30), " ".join(words)))
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()]
    others, first, find = brute(rows)
    worded = [(k, t) for k, t in got if k is not None and shingles(t or "")]
    assert sorted((find(t), k) for k, t in worded) == sorted(first.items())
    assert (1, "alpha beta gamma delta epsilon zeta") in got and (1, "one two three four five six") in got
    assert sorted(map(str, {g for g in got if g not in worded})) == sorted(map(str, others))


def brute_lines(rows):
    """(doc_id, text, ...) rows of unique ids -> text by id, and how many lines went."""
    first, near, places = {}, set(), {}
    for k, text, *_ in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((text or "").split("\n")):
            if words := tuple(line.encode().split()):
                first.setdefault(words, (k, i))
                places[k, i] = words
    order = sorted(first, key=first.get)
    for at, a in enumerate(order):
        if any(line_dedup.near_lines(b" ".join(a).decode(), b" ".join(b).decode()) for b in order[:at]):
            near.add(a)
    gone = {p for p, w in places.items() if w in near or first[w] != p}
    return {k: ("\n".join(x for i, x in enumerate((t or "").split("\n")) if (k, i) not in gone), sum(p[0] == k for p in gone)) for k, t, *_ in rows}


def brute_mix(rows):
    """Ids in the order of the mix: each source's blocks dealt to the slots of its schedule."""
    held = {}
    for k, _, source in rows:
        held.setdefault("-" if source is None else f"={source}", []).append(k)
    for ids in held.values():
        ids.sort(key=lambda k: hashlib.sha256(f"={k}".encode()).hexdigest())
    slots = source_mix.pfair_slots(source_mix.whole_shares(source_mix.temper({k: len(v) for k, v in held.items()})))
    out, taken = [], dict.fromkeys(held, 0)
    while len(out) < len(rows):
        for source in slots:
            out += held[source][taken[source] : taken[source] + source_mix.BLOCK_ROWS]
            taken[source] += source_mix.BLOCK_ROWS
    return out


def test_run_against_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    good = [f"word{i}" for i in range(300)]
    base = [[rng.choice(good) for _ in range(30)] for _ in range(30)]
    rows = []
    for k in range(260):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 30])):
            words[rng.randrange(30)] = rng.choice(good)
        text = " ".join(words) if k % 9 else "%%% " * 20 + f"junk{k} ###"
        footer = rng.choice(["", "\nAll rights reserved.", "\nAll rights  reserved.\nHome"])
        rows.append((k, text + footer, rng.choice(["web", "web", "books", None])))
    rows += [(900, None, "web"), (901, "", "books"), (902, "All rights reserved.", "web")]
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, int(k % 9 > 0), 0) for k in range(0, 260, 2)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r["part"], r["row"]))

    model = quality.train(docs, labels)
    kept = [r for r in rows if float(model.score(quality.np.array([model.margin(r[1])]))[0]) >= quality.THRESHOLD]
    assert all(r in kept for r in rows[:260] if r[0] % 9) and not any(r in kept for r in rows[:260] if r[0] % 9 == 0)
    cleaned = brute_lines(kept)
    kept = [(k, cleaned[k][0] if cleaned[k][1] else t, s) for k, t, s in kept if not cleaned[k][1] or cleaned[k][0].strip()]
    others, first, _ = brute([(k, t) for k, t, _ in kept])
    ids = {k for k, _ in others} | set(first.values())
    kept = [r for r in kept if r[0] in ids]
    assert [r["doc_id"] for r in got] == brute_mix(kept)
    tokenizer, texts = Tokenizer.from_str(bpe.tokenizer_file()), {k: t or "" for k, t, _ in kept}
    for r in got:
        want = tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_carry_columns_of_any_name(spark):
    names = ("score", "predicted", "n_lines", "first_docs", "mix_slot", "mix_position", "component_id", "first", "tie", "doc", "line")
    rows = [(1, "one two three four five six", "a", "mine"), (1, "another text of that id", "a", "mine"), (None, "no id", None, "mine"), (2, None, "b", "mine"), (3, "one two three four five six", "b", "mine")]
    docs = spark.createDataFrame([(k, t, s, len(t or ""), *[x] * len(names)) for k, t, s, x in rows], "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for stage in (corpus_pipeline.drop_repeated_lines, corpus_pipeline.keep_one_of_near_copies, corpus_pipeline.mix_sources):
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "source", "n_chars", *names]
        assert all(r[n] == "mine" for r in docs.collect() for n in names)
    assert docs.count() == 4
