"""The trained models against plain loops, another solver, and what they were not trained on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import language, quality

DATA = "/root/testdata/sf0.01"


def test_forward_pass_against_loops():
    texts = ["hello world, this is it", "été à la plage où", "x", "lang " * 200]
    windows = np.stack([language.windows_of(t.encode())[0] for t in texts])
    net = language.fit(windows, np.array([0, 1, 0, 1]), ["a", "b"], rounds=2)
    for text in texts:
        rows = language.windows_of(text.encode())
        got = net.probabilities(rows)
        for window, p in zip(rows, got, strict=True):
            best = np.full(net.kernel.shape[1], -np.inf)
            for i in range(language.WINDOW):
                seen = np.concatenate([net.embed[window[i + j]] for j in range(max(language.WIDTHS))])
                best = np.maximum(best, seen @ net.kernel)
            z = np.maximum(best + net.bias, 0) @ net.dense + net.shift
            z = np.exp(z - z.max())
            assert np.allclose(p, z / z.sum(), atol=1e-4)
    # A filter of a width sees no byte beyond it.
    for k, width in enumerate(language.WIDTHS):
        part = net.kernel[width * language.EMBED :, k * language.FILTERS : (k + 1) * language.FILTERS]
        assert not part.any()


def test_score_of_a_text_is_the_mean_of_its_windows():
    texts = ["one two three " * 60, "drei vier fünf " * 5]
    windows = np.stack([language.windows_of(t.encode())[0] for t in texts])
    net = language.fit(windows, np.array([0, 1]), ["a", "b"], rounds=2)
    for text, (name, score) in zip(texts, language._predict_all(net, texts), strict=True):
        rows = language.windows_of(text.encode())
        size = np.full(len(rows), float(language.WINDOW))
        size[-1] = len(text.encode()) - (len(rows) - 1) * language.WINDOW
        p = (net.probabilities(rows) * size[:, None]).sum(0) / size.sum()
        assert name == net.languages[int(p.argmax())] and score == pytest.approx(float(p.max()), abs=1e-5)


def test_dual_descent_reaches_the_least_hinge_loss():
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(60)]
    y = np.where(rng.random(60) < 0.5, 1.0, -1.0)
    ratio, cost = rng.normal(size=12), np.full(60, 0.7)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(max(1, len(r)))
    x[:, 12] = 1.0

    def loss(w):
        return 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()

    w, bias = quality._descend(rows, y, ratio, cost, 400, 1)
    mine = loss(np.concatenate([w, [bias]]))
    best, other = np.inf, np.zeros(13)
    for step in range(1, 20_001):
        bad = y * (x @ other) < 1
        other = other - (other - (cost * y * bad) @ x) / (step + 20)
        best = min(best, loss(other))
    assert mine <= best * 1.001


def test_ratios_are_log_counts():
    rows = [np.array([1, 2]), np.array([2, 3]), np.array([3]), np.array([3, 4])]
    labels = np.array([1, 1, 0, 0])
    model = quality.fit(rows, labels, rounds=50)
    # A code of label 1 alone weighs for it, one of label 0 against it, one of neither not at all.
    assert model.weights[1] > 0 and model.weights[4] < 0 and model.weights[9] == 0


def test_language_of_texts_that_were_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    found = language.op2_language(spark, DATA).where("held_out").join(docs, "doc_id").where("lang IS NOT NULL AND lang_pred <> 'und'")
    row = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert row["n"] > 100 and row["right"] > 0.95


def test_quality_of_texts_that_were_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "quality")
    found = quality.op6_quality(spark, DATA).where("held_out").join(labels, "doc_id").where("quality IS NOT NULL")
    row = found.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("right"), F.count("*").alias("n")).first()
    assert row["n"] > 20 and row["right"] > 0.95
