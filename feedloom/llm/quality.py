"""Quality classifier: naive Bayes features under a linear support vector machine.

A text's features are the indicators of its byte n-grams (orders 1 to 3, hashed) and of its share of word pairs that
repeat one word. Each indicator is scaled by the log ratio
of how often the two classes have it (smoothed counts), the scaled vector is divided by the root of its size, and a linear
model with hinge loss is fitted by dual coordinate descent. Margins become scores from 0 to 1 by a logistic curve fitted to
the margins of texts that the model for the other half of the sample was fitted on.

The fit uses a bounded sample, Sample.rows labelled texts and Sample.codes feature ids at most (documented, by the hash of the
id); only these feature ids reach the driver. An id with contradicting labels is not learnt from; where an id has several texts
each is a text of its label. Scoring covers every text whole. Null and empty texts have no features and get the score of the bias
alone. Without labelled rows, or with one class only, every score is the share of label 1 (0.5 without rows). Repeated rows
are scored alike, rows without an id like all others; an empty table gives an empty result; other columns are carried along,
and get `_in` behind their name where a result has it.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import id_fold, saved, set_aside

BITS = 18
THRESHOLD = 0.3
#: A text has an indicator for each of these shares of neighbouring equal words that it reaches.
REPEATS = np.array([0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8, 0.95])
FOLDS = 5


@dataclass(frozen=True)
class Sample:
    """Bound of the sample that the classifier is fitted on."""

    rows: int = 3000
    codes: int = 30_000_000
    seed: int = 7


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, text: str | None) -> float:
        codes = feature_codes(text)
        if not len(codes):
            return self.bias
        # The last place of each code stands for it: sums distinct codes without sorting.
        place = np.arange(len(codes), dtype=np.int32)
        mark = _marks()
        mark[codes] = place
        first = mark[codes] == place
        return float(self.weights[codes[first]].sum() / np.sqrt(first.sum()) + self.bias)

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


_MARKS: list[np.ndarray] = []


def _marks() -> np.ndarray:
    if not _MARKS:
        _MARKS.append(np.empty(1 << BITS, dtype=np.int32))
    return _MARKS[0]


def feature_codes(text: str | None) -> np.ndarray:
    """Hashed codes of all byte n-grams of a text, repeats included."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    grams, parts = data, [data]
    for order in (2, 3):
        if len(data) < order:
            break
        grams = (grams[:-1] << np.uint32(8)) | data[order - 1 :]
        parts.append(((grams + np.uint32(order)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS))
    words = (text or "").split()
    if len(words) > 1:
        repeats = sum(map(operator.eq, words, words[1:])) / (len(words) - 1)
        parts.append(np.flatnonzero(REPEATS <= repeats).astype(np.uint32) + np.uint32(256))
    return np.concatenate(parts)


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, rounds: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for hinge loss over ratio-scaled indicators, each row divided by the root of its size."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros_like(ratio), 0.0, np.zeros(len(rows))
    values = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
    return w, bias


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of label 1 against the margin, by Newton steps with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - target) * margins).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margins**2).sum() + 1e-3, (s * margins).sum()], [(s * margins).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], labels: np.ndarray, seed: int = 7, cost: float = 1.0, rounds: int = 8, smooth: float = 1.0) -> Model:
    y = np.where(labels == 1, 1.0, -1.0)
    size = 1 << BITS
    if len(y) == 0 or (y > 0).all() or (y < 0).all():
        share = 0.5 if len(y) == 0 else float(np.clip((y > 0).mean(), 0.001, 0.999))
        return Model(np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))

    def part(chosen: np.ndarray) -> tuple[np.ndarray, float]:
        mine, own = [rows[i] for i in chosen], y[chosen]
        counts = [sum((np.bincount(r, minlength=size) for r, v in zip(mine, own, strict=True) if v == sign), np.zeros(size)) + smooth for sign in (1.0, -1.0)]
        ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
        share = np.array([len(own) / (2 * max(1, (own == v).sum())) for v in own])
        w, bias = _descend(mine, own, ratio, cost * share, rounds, seed)
        return w * ratio, bias

    everything = np.arange(len(y))
    halves = [everything[everything % 2 == k] for k in (0, 1)]
    margins = np.zeros(len(y))
    for k in (0, 1):
        if len(set(y[halves[k]])) < 2:
            return Model(*part(everything), 1.0, 0.0)
        w, bias = part(halves[k])
        for i in halves[1 - k]:
            margins[i] = w[rows[i]].sum() / np.sqrt(max(1, len(rows[i]))) + bias
    return Model(*part(everything), *_platt(margins, y))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.unique(feature_codes(t)).astype(np.int32).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("quality"), pa.array([len(f) // 4 for f in found], pa.int32()), pa.array(found, pa.binary())], names=["draw", "quality", "n", "codes"])


def train(docs: DataFrame, labels: DataFrame, sample: Sample = Sample(), folds: int = FOLDS) -> Model:
    """Fit on labelled documents outside fold 0 of the id."""
    known = labels.where(F.col("quality").isin(0, 1) & (id_fold("doc_id", folds) != 0)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most"))
    draw = F.xxhash64("doc_id", F.lit(sample.seed))
    # sample.rows ids at most: small enough to broadcast whatever the size of the corpus.
    chosen = known.where("quality = most").orderBy(draw, "doc_id").limit(sample.rows).drop("most")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text", F.lit(sample.seed)).alias("draw"), "quality", "text")
    # An id may have any number of texts.
    texts = texts.dropDuplicates(["draw", "quality"]).orderBy("draw", "quality").limit(sample.rows)
    found = saved(texts.mapInArrow(_features, "draw long, quality int, n int, codes binary"), "features")
    total, last = 0, None
    for r in found.select("draw", "n").orderBy("draw").collect():
        total += r["n"]
        if total > sample.codes:
            break
        last = r["draw"]
    got = found.where(F.col("draw") <= last).toPandas().sort_values(["draw", "quality"]) if last is not None else found.limit(0).toPandas()
    return fit([np.frombuffer(c, dtype=np.int32) for c in got["codes"]], got["quality"].to_numpy(), sample.seed)


def scored(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted."""
    docs = set_aside(docs, ("score", "predicted"))

    # One text of a batch at a time is a string.
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.fromiter((model.margin(t.as_py()) for t in texts), float, len(texts))))

    return docs.withColumn("score", score(F.col(text))).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(docs, model).select("doc_id", F.coalesce(id_fold("doc_id", FOLDS) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
