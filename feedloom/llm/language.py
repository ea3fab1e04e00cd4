"""Language identification by a byte convolutional network.

Text is cut into windows of WINDOW bytes (the last one padded with zeros). Bytes are embedded; filters of several widths
slide over a window; each filter's largest response over the window, rectified, feeds a softmax over the languages. A
text's scores are the mean of its windows' probabilities, each weighted by its bytes; all windows of the whole text count.
The network is trained in numpy on a bounded sample: about Sample.texts labelled texts per language, twice as many over all
languages at most (documented, by the hash of the id), of which Sample.windows windows each reach the driver. Languages are
the LANGUAGES most frequent labels at most.

Texts that are null or hold no letter get `und` and score 0. Without labelled rows every text gets `und`. Ties go to the
first language by name. Repeated rows are predicted alike, rows without an id like all others (they are not learnt from); an
empty table gives an empty result; other columns are carried along, and get `_in` behind their name where a result has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import id_fold, set_aside

WINDOW, EMBED, WIDTHS, FILTERS = 256, 6, (2, 3, 4), 8
HELD, FOLDS = 2, 4
#: Windows run through the network at a time.
BLOCK = 512
LANGUAGES = 500


@dataclass(frozen=True)
class Sample:
    """Bound of the sample that the network is trained on."""

    texts: int = 600
    windows: int = 3
    seed: int = 11


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # 256 x EMBED
    kernel: np.ndarray  # (max width * EMBED) x all filters; rows beyond a filter's width stay zero
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """windows: n x (WINDOW + widest - 1) bytes -> n x WINDOW x filters."""
        wide = max(WIDTHS)
        n = len(windows)
        x = self.embed[windows]
        stacked = np.lib.stride_tricks.as_strided(x, (n, WINDOW, wide * EMBED), (x.strides[0], x.strides[1], x.strides[2]))
        return (stacked.reshape(n * WINDOW, wide * EMBED) @ self.kernel).reshape(n, WINDOW, -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        top = np.maximum(self.responses(windows).max(axis=1) + self.bias, 0)
        z = top @ self.dense + self.shift
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, each with the bytes after it that the widest filter reaches."""
    wide = max(WIDTHS)
    n = max(1, -(-len(data) // WINDOW))
    flat = np.zeros(n * WINDOW + wide - 1, dtype=np.uint8)
    flat[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, WINDOW + wide - 1), (WINDOW, 1))


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 11, rounds: int = 5, batch: int = 64, rate: float = 0.01) -> Network:
    """Adam on the cross entropy; a filter's gradient flows through the place of its largest response."""
    rng = np.random.default_rng(seed)
    wide, filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32), EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
    net = Network(
        languages,
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (rng.normal(0, 0.3, (wide * EMBED, filters)) * mask).astype(np.float32),
        np.zeros(filters, np.float32),
        rng.normal(0, 0.2, (filters, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    names = ("embed", "kernel", "bias", "dense", "shift")
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    turn = 0
    for _ in range(rounds):
        for at in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            x, y = windows[at], labels[at]
            n = len(at)
            r = net.responses(x)
            place = r.argmax(axis=1)
            raw = np.take_along_axis(r, place[:, None, :], axis=1)[:, 0, :] + net.bias
            top = np.maximum(raw, 0)
            z = top @ net.dense + net.shift
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), y] -= 1
            z /= n
            back = (z @ net.dense.T) * (raw > 0)
            spots = x[np.arange(n)[:, None, None], place[:, :, None] + np.arange(wide)]  # n x filters x wide, bytes
            inputs = net.embed[spots].reshape(n, filters, wide * EMBED)
            grads = {"dense": top.T @ z, "shift": z.sum(0), "bias": back.sum(0), "kernel": np.einsum("nf,nfk->kf", back, inputs) * mask}
            into = (back[:, :, None] * net.kernel.T[None]).reshape(n, filters, wide, EMBED)
            grads["embed"] = np.zeros_like(net.embed)
            np.add.at(grads["embed"], spots.ravel(), into.reshape(-1, EMBED))
            turn += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                step = rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.999**turn)) + 1e-8)
                setattr(net, k, (getattr(net, k) - step).astype(np.float32))
    return net


def train(docs: DataFrame, sample: Sample = Sample(), held: int = HELD, folds: int = FOLDS) -> Network | None:
    """Train on texts with a language outside the held fold of the id."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (id_fold("doc_id", folds) != held))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not sizes:
        return None
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample.texts / n))) for k, n in sorted(sizes.items())])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(sample.seed)), F.lit(1_000_000)) / 1_000_000
    chosen = known.where(draw < share)
    spots = [F.floor(F.pmod(F.xxhash64("doc_id", F.lit(sample.seed + 1 + i)), F.greatest(F.char_length("text") - WINDOW + 1, F.lit(1)))).cast("int") + 1 for i in range(sample.windows)]
    cut = chosen.select("doc_id", "lang", F.array_distinct(F.array(*[F.substring(F.col("text"), s, F.lit(WINDOW)) for s in spots])).alias("cuts"))
    # The draw keeps about sample.texts ids of a language, but any number of rows of one id.
    cut = cut.distinct().orderBy(F.xxhash64("doc_id", "lang", F.lit(sample.seed)), "doc_id", "lang", "cuts").limit(2 * sample.texts * len(sizes))
    got = sorted((r["doc_id"], r["lang"], c) for r in cut.collect() for c in r["cuts"])
    languages = sorted(sizes)
    data = np.stack([windows_of(c.encode("utf-8", "replace")[:WINDOW])[0] for _, _, c in got])
    return fit(data, np.array([languages.index(k) for _, k, _ in got]), languages, sample.seed)


def identified(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    docs = set_aside(docs, ("lang_pred", "score"))
    if net is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame(_predict_all(net, list(texts)), columns=["lang_pred", "score"])

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    guess = docs.withColumn("__guess", predict(F.when(letters, F.col(text)).otherwise(F.lit(""))))
    keep = docs.columns
    return guess.select(*keep, F.when(letters, F.col("__guess.lang_pred")).otherwise("und").alias("lang_pred"), F.when(letters, F.col("__guess.score")).otherwise(0.0).alias("score"))


def _predict_all(net: Network, texts: list[str | None]) -> list[tuple[str, float]]:
    """Windows of many texts share blocks; at most BLOCK windows are in the network at a time."""
    out: list[tuple[str, float]] = []
    sums = np.zeros((len(texts), len(net.languages)))
    weight = np.zeros(len(texts))
    held, owners, sizes = [], [], []

    def flush() -> None:
        if held:
            rows = np.concatenate(held)
            who, size = np.concatenate(owners), np.concatenate(sizes)
            for a in range(0, len(rows), BLOCK):
                p = net.probabilities(rows[a : a + BLOCK]) * size[a : a + BLOCK, None]
                np.add.at(sums, who[a : a + BLOCK], p)
            np.add.at(weight, who, size)
            held.clear(), owners.clear(), sizes.clear()

    waiting = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        rows = windows_of(data)
        size = np.full(len(rows), float(WINDOW))
        size[-1] = max(1, len(data) - (len(rows) - 1) * WINDOW)
        held.append(rows), owners.append(np.full(len(rows), i)), sizes.append(size)
        waiting += len(rows)
        if waiting >= 8 * BLOCK:
            flush()
            waiting = 0
    flush()
    for i in range(len(texts)):
        p = sums[i] / max(weight[i], 1e-9)
        k = int(p.argmax())
        out.append((net.languages[k], float(min(1.0, max(0.0, p[k])))))
    return out


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = train(docs.select("doc_id", "text", "lang"))
    found = identified(docs.select("doc_id", "text"), net)
    return found.select("doc_id", F.coalesce(id_fold("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
