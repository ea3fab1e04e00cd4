"""Hard negatives against every anchor by every row."""

import math
import random

import numpy as np
import pytest

from feedloom.llm import hard_negatives
from pyspark.sql import functions as F

ROWS = "id long, label int, embedding array<double>, anchor boolean, uid string"


def brute(rows, k=5):
    """rows of id, label, embedding, anchor, in the order of their numbers."""
    sound = [(i, l, [math.floor(256 * x) for x in e], a) for i, l, e, a in rows if i is not None and l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for n, (i, l, e, a) in enumerate(sound):
        if not a:
            continue
        scored = [(-sum(x * y for x, y in zip(e, f)), j, l == m) for p, (j, m, f, _) in enumerate(sound) if p != n and len(e) == len(f)]
        for s, j, _ in sorted(x for x in scored if x[2])[:k]:
            fit = sorted((t, m) for t, m, same in scored if not same and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(i, j, r, m, -s, -t) for r, (t, m) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(parts)
    df = df.select("id", "label", hard_negatives.whole_numbers(F.col("embedding")).alias("v"), "anchor", "uid")
    return sorted(map(tuple, hard_negatives.mined(df).collect()))


def table(seed, n, dim=6, spread=0.6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(4)]
    return [(i, rng.randrange(3), [x + rng.gauss(0, spread) for x in rng.choice(centres)], i % 10 == 0) for i in range(n)]


@pytest.mark.parametrize("sizes", [(8192, 4096, 256, 8), (32, 5, 4, 2)])
def test_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("TILE_ROWS", "ANCHOR_ROWS", "LEAF", "FANOUT"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = table(11, 300)
    # Ties, equal vectors, vectors that link with nothing, another length, and a label of one row.
    rows += [(1000 + i, i % 2, [1.0] * 6, i % 9 == 0) for i in range(60)]
    rows += [(2000, None, [1.0] * 6, True), (2010, 1, None, True), (2020, 1, [1.0, None] * 3, True), (2030, 1, [1.0, float("nan")] * 3, True), (None, 1, [1.0] * 6, True), (2040, 9, [1.0] * 6, True), (2050, 1, [float("inf")] * 6, False)]
    rows += [(3000 + i, i % 2, [0.1 * i, 1.0], i == 0) for i in range(12)] + [(4000, 1, [], True), (4001, 1, [], False), (4002, 2, [], False)]
    rows += [(5000, 1, [0.0] * 6, True), (5001, 1, [0.0] * 6, False), (5002, 2, [0.0] * 6, False)]
    assert mined(spark, rows) == brute(rows)


def test_repeated_rows_and_ids(spark):
    rows = table(3, 80) + table(3, 80)[:30] + [(0, 1, [2.0] * 6, True), (0, 2, [2.0] * 6, True)]
    assert mined(spark, rows, 1) == brute(rows)


def test_components_beyond_exact_doubles(spark):
    big = float(1 << 22)
    rows = [(i, i % 2, [big + i, 1.0 + i, big - 2 * i], i % 5 == 0) for i in range(40)]
    want = brute(rows)
    assert 1 << 53 < max(r[4] for r in want) < 1 << 63 and mined(spark, rows) == want


def test_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0], False)]) == []


def test_bounds_hold_every_score_and_prune():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(-20, 20, (700, 8)) + c for c in rng.integers(-300, 300, (9, 8))]).astype(float)
    v = v[hard_negatives.str_order(v, [0, 1, 2], np.arange(len(v)))]
    tree, q = hard_negatives.Tree(v), rng.integers(-300, 300, (20, 8)).astype(float)
    (low, high), (leaf_low, leaf_high) = tree.bounds(q)
    scores = q @ v.T
    for j, at in enumerate(tree.starts):
        own = scores[:, at : at + hard_negatives.LEAF]
        assert (leaf_low[:, j] <= own.min(axis=1)).all() and (own.max(axis=1) <= leaf_high[:, j]).all()
    ids, read = np.arange(len(v)), 0
    for i in range(len(q)):
        best = hard_negatives.Best(-float("inf"), float("inf"), 5)
        read += hard_negatives.search(tree, q[i], [(a[i], b[i]) for a, b in ((low, high), (leaf_low, leaf_high))], [best], np.ones(len(v), bool), ids, ids)
        assert [(-s, x) for s, x, _ in best.rows] == sorted(((int(s), x) for x, s in enumerate(scores[i])), key=lambda r: (-r[0], r[1]))[:5]
    assert read < len(q) * len(tree.starts) / 2
