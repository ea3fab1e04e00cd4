"""Hard-negative mining over STR-packed R-trees.

Vectors of whole numbers are packed by sort-tile-recursive: cuts on the two axes of greatest spread, taken from a bounded sample
(they only decide speed), place every vector in a cell; a cell is dealt to as many tiles as keep a tile at about TILE_ROWS.
Within a tile the rows are sorted into slabs, axis by axis, so that runs of LEAF rows are leaves and runs of FANOUT leaves are
nodes, each with its minimum bounding box. An anchor's inner product with anything inside a box lies between the sums, over the
coordinates, of the least and the greatest product with the box's ends. A queue hands out boxes by greatest possible score;
boxes outside all score windows, or strictly below the kth score of a window that has k, are dropped unread. What is left is
scored exactly: in double precision where all sums stay below 2**53, else in whole numbers of any size.

Anchors are packed into blocks as well. Every block meets every tile in a group of its own, one block and one tile at a time
(the stated queries against all rows, in blocks), and gives at most k rows per anchor and window, which are merged by anchor.
The first pass finds each anchor's positives, the second its negatives, in one window per positive.

Rows without id or label, or with a null vector, or a null or non-finite component take no part; vectors of different length do
not meet. Repeated rows are rows of their own: a copy of an anchor is its positive, and ties of equal ids are broken by a number
that rows get. Equal vectors are dealt to several cells by a fraction that their ids add. Components and scores beyond a long
stay at its ends. Other columns are not read, so no name can clash; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import saved, small_batches

K = 5
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 80, 100
SCALE = 256
#: Rows of a tile, of a block of anchors, of a leaf, and leaves of a node.
TILE_ROWS, ANCHOR_ROWS, LEAF, FANOUT = 8192, 4096, 256, 8
#: Rows that the cuts come from, and cells per axis at most.
SAMPLE, SLABS = 20_000, 20
#: Axes that a tile's rows are sorted by.
AXES = 3

LONGS = (-(1 << 63), (1 << 63) - 1)


def whole_numbers(embedding: Column) -> Column:
    """floor(SCALE * x) per component; null where any component is null or not finite."""
    sound = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE)))))


def _fraction(ids: np.ndarray) -> np.ndarray:
    """A number from 0 to below 1 per id, which tells equal values apart and changes no order of whole numbers."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(12)).astype(np.float64) / float(1 << 52)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


class Cuts:
    """Per length of vectors: the axes, the cuts of the first and, for each slab, those of the second."""

    def __init__(self, sample: pa.Table, rows: int):
        self.by_dim: dict[int, tuple[list[int], np.ndarray, np.ndarray]] = {}
        for dim in pa.compute.unique(sample.column("dim")).to_pylist() if sample.num_rows else []:
            own = sample.filter(pa.compute.equal(sample.column("dim"), dim))
            slabs = min(SLABS, int(np.ceil(np.sqrt(max(1, rows * len(own) // sample.num_rows // TILE_ROWS)))))
            if dim < 2 or slabs < 2:
                continue
            v = _matrix(own.column("v").combine_chunks(), dim).astype(np.float64)
            axes = np.argsort(-v.var(axis=0), kind="stable")[:2].tolist()
            v = v[:, axes] + _fraction(own.column("uid").to_numpy())[:, None]
            first = np.quantile(v[:, 0], np.arange(1, slabs) / slabs)
            slab = np.searchsorted(first, v[:, 0], "right")
            second = np.array([np.quantile(v[slab == s, 1] if (slab == s).any() else v[:, 1], np.arange(1, slabs) / slabs) for s in range(slabs)])
            self.by_dim[dim] = (axes, first, second)

    def cells(self, dim: int) -> int:
        return len(self.by_dim[dim][2]) ** 2 if dim in self.by_dim else 1

    def of(self, v: np.ndarray, uid: np.ndarray) -> np.ndarray:
        if v.shape[1] not in self.by_dim:
            return np.zeros(len(v), np.int64)
        axes, first, second = self.by_dim[v.shape[1]]
        x = v[:, axes].astype(np.float64) + _fraction(uid)[:, None]
        slab = np.searchsorted(first, x[:, 0], "right")
        return slab * len(second) + (second[slab] <= x[:, 1:]).sum(axis=1)


def _celled(cuts: Cuts):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                cell[at] = cuts.of(_matrix(batch.column("v").take(pa.array(at)), dim), batch.column("uid").to_numpy()[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return rows


def str_order(v: np.ndarray, axes: list[int], uid: np.ndarray) -> np.ndarray:
    """Positions of the rows, slab by slab on each axis in turn, so that runs of LEAF rows lie close together."""

    def sort(at: np.ndarray, axes: list[int]) -> list[np.ndarray]:
        if len(at) <= LEAF or not axes:
            return [at]
        at = at[np.lexsort((uid[at], v[at, axes[0]]))]
        slabs = int(np.ceil((len(at) / LEAF) ** (1 / len(axes))))
        size = -(-len(at) // slabs // LEAF) * LEAF or LEAF
        return [x for i in range(0, len(at), size) for x in sort(at[i : i + size], axes[1:])]

    return np.concatenate(sort(np.arange(len(v)), axes)) if len(v) else np.arange(0)


def _packed(key: tuple, table: pa.Table, names: list[str]) -> pa.Table:
    """A group of rows as one row, in the order of the tree."""
    dim, uid = key[0].as_py(), table.column("uid").to_numpy()
    v = _matrix(table.column("v").combine_chunks(), dim)
    order = str_order(v, np.argsort(-v.astype(np.float64).var(axis=0), kind="stable")[:AXES].tolist(), uid)
    kept = table.take(pa.array(order))
    kind = next(k for k in ("<i2", "<i4", "<i8") if not v.size or (np.iinfo(k).min <= v.min() and v.max() <= np.iinfo(k).max))
    fields = {n: [x.as_py()] for n, x in zip(names, key, strict=True)}
    lists = {n: pa.array([kept.column(n).to_pylist()], pa.list_(table.schema.field(n).type)) for n in table.schema.names if n not in names and n != "v"}
    return pa.table({n: pa.array(x, table.schema.field(n).type) for n, x in fields.items()} | lists | {"kind": pa.array([kind]), "body": pa.array([v[order].astype(kind).tobytes()], pa.binary())})


class Tree:
    """Rows in the order of their leaves, with the boxes of leaves and of nodes."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.starts = np.arange(0, len(v), LEAF)
        leaf = [f.reduceat(v, self.starts, axis=0) for f in (np.minimum, np.maximum)]
        self.firsts = np.arange(0, len(self.starts), FANOUT)
        node = [f.reduceat(b, self.firsts, axis=0) for f, b in zip((np.minimum, np.maximum), leaf, strict=True)]
        self.boxes = (tuple(node), tuple(leaf))

    def bounds(self, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and greatest possible inner product of each row of q with each box, of nodes and of leaves."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return [(up @ low.T + down @ high.T, up @ high.T + down @ low.T) for low, high in self.boxes]


class Best:
    """The k best of a window: higher scores first, ties by id, then by number."""

    def __init__(self, low: float, high: float, k: int):
        self.low, self.high, self.k = low, high, k
        self.rows: list[tuple] = []

    def wants(self, least: float, greatest: float) -> bool:
        return greatest >= self.low and least <= self.high and (len(self.rows) < self.k or greatest >= -self.rows[-1][0])

    def take(self, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        floor = max(self.low, -self.rows[-1][0]) if len(self.rows) == self.k else self.low
        at = np.flatnonzero((scores >= floor) & (scores <= self.high))
        if len(at) > 4 * self.k:
            # All that tie with the kth stay.
            at = at[scores[at] >= np.partition(scores[at], len(at) - self.k)[len(at) - self.k]] if scores.dtype != object else at
        if len(at):
            self.rows = sorted([*self.rows, *((-int(scores[i]), int(ids[i]), int(uids[i])) for i in at)])[: self.k]


def search(tree: Tree, q: np.ndarray, bounds: list[tuple[np.ndarray, np.ndarray]], windows: list[Best], allowed: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> int:
    """Fill the windows of one anchor; the number of leaves read. bounds: the anchor's row of the tree's bounds."""
    (low, high), (leaf_low, leaf_high) = bounds
    queue = [(-high[i], 0, i) for i in range(len(high))]
    heapq.heapify(queue)
    read = 0
    while queue:
        top, level, i = heapq.heappop(queue)
        if not any(w.wants((low, leaf_low)[level][i], -top) for w in windows):
            continue
        if level == 0:
            for j in range(tree.firsts[i], min(tree.firsts[i] + FANOUT, len(tree.starts))):
                if any(w.wants(leaf_low[j], leaf_high[j]) for w in windows):
                    heapq.heappush(queue, (-leaf_high[j], 1, j))
            continue
        read += 1
        own = slice(tree.starts[i], tree.starts[i] + LEAF)
        ok = np.flatnonzero(allowed[own])
        if len(ok):
            scores = tree.v[own][ok] @ q
            for w in windows:
                w.take(scores, ids[own][ok], uids[own][ok])
    return read


def _open(table: pa.Table) -> tuple[np.ndarray, dict[str, list]]:
    row = table.slice(0, 1).to_pylist()[0]
    return np.frombuffer(row["body"], row["kind"]).reshape(len(row["uid"]), row["dim"]), row


def _met(k: int, negatives: bool):
    """A tile and a block of anchors -> anchor's number, window, score, id and number of what was found."""

    def rows(key: tuple, tile: pa.Table, block: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if tile.num_rows and block.num_rows:
            (v, of), (q, by) = _open(tile), _open(block)
            limit = v.shape[1] * max(1, int(np.abs(v.astype(object)).max(initial=0))) * max(1, int(np.abs(q.astype(object)).max(initial=0)))
            kind = np.float64 if limit < 1 << 53 else object
            v, q = v.astype(kind), q.astype(kind)
            tree = Tree(v)
            bounds = tree.bounds(q)
            label, ids, uids = np.array(of["label"], object), np.array(of["id"], np.int64), np.array(of["uid"], np.int64)
            same = {x: label == x for x in set(by["label"])}
            for i, (uid, own) in enumerate(zip(by["uid"], by["label"], strict=True)):
                if negatives:
                    scores = by["positives"][i]
                    # The least whole number that is LOW hundredths of the score or more.
                    windows = [Best(-((-LOW * s) // HIGH), s, k) for s in scores]
                    allowed = ~same[own]
                else:
                    windows, allowed = [Best(-float("inf"), float("inf"), k)], same[own] & (uids != uid)
                search(tree, q[i], [(a[i], b[i]) for a, b in bounds], windows, allowed, ids, uids)
                found += [(uid, n, min(max(-s, LONGS[0]), LONGS[1]), x, u) for n, w in enumerate(windows) for s, x, u in w.rows]
        columns = list(zip(*found, strict=True)) if found else [[]] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("anchor", "window", "score", "id", "uid"), columns, (pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)})

    return rows


FOUND = "anchor long, window int, score long, id long, uid long"


def _nearest(tiles: DataFrame, blocks: DataFrame, per_cell: int, cuts: Cuts, n_blocks: int, k: int, negatives: bool) -> DataFrame:
    """The k best of each anchor and window over all tiles."""
    cells = F.create_map(*[x for d in cuts.by_dim for x in (F.lit(d), F.lit(cuts.cells(d)))]) if cuts.by_dim else None
    count = (F.coalesce(F.try_element_at(cells, F.col("dim")), F.lit(1)) if cells is not None else F.lit(1)) * F.lit(per_cell)
    every = tiles.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = blocks.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)))
    key = ("dim", "tile", "block")
    met = every.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(_met(k, negatives), FOUND)
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "uid")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(rows: DataFrame, k: int = K) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from id (long), label, v (whole numbers) and anchor."""
    spark = rows.sparkSession
    sound = rows.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").select(F.monotonically_increasing_id().alias("uid"), F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("v").cast("array<long>").alias("v"), F.col("anchor").alias("is_anchor"), F.size("v").alias("dim"))
    base = saved(sound, "vectors")
    n_rows, n_anchors = base.agg(F.count("*"), F.count_if("is_anchor")).first()
    cuts = Cuts(base.orderBy(F.xxhash64("uid", F.lit(11))).limit(SAMPLE).select("uid", "dim", "v").toArrow(), n_rows)
    celled = saved(base.mapInArrow(_celled(cuts), "uid long, id long, label string, v array<long>, is_anchor boolean, dim int, cell long"), "cells")
    largest = celled.groupBy("dim", "cell").count().agg(F.max("count")).first()[0] or 0
    per_cell, n_blocks = max(1, -(-largest // TILE_ROWS)), max(1, -(-n_anchors // ANCHOR_ROWS))
    tile = F.col("cell") * per_cell + F.pmod(F.xxhash64("uid"), F.lit(per_cell))
    packed = "uid array<long>, id array<long>, label array<string>, kind string, body binary"
    keyed = celled.select("dim", tile.alias("tile"), "uid", "id", "label", "v")
    with small_batches(spark, 1000):
        tiles = saved(keyed.groupBy("dim", "tile").applyInArrow(lambda key, x: _packed(key, x, ["dim", "tile"]), f"dim int, tile long, {packed}"), "tiles")
    anchors = celled.where("is_anchor").select("dim", F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("int").alias("block"), "uid", "id", "label", "v")
    blocks = anchors.groupBy("dim", "block").applyInArrow(lambda key, x: _packed(key, x, ["dim", "block"]), f"dim int, block int, {packed}")
    positives = saved(_nearest(tiles, blocks, per_cell, cuts, n_blocks, k, negatives=False).select("anchor", F.col("rank").alias("place"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    # At most k of each anchor.
    own = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    asking = anchors.join(own.withColumnRenamed("anchor", "uid"), "uid").select("dim", "block", "uid", "id", "label", "positives", "v")
    again = asking.groupBy("dim", "block").applyInArrow(lambda key, x: _packed(key, x, ["dim", "block"]), "dim int, block int, uid array<long>, id array<long>, label array<string>, positives array<array<long>>, kind string, body binary")
    negatives = _nearest(tiles, again, per_cell, cuts, n_blocks, k, negatives=True).select("anchor", (F.col("window") + 1).alias("place"), "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
    named = anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    return negatives.join(positives, ["anchor", "place"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; where it is divisible by 7, the next label is taken."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.select(F.col("vec_id").alias("id"), label.alias("label"), whole_numbers(F.col("embedding")).alias("v"), (F.col("vec_id") % 100 == 0).alias("anchor")))
