"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Vectors of one label (and dimension) link if their cosine, in double precision, reaches the threshold. Equal vectors form a
class with a count. Unit vectors are quantised to int8 with a scale and the exact norm of what quantising lost; a product of
two quantised vectors then differs from the cosine by at most a bound that follows from these norms. Vectors lie in cells on
the first principal axes of a bounded sample (the axes only decide speed): linked vectors are at most sqrt(2 - 2 *
threshold) apart, the width of a cell, so only neighbouring cells meet. Cells are cut into blocks, pairs of blocks are tiles,
one task's memory holds one tile. Each vector is quantised once, and only its int8 form goes to the tiles, where the product
settles all pairs but those whose bound straddles the threshold. Vectors of such open pairs go to their tile a second time,
in double precision, and only the open pairs are recomputed. A tile returns one row per linked vector: how many vectors it
links with, and the root of its component within the tile, so a group of thousands of near copies returns no pairs.

Vectors that are null, empty or zero, hold null or non-finite components, or have a null label, link with nothing. Rows
that repeat an id count as vectors of their own, and tie the components that they belong to. Rows without an id get no
component. An empty table gives an empty result; other columns are carried along, and get `_in` behind their name where a
result has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.common import connected_components, one_per_id, saved, set_aside, spread_join

THRESHOLD = 0.98
#: Rows of a block; a tile is a pair of blocks.
BLOCK_ROWS = 1024
#: Sample that the axes come from.
SAMPLE, AXES = 2000, 2


def _arrays(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The vectors of a list column as float64; None for those that link with nothing."""
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else pa.array([])
    holes = flat.null_count > 0
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    at = 0
    lengths = pa.compute.list_value_length(column).to_pylist()
    for n in lengths:
        if not n:
            yield None
            continue
        x = values[at : at + n]
        at += n
        # Nulls come out as NaN.
        with np.errstate(over="ignore"):
            norm = float(np.sqrt((x / (np.abs(x).max() or 1.0)) @ (x / (np.abs(x).max() or 1.0)))) if (not holes or not np.isnan(x).any()) and np.isfinite(x).all() else 0.0
        yield x if norm > 0 else None


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max()
    return x / np.sqrt(x @ x)


def _read(axes: dict[int, np.ndarray], reach: float):
    """(row, label, embedding) -> row, label, dim (0: links with nothing), d1, d2, c0, c1 (cell), q (int8), scale, lost, body (float64)."""

    def of(x: np.ndarray) -> tuple:
        d = xxhash.xxh3_128_intdigest(x.tobytes())
        own = axes.get(len(x))
        cell = np.floor((own @ _unit(x)) / reach).astype(int).tolist() if own is not None else [0, 0]
        _, q, scale, lost = quantised(x[None])
        return (len(x), d >> 64, d & ((1 << 64) - 1), cell[0], cell[1] if len(cell) > 1 else 0, q[0].astype(np.int8).tobytes(), float(scale[0]), float(lost[0]), x.tobytes())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(1).is_valid().to_pylist()
            out = [of(x) if x is not None and ok else (0, 0, 0, 0, 0, None, None, None, None) for x, ok in zip(_arrays(batch.column(2)), known, strict=True)]
            dim, d1, d2, c0, c1, q, scale, lost, body = zip(*out, strict=True) if out else ([],) * 9
            long = lambda d: pa.array(np.array(d, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dim, pa.int32()), long(d1), long(d2), pa.array(c0, pa.int32()), pa.array(c1, pa.int32()), pa.array(q, pa.binary()), pa.array(scale, pa.float64()), pa.array(lost, pa.float64()), pa.array(body, pa.binary())],
                names=["row", "label", "dim", "d1", "d2", "c0", "c1", "q", "scale", "lost", "body"],
            )

    return rows


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """AXES orthonormal axes per dimension, from SAMPLE vectors at most."""
    got = vectors.where("label IS NOT NULL AND embedding IS NOT NULL").orderBy(F.xxhash64("id", F.lit(5))).limit(SAMPLE).select("embedding").toArrow()
    by_dim: dict[int, list[np.ndarray]] = {}
    for chunk in got.column(0).chunks:
        for x in _arrays(chunk):
            if x is not None:
                by_dim.setdefault(len(x), []).append(_unit(x))
    axes = {}
    for n, rows in by_dim.items():
        x = np.array(rows) - np.mean(rows, axis=0)
        axes[n] = np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :AXES].T)
    return axes


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows -> unit rows, int8 rows (held as float32 for exact products), scales, norms of what was lost."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    q = np.rint(unit / scale)
    lost = np.sqrt(((unit - scale * q) ** 2).sum(axis=1)) + 1e-12
    return unit, q.astype(np.float32), scale[:, 0], lost


def _int_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact: sums of up to 1000 products of int8 values stay below 2**24."""
    if a.shape[1] <= 1000:
        return a @ b.T
    return sum((a[:, i : i + 1000] @ b[:, i : i + 1000].T).astype(np.float64) for i in range(0, a.shape[1], 1000))


Quantised = tuple[np.ndarray, np.ndarray, np.ndarray]


def settled(a: Quantised, b: Quantised, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a surely link with which of b, and which pairs are open; a, b: int8 rows, scales, norms of what was lost."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    close = _int_product(qa, qb) * sa[:, None] * sb[None, :]
    bound = ea[:, None] + (1 + ea[:, None]) * eb[None, :] + 1e-9
    linked = close - bound >= threshold
    return linked, (close + bound >= threshold) & ~linked


def recomputed(ua: np.ndarray, ub: np.ndarray, open_pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Of the open pairs of unit rows those that link, in double precision."""
    if open_pairs.sum() * 8 > open_pairs.size:
        return open_pairs & ((ua @ ub.T) >= threshold)
    linked = np.zeros_like(open_pairs)
    i, j = np.nonzero(open_pairs)
    for at in range(0, len(i), 50_000):
        p, q = i[at : at + 50_000], j[at : at + 50_000]
        linked[p, q] = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold
    return linked


def _roots(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest position (rows first, then columns) reachable, of rows and of columns."""
    rows, cols = linked.shape
    far = rows + cols
    a, b = np.arange(rows), np.arange(rows, far)
    while True:
        na = np.minimum(a, np.where(linked, b[None, :], far).min(axis=1, initial=far))
        nb = np.minimum(b, np.where(linked, na[:, None], far).min(axis=0, initial=far))
        if (na == a).all() and (nb == b).all():
            return a, b
        a, b = na, nb


def _tile(threshold: float, exact: bool):
    """Rows of a tile -> id, n, root, open (the row has open pairs). exact: the rows are those of open pairs, with their bodies."""

    def solve(table: pa.Table) -> pa.Table:
        side, ids, times = (table.column(c).to_numpy() for c in ("side", "id", "times"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = bool(table.column("same")[0].as_py())
        if alone:
            right = left
        if not len(left) or not len(right):
            none = {"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "open": pa.array([], pa.bool_())}
            return pa.table(none if exact else {c: table.column(c).slice(0, 0) for c in ("tile", "same", "side", "times")} | none)
        if exact:
            body = np.array([np.frombuffer(x) for x in table.column("body").to_pylist()])
            unit, q, scale, lost = quantised(body)
        else:
            q = np.array([np.frombuffer(x, np.int8) for x in table.column("q").to_pylist()]).astype(np.float32)
            scale, lost = table.column("scale").to_numpy(), table.column("lost").to_numpy()
        of = lambda at: (q[at], scale[at], lost[at])
        linked, open_pairs = settled(of(left), of(right), threshold)
        if exact:
            linked, open_pairs = recomputed(unit[left], unit[right], open_pairs, threshold), np.zeros_like(open_pairs)
        if alone:
            for pairs in (linked, open_pairs):
                pairs |= pairs.T
                np.fill_diagonal(pairs, False)
        a, b = _roots(linked | np.eye(len(left), dtype=bool) if alone else linked)
        both = np.concatenate([left, right])
        n, undecided, root = linked @ times[right], open_pairs.any(axis=1), ids[both[a]]
        told = [(left, n, root, undecided)]
        if not alone:
            told.append((right, times[left] @ linked, ids[both[b]], open_pairs.any(axis=0)))
        who, n, root, undecided = (np.concatenate(x) for x in zip(*told, strict=True))
        keep = (n > 0) | undecided
        found = {"id": pa.array(ids[who][keep]), "n": pa.array(n[keep].astype(np.int64)), "root": pa.array(root[keep]), "open": pa.array(undecided[keep])}
        if exact:
            return pa.table(found)
        return pa.table({c: table.column(c).take(pa.array(who[keep])) for c in ("tile", "same", "side", "times")} | found)

    return solve


RESULTS = ("n_links", "component_id", "kept")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", label: str = "label", embedding: str = "embedding", threshold: float = THRESHOLD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vectors, without the embedding, with n_links, component_id and kept."""
    vectors = set_aside(vectors, RESULTS)
    label_type = vectors.schema[label].dataType.simpleString()
    carried = [c for c in vectors.columns if c != embedding]
    named = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"), F.struct(*carried).alias("row"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    axes = principal_axes(named)
    schema = f"label {label_type}, dim int, d1 long, d2 long, c0 int, c1 int, q binary, scale double, lost double, body binary"
    row_type = named.schema["row"].dataType.simpleString()
    read = named.select("row", "label", "embedding").mapInArrow(_read(axes, reach), f"row {row_type}, {schema}")
    spot, cell = ["label", "dim", "d1", "d2"], ["label", "dim", "c0", "c1"]
    first = [F.first(c).alias(c) for c in ("q", "scale", "lost", "body")]
    classes = read.where("dim > 0").groupBy(*spot, "c0", "c1").agg(F.count("*").alias("times"), *first)
    #: `id` numbers the classes.
    classes = saved(classes.select(F.monotonically_increasing_id().alias("id"), "*"), "classes")

    cells = classes.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks"))
    dealt = classes.join(cells, cell).withColumn("block", F.pmod(F.col("d1"), F.col("blocks")).cast("int"))
    blocks = cells.select(*cell, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    ahead = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]
    steps = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ahead])).alias("step")
    first = blocks.select("label", "dim", *[F.col(c).alias(f"a_{c}") for c in ("c0", "c1", "block")], steps)
    first = first.select("label", "dim", "a_c0", "a_c1", "a_block", (F.col("a_c0") + F.col("step.x")).alias("c0"), (F.col("a_c1") + F.col("step.y")).alias("c1"))
    tiles = first.join(blocks, cell)
    same_cell = (F.col("a_c0") == F.col("c0")) & (F.col("a_c1") == F.col("c1"))
    tiles = tiles.where(~same_cell | (F.col("a_block") <= F.col("block"))).withColumn("same", same_cell & (F.col("a_block") == F.col("block")))
    tile = F.concat_ws("|", *[F.col(c).cast("string") for c in ("label", "dim", "a_c0", "a_c1", "a_block", "c0", "c1", "block")])
    tiles = saved(tiles.withColumn("tile", tile), "tiles")
    own = tiles.select("label", "dim", F.col("a_c0").alias("c0"), F.col("a_c1").alias("c1"), F.col("a_block").alias("block"), "tile", "same", F.lit(0).alias("side"))
    other = tiles.where("NOT same").select(*cell, "block", "tile", "same", F.lit(1).alias("side"))
    rows = dealt.drop("body").join(own.union(other), [*cell, "block"]).select("tile", "same", "side", "id", "times", "q", "scale", "lost")
    result = "id long, n long, root long, open boolean"
    solved = saved(rows.groupBy("tile").applyInArrow(_tile(threshold, exact=False), f"tile string, same boolean, side int, times long, {result}"), "solved")
    still = solved.where("open").select("tile", "same", "side", "id", "times").join(classes.select("id", "body"), "id")
    again = still.groupBy("tile").applyInArrow(_tile(threshold, exact=True), result)
    out = saved(solved.select("id", "n", "root").union(again.select("id", "n", "root")).where("n > 0"), "links")
    sums = out.groupBy("id").agg(F.sum("n").alias("n"))
    found = connected_components(out, "id", "root")

    per_class = classes.select(*spot, "id", "times").join(sums, "id", "left").join(found, "id", "left")
    per_class = per_class.select(*spot, (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    every = saved(read.select("row", *spot), "every")
    every = saved(spread_join(every, per_class, spot, ["row"], "left").select(F.col(f"row.{id_col}").alias("id"), "row", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col(f"row.{id_col}").isNotNull(), F.col("c")).alias("c")), "placed")
    every = one_per_id(every)
    least = every.where("c IS NOT NULL").groupBy("c").agg(F.min("id").alias("least"))
    alone = F.coalesce("least", "id")
    return spread_join(every, least, ["c"], ["id"], "left").select(*[F.col(f"row.{c}").alias(c) for c in carried], F.col("n").alias("n_links"), alone.alias("component_id"), (F.col("id") == alone).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", *RESULTS)
