"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session. Where it is unset a local session (tests) gets a folder of its own; a cluster must name one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="feedloom-")
        context.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/feedloom/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    # Small row groups keep what a task buffers small, also where rows are long.
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what saved() wrote, once nothing reads it any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Python workers get batches of so many rows at most while this holds: for tables whose rows are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def set_aside(df: DataFrame, results: Iterable[str]) -> DataFrame:
    """df with the columns that bear the name of a result renamed: `_in` is put behind such a name until it is free.

    Names that start with two underscores are the operators' own: a table that has such a column is refused.
    """
    taken = {c.lower() for c in df.columns}
    if own := sorted(c for c in taken if c.startswith("__")):
        raise ValueError(f"columns that start with two underscores are reserved: {own}")
    names, results = [], {r.lower() for r in results}
    for c in df.columns:
        name = c
        while name.lower() in results or (name != c and name.lower() in taken):
            name += "_in"
        taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)


#: Rows of one key that go to one task of a join, and how many keys at most are dealt to several tasks.
KEY_ROWS, HOT_KEYS = 2000, 1000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: list[str], how: str = "inner", counts: DataFrame | None = None, rows: int = KEY_ROWS, sized: DataFrame | None = None, total: int | None = None, most: int | None = None) -> DataFrame:
    """left joined with right, which has one row per key: keys that many rows of left share are dealt to several tasks.

    left must be saved, or sized be a saved table with as many rows of each key, or counts and total be given. The keys of more than a thousandth of its rows are HOT_KEYS at most, so their table may be broadcast; their
    row of right is repeated once per task. `by` deals the rows of a key. counts: (key, __rows), where the caller has them.
    most: a bound of the rows of any key; where it is low enough nothing is counted.
    """
    sized = left if sized is None else sized
    n = sized.count() if total is None else total
    limit = max(rows, n // HOT_KEYS)
    if n <= limit or (most is not None and most <= limit):
        return left.join(right, on, how)
    if counts is None:
        counts = sized.groupBy(*on).agg(F.count("*").alias("__rows"))
    hot = counts.where(F.col("__rows") > limit).select(*on, F.ceil(F.col("__rows") / F.lit(limit)).cast("int").alias("__parts"))
    # So few keys that one query may bring them here: most often there are none, and nothing need be written and read.
    found = hot.collect()
    if not found:
        return left.join(right, on, how)
    hot = left.sparkSession.createDataFrame(found, hot.schema)
    salt = F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*by), F.col("__parts"))).otherwise(0).cast("int")
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).drop("__parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    repeated = right.join(F.broadcast(hot), on, "left").withColumn("__salt", copies).drop("__parts")
    return dealt.join(repeated, [*on, "__salt"], how).drop("__salt")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_fold(column: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string")) % F.lit(folds)


#: Bits of a map of marked keys: BITS_PER_KEY and more, between these bounds (32 MB). A fuller map lets more rows through and loses none.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 22, 1 << 28


def bitmap_of(keys: DataFrame, key: str = "key", bits: int | None = None) -> np.ndarray:
    """One bit per 64-bit key of a saved table, by the key's low bits: at most bits / 64 rows reach the driver."""
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_KEY * keys.count()).bit_length()))
    cells = keys.select(F.shiftright(F.col(key).bitwiseAND(F.lit(bits - 1)), 6).alias("cell"), F.expr(f"shiftleft(1L, cast({key} & 63 as int))").alias("bit"))
    got = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got.column("cell").to_numpy().astype(np.int64)] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    spot = keys & np.uint64(len(bitmap) * 64 - 1)
    return ((bitmap[spot >> np.uint64(6)] >> (spot & np.uint64(63))) & np.uint64(1)) == 1


def marked_rows(df: DataFrame, key: str, bitmap: np.ndarray) -> DataFrame:
    """Rows whose 64-bit key may be in the bitmap; no marked row is lost."""
    at = df.columns.index(key)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(in_bitmap(bitmap, keys)))

    return df.mapInArrow(rows, df.schema)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every vertex of the undirected edges; component is the smallest id reachable.

    Local contraction: each vertex points to the vertex of lowest priority among its neighbours and itself, the pointers
    are followed once more, edges are redrawn between what they point at, and the vertices' pointers are composed. Odd
    rounds take the id as priority (stars collapse at once), even ones a hash (chains shrink by a constant factor). Each
    round is map-side combined minima and joins over the remaining edges; a hub's edges are dealt to several tasks.
    Loops and repeated edges are fine; null ends are dropped; no edges give no rows.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    left = saved(edges.distinct(), "edges")
    ends = left.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = saved(ends.select("id", F.col("id").alias("root")), "labels")
    every = labels.count()
    turn = 0
    while True:
        proper = left.where("a <> b")
        priority = F.lit(0) if turn % 2 == 0 else None

        def rank(c: str, priority=priority, turn=turn) -> Column:
            return F.struct((F.xxhash64(c, F.lit(turn)) if priority is None else priority).alias("k"), F.col(c).alias("id"))

        both = proper.union(proper.select("b", "a"))
        nearest = both.groupBy("a").agg(F.min(rank("b")).alias("n"), F.count("*").alias("degree"))
        step = saved(nearest.select(F.col("a").alias("v"), F.least("n", rank("a"))["id"].alias("p"), "degree"), "step")
        # One query says how many vertices and edges are left and how large the largest hub is; the round's joins count no more.
        vertices, halves, hub = step.agg(F.count("*"), F.sum("degree"), F.max("degree")).first()
        if not vertices:
            break
        further = step.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        # A vertex is pointed at by its neighbours and itself alone.
        followed = spread_join(step, further, ["p"], ["v"], "left", total=vertices, most=hub + 1)
        point = saved(followed.select("v", F.coalesce("pp", "p").alias("p"), "degree"), "point")
        of_a, of_b = (point.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        degrees = lambda c: point.select(F.col("v").alias(c), F.col("degree").alias("__rows"))
        half = spread_join(proper, of_a, ["a"], ["b"], counts=degrees("a"), total=halves // 2, most=hub)
        redrawn = spread_join(half, of_b, ["b"], ["a"], counts=degrees("b"), total=halves // 2, most=hub).where("pa <> pb")
        redrawn = saved(redrawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        moved = spread_join(labels, point.select(F.col("v").alias("root"), "p"), ["root"], ["id"], "left", total=every)
        moved = saved(moved.select("id", F.coalesce("p", "root").alias("root")), "labels")
        discard(left, labels, step, point)
        left, labels = redrawn, moved
        turn += 1
    discard(left, step)
    smallest = labels.groupBy("root").agg(F.min("id").alias("component"))
    return spread_join(labels, smallest, ["root"], ["id"], total=every).select("id", "component")


def one_per_id(rows: DataFrame) -> DataFrame:
    """rows (saved: id, c and others) with the components c that meet in one id made one; rows of such an id without c get it."""
    several = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("b"), (F.count("c") < F.count("*")).alias("blank"))
    several = saved(several.where("a <> b OR (blank AND a IS NOT NULL)"), "several")
    if several.isEmpty():
        return rows
    shared = rows.where("c IS NOT NULL").join(several.select("id", F.col("a").alias("to")), "id")
    joint = connected_components(shared.select(F.col("c").alias("a"), F.col("to").alias("b")).distinct()).withColumnRenamed("id", "c")
    others = [x for x in rows.columns if x != "c"]
    owned = saved(spread_join(rows, several.select("id", F.col("a").alias("own")), ["id"], others, "left").select(*others, F.coalesce("c", "own").alias("c")), "owned")
    return saved(spread_join(owned, joint, ["c"], others, "left").select(*others, F.coalesce("component", "c").alias("c")), "joint")
