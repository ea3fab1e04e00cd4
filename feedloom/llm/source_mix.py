"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in an order of their own (by the hash of the id) and cut into blocks. A source of weight w
(its share of all slots) may place its j-th block (from 0) no sooner than slot floor(j/w) and no later than slot
ceil((j+1)/w)-1; every slot goes to the block with the earliest deadline among those released. So after any number of
slots a source has had its share of them to within less than one block. Weights are whole numbers out of one period, the
schedule of one period is a small table, and every period repeats it, so a document's slot and its position follow from
its rank within its source alone. When a source has no more blocks its slots stay empty and the others keep their order.

Every document is placed exactly once. Documents without a source are a source of their own. Rows that share an id are ordered
by the hash of all their columns, as are rows without an id, so a task that runs again places them alike; rows equal in every
column may stand for each other. An empty table gives an empty result; other columns are carried along, and get `_in` behind
their name where a result has it. At most SOURCES sources may be mixed: more are refused, as the schedule holds a count per
slot and source.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import set_aside

PERIOD = 1000
BLOCK_ROWS = 64
#: Rows per ranking bucket at least, and how many buckets there are at most.
BUCKET_ROWS, BUCKETS = 256, 50_000
SOURCES = 500
RESULTS = ("mix_source_rank", "mix_block", "mix_slot", "mix_position")


def whole_shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots out of a period for each source: its weight's share by largest remainder, one at least."""
    period = max(period, 10 * len(weights))
    total = sum(weights.values())
    exact = {k: (w / total if total else 1 / len(weights)) * period for k, w in weights.items()}
    shares = {k: max(1, int(x)) for k, x in exact.items()}
    for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], k)):
        if sum(shares.values()) < period:
            shares[k] += 1
    for k in sorted(shares, key=lambda k: (-shares[k], k)):
        shares[k] -= min(shares[k] - 1, max(0, sum(shares.values()) - period))
    return shares


def pfair_slots(shares: dict[str, int]) -> list[str]:
    """The source of each slot of one period: earliest deadline first among released blocks."""
    period = sum(shares.values())
    waiting = [(0, -(-period // a), k, 0) for k, a in shares.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots = []
    for now in range(period):
        while waiting and waiting[0][0] <= now:
            _, deadline, k, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, k, j))
        _, k, j = heapq.heappop(ready)
        slots.append(k)
        if j + 1 < shares[k]:
            heapq.heappush(waiting, ((j + 1) * period // shares[k], -(-(j + 2) * period // shares[k]), k, j + 1))
    return slots


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))


def temper(counts: dict[str, int], alpha: float = 0.5) -> dict[str, float]:
    """Target weights from the sources' sizes: size to the power alpha, so that small sources are heard more."""
    return {k: float(n) ** alpha for k, n in counts.items()}


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source: str = "source", block_rows: int = BLOCK_ROWS, period: int = PERIOD) -> DataFrame:
    """docs with mix_source_rank, mix_block, mix_slot and mix_position (all long); position counts from 0 without gaps.

    weights: target weight by source; sources not named get the least weight named. None: temper() of the sources' sizes.
    The number of sources is taken to be small (their names and sizes reach the driver); documents are not collected.
    """
    spark, docs = docs.sparkSession, set_aside(docs, RESULTS)
    keyed = docs.withColumn("__source", _source_key(source))
    counts = {r["__source"]: r["n"] for r in keyed.groupBy("__source").agg(F.count("*").alias("n")).limit(SOURCES + 1).collect()}
    if len(counts) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    if not counts:
        return docs.select("*", *[F.lit(0).cast("long").alias(c) for c in RESULTS])
    if weights is None:
        target = temper(counts)
    else:
        named = {"-" if k is None else f"={k}": float(w) for k, w in weights.items()}
        target = {k: named.get(k, min(named.values())) for k in counts}
    shares = whole_shares(target, period)
    names = sorted(shares)
    slots = pfair_slots(shares)

    done, rows = dict.fromkeys(names, 0), []
    for at, k in enumerate(slots):
        rows.append((k, done[k], at, [done[n] for n in names]))
        done[k] += 1
    #: One row per slot of a period: bounded by the period and the number of sources.
    plan = spark.createDataFrame(rows, "__source string, __turn int, __at long, __before array<long>")
    of_source = spark.createDataFrame([(k, shares[k], max(1, -(-counts[k] // max(BUCKET_ROWS, sum(counts.values()) // BUCKETS)))) for k in names], "__source string, __share long, __buckets long")

    hashable = [F.col(f.name) for f in docs.schema if not isinstance(f.dataType, T.MapType)]
    tie = F.xxhash64(*hashable)
    named = F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), tie.cast("string"))
    placed = keyed.join(F.broadcast(of_source), "__source").withColumn("__hash", F.sha2(named, 256)).withColumn("__tie", tie)
    placed = placed.withColumn("__bucket", F.floor(F.conv(F.substring("__hash", 1, 8), 16, 10).cast("long") * F.col("__buckets") / F.lit(2**32)))
    sizes = placed.groupBy("__source", "__bucket").agg(F.count("*").alias("n"))
    before = sizes.select("__source", "__bucket", (F.sum("n").over(Window.partitionBy("__source").orderBy("__bucket")) - F.col("n")).alias("__first"))
    inside = Window.partitionBy("__source", "__bucket").orderBy("__hash", "__tie")
    ranked = placed.withColumn("__rank", F.row_number().over(inside)).join(before, ["__source", "__bucket"])

    total = F.array(*[F.lit(counts[n]).cast("long") for n in names])
    share = F.array(*[F.lit(shares[n]).cast("long") for n in names])
    rank = (F.col("__first") + F.col("__rank") - 1).cast("long")
    numbered = ranked.withColumn("mix_source_rank", rank).withColumn("mix_block", F.floor(F.col("mix_source_rank") / block_rows))
    numbered = numbered.withColumn("__cycle", F.floor(F.col("mix_block") / F.col("__share"))).withColumn("__turn", (F.col("mix_block") % F.col("__share")).cast("int"))
    slotted = numbered.join(F.broadcast(plan), ["__source", "__turn"])
    slot = F.col("__cycle") * F.lit(len(slots)) + F.col("__at")
    ahead = F.aggregate(
        F.zip_with(F.zip_with(share, F.col("__before"), lambda a, b: (F.col("__cycle") * a + b) * F.lit(block_rows)), total, lambda a, n: F.least(a, n)),
        F.lit(0).cast("long"),
        lambda acc, x: acc + x,
    )
    out = slotted.withColumn("mix_slot", slot).withColumn("mix_position", ahead + F.col("mix_source_rank") % block_rows)
    return out.select(*docs.columns, *RESULTS)


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)
