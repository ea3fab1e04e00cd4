"""Exact Jaccard self-join of documents' word n-gram sets, by partitioning the universe of n-grams.

Sets of sizes r <= s with 100 * intersection >= PERCENT * union differ in at most H(r) = floor(r * (100 - PERCENT) /
PERCENT) elements. Sizes fall into bands; a band has its own number of segments, to which n-grams are dealt by their hash,
so the H(r)+1 differences that would be needed to break a link cannot touch everything: if a set spends H(r)+1 units of
cover on segments, one unit for "this segment is equal" and a second one for "this segment is equal up to one deletion",
each partner of its size or larger meets it in at least one of them (pigeonhole).

1. The sets of all rows are found once and kept as sorted hashes. Rows of equal sets form a class; classes are the vertices,
   so rows that share an id keep sets of their own, and are only brought together when components are named.
2. Classes emit a hashed key per segment, in their own band and in the band below where smaller partners may be, and in a
   few segments of each band (in all of them, for small sets) also the keys of the segment with one n-gram left out. Keys
   are counted with map-side combining.
3. Each class spends its cover where the counts say it is cheapest; keys that nobody else has cost nothing, and a class
   that can pay with those alone has no partner. Only keys that were paid for go on. A class that cannot buy enough cover
   (next to impossible by the choice of segments) is compared with its whole band.
4. Within a key, members are verified against one leader and links are joined to components, so a large group of near
   copies costs a comparison per member, not all pairs.
5. Keys that still hold several components are finished in blocks: members outside the key's largest component against
   all its members. A tile of two blocks compares counts of n-grams by hash (a lower bound of the difference of two sets)
   and returns only pairs of different components that may still be linked: first the closest one of each row, and once
   these are verified and joined, all that are left. No link between different components is missed.

Words are runs other than space and 0x09-0x0D after lower-casing A-Z. Fewer words than the n-gram's length make one n-gram;
none, or a null text, make none, and such documents link with nothing. Rows that repeat an id are one document of several
texts: it links by each of them, and all its rows get one component. Rows without an id link with nothing and get no
component; an empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import bitmap_of, connected_components, discard, in_bitmap, marked_rows, one_per_id, saved, small_batches, spread_join
from feedloom.llm.hashing import BASES, ByteWords, Powers, Sequence, mix, signed

WIDTH, PERCENT = 4, 85
#: Deletion neighbourhoods cover all segments of bands up to this size, and this many segments of larger ones.
SMALL_SETS, DELETION_SEGMENTS = 64, 2
#: Counts of n-grams kept per set, one byte each.
COUNTS = 128
#: Rows of a block, and rows that a task handles together.
BLOCK_ROWS, GROUP_ROWS = 1024, 8192
#: Bytes of sets that a task hands over at a time.
BATCH_BYTES = 8 << 20


def most_differences(size: int, percent: int) -> int:
    """Elements that a set of this size and a partner at least as large can differ in."""
    return size * (100 - percent) // percent


def band_of(size: int, percent: int) -> int:
    """Bands start at the smallest size that allows a difference and grow by half; -1 below."""
    low = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    if size < low:
        return -1
    k = 0
    while size >= (high := band_end(low)):
        low, k = high, k + 1
    return k


def band_end(low: int) -> int:
    return max(low + 1, -(-low * 3 // 2))


_BANDS: dict[tuple[int, int], tuple[int, int, np.ndarray, int, np.ndarray]] = {}


def band(k: int, percent: int) -> tuple[int, int, np.ndarray, int, np.ndarray]:
    """Its end, segments, their borders in hash space, segments with deletions, and a salt per segment."""
    if (k, percent) not in _BANDS:
        _BANDS[k, percent] = _band(k, percent)
    return _BANDS[k, percent]


def _band(k: int, percent: int) -> tuple[int, int, np.ndarray, int, np.ndarray]:
    low = -(-percent // (100 - percent))
    for _ in range(k):
        low = band_end(low)
    end = band_end(low)
    segments = (most_differences(end - 1, percent) + 1) * 5 // 4 + 2
    cuts = np.array([(i << 64) // segments for i in range(1, segments)], dtype=np.uint64)
    salts = mix(np.arange(segments, dtype=np.uint64) + np.uint64((k + 1) << 32))
    return end, segments, cuts, segments if end <= SMALL_SETS else DELETION_SEGMENTS, salts


class Shingler:
    """A text's set of word n-grams as sorted distinct 64-bit hashes."""

    def __init__(self, width: int = WIDTH):
        self.width, self.words, self.powers = width, ByteWords(), Powers(BASES[0])

    def of(self, text: str | None) -> np.ndarray:
        words, _ = self.words.of((text or "").encode("utf-8", "surrogatepass").lower())
        if not len(words):
            return np.zeros(0, np.uint64)
        n = min(self.width, len(words))
        starts = np.arange(len(words) - n + 1)
        return np.unique(mix(Sequence(words, self.powers).stretch(starts, starts + n) + np.uint64(n)))


def _segments(grams: np.ndarray, k: int, percent: int):
    """Borders of the segments within a set, the segments' sums, the elements' terms."""
    _, _, cuts, _, _ = band(k, percent)
    borders = np.concatenate([[0], np.searchsorted(grams, cuts), [len(grams)]])
    terms = mix(grams ^ np.uint64(0xA0761D6478BD642F))
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return borders, sums[borders[1:]] - sums[borders[:-1]], terms


def _cover(grams: np.ndarray, percent: int) -> tuple[int, int]:
    """Units of cover that a set has in its own band, and those it needs."""
    k = band_of(len(grams), percent)
    if k < 0:
        return 0, 0
    sizes = np.diff(_segments(grams, k, percent)[0])
    return int((sizes > 0).sum() + (sizes[: band(k, percent)[3]] >= 2).sum()), most_differences(len(grams), percent) + 1


def _sets(width: int, percent: int):
    """(id, text) -> id, size, v (the set's hash), cover, need, counts, grams (sorted hashes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            out, start, held = [], 0, 0
            for i, text in enumerate(batch.column(1)):
                grams = shingler.of(text.as_py())
                counts = np.minimum(np.bincount((grams >> np.uint64(20)).astype(np.int64) % COUNTS, minlength=COUNTS), 255).astype(np.uint8)
                out.append((len(grams), xxhash.xxh3_128_digest(grams.tobytes()), *_cover(grams, percent), counts.tobytes(), grams.tobytes()))
                held += 8 * len(grams) + COUNTS
                if held >= BATCH_BYTES:
                    yield pack(batch.column(0).slice(start, len(out)), out)
                    out, start, held = [], i + 1, 0
            if out:
                yield pack(batch.column(0).slice(start, len(out)), out)

    def pack(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        size, v, cover, need, counts, grams = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(size, pa.int64()), pa.array(v, pa.binary()), pa.array(cover, pa.int32()), pa.array(need, pa.int32()), pa.array(counts, pa.binary()), pa.array(grams, pa.binary())],
            names=["id", "size", "v", "cover", "need", "counts", "grams"],
        )

    return rows


def _keys(percent: int, leaders: np.ndarray, shared: np.ndarray | None):
    """(mark, v, grams) -> key, kind, and with `shared` also v, size, segment, own. Kinds: 0 a segment, 1 one with deletions, 2 a deletion.

    leaders: bitmap of the rows that stand for their class; shared: bitmap of the keys asked for, None for all.
    """

    def of(grams: np.ndarray, k: int):
        borders, sums, terms = _segments(grams, k, percent)
        deep, salts = band(k, percent)[3:]
        sizes = np.diff(borders)
        full = np.flatnonzero(sizes > 0)
        kinds = ((sizes >= 2) & (np.arange(len(sizes)) < deep))[full].astype(np.int8)
        parts = [(mix(sums[full] + salts[full]), full, kinds)]
        last = borders[deep]
        owner = np.searchsorted(borders[1:], np.arange(last), side="right")
        drop = np.flatnonzero(sizes[owner] >= 2)
        at = owner[drop]
        parts.append((mix(sums[at] - terms[drop] + salts[at]), at, np.full(len(at), 2, np.int8)))
        return [np.concatenate(x) for x in zip(*parts, strict=True)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            stands = in_bitmap(leaders, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            sets = batch.column(2)
            waiting = 0
            for i in np.flatnonzero(stands):
                grams = np.frombuffer(sets[int(i)].as_buffer(), np.uint64)
                k = band_of(len(grams), percent)
                if k < 0:
                    continue
                # A smaller partner may be in the band below.
                bands = [k] + [k - 1] * (k > 0 and (band(k - 1, percent)[0] - 1) * 100 >= percent * len(grams))
                for b in bands:
                    key, segment, kind = of(grams, b)
                    if shared is None:
                        held.append((key, kind))
                    else:
                        keep = in_bitmap(shared, key)
                        n = int(keep.sum())
                        held.append((key[keep], kind[keep], np.full(n, i), np.full(n, len(grams)), segment[keep], np.full(n, b == k)))
                    waiting += len(held[-1][0])
                if waiting > 200_000:
                    yield flush(batch, held)
                    waiting = 0
            if held:
                yield flush(batch, held)

    def flush(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        out = {"key": pa.array(signed(columns[0])), "kind": pa.array(columns[1])}
        if shared is not None:
            _, _, who, size, segment, own = columns
            out |= {"v": batch.column(1).take(pa.array(who)), "size": pa.array(size.astype(np.int32)), "segment": pa.array(segment.astype(np.int32)), "own": pa.array(own)}
        return pa.RecordBatch.from_pydict(out)

    return rows


def _linked(percent: int):
    def check(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(p, q, assume_unique=True))
            out.append(common > 0 and 100 * common >= percent * (len(p) + len(q) - common))
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(check, "boolean")


def _may_link(percent: int):
    """Whether counts of two sets leave room for a link: saturated bytes only make the bound weaker."""

    def check(a: pd.Series, b: pd.Series, total: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(a), np.uint8).reshape(-1, COUNTS).astype(np.int16)
        y = np.frombuffer(b"".join(b), np.uint8).reshape(-1, COUNTS).astype(np.int16)
        return pd.Series(np.abs(x - y).sum(axis=1, dtype=np.int64) * (100 + percent) <= total.to_numpy() * (100 - percent))

    return F.pandas_udf(check, "boolean")


def _tiles(percent: int, nearest: bool):
    """Rows of several tiles -> pairs a, b of different components that may be linked; nearest: for each row the closest one only."""

    def of(x: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for a in range(0, len(left), 64):
            rows = left[a : a + 64]
            small = np.minimum(x["size"][rows][:, None], x["size"][right][None])
            total = x["size"][rows][:, None] + x["size"][right][None]
            fit = (x["home"][rows][:, None] != x["home"][right][None]) & (small * 100 >= (total - small) * percent) & (x["probe"][rows][:, None] | x["probe"][right][None])
            p, q = np.nonzero(fit)
            if len(p):
                apart = np.abs(x["counts"][rows[p]] - x["counts"][right[q]]).sum(axis=1, dtype=np.int64)
                keep = np.flatnonzero(apart * (100 + percent) <= total[p, q] * (100 - percent))
                if nearest and len(keep):
                    keep = keep[np.lexsort((apart[keep], p[keep]))]
                    keep = keep[np.unique(p[keep], return_index=True)[1]]
                out += zip(rows[p[keep]].tolist(), right[q[keep]].tolist(), strict=True)
        return out

    def solve(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        _, home = np.unique(np.array([str(c) for c in table.column("component").to_pylist()]), return_inverse=True)
        x = {
            "home": home,
            "size": table.column("size").to_numpy().astype(np.int64),
            "probe": table.column("probe").to_numpy(zero_copy_only=False).astype(bool),
            "counts": np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).reshape(-1, COUNTS).astype(np.int16),
        }
        side = table.column("side").to_numpy()
        _, tile = np.unique(table.column("tile").to_numpy(), return_inverse=True)
        order = np.argsort(tile, kind="stable")
        found = set()
        for rows in np.split(order, np.flatnonzero(np.diff(tile[order])) + 1):
            for i, j in of(x, rows[side[rows] == 0], rows[side[rows] == 1]):
                found.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return solve


class _Join:
    """The classes of a table and what links them. In its tables `id` is the number of a class."""

    def __init__(self, docs: DataFrame, id_col: str, text: str, width: int, percent: int):
        self.percent = percent
        #: Tables that nothing reads once the next step is written.
        self.done: list[DataFrame] = []
        id_type = docs.schema[id_col].dataType.simpleString()
        sets = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(_sets(width, percent), f"id {id_type}, size long, v binary, cover int, need int, counts binary, grams binary")
        #: One row per row of docs; `row` is a number of its own.
        self.sets = saved(sets.withColumn("row", F.monotonically_increasing_id()), "sets")
        of = self.sets.where("size > 0 AND id IS NOT NULL").groupBy("v", "size", "cover", "need").agg(F.min("row").alias("lead"), F.min("id").alias("rep"))
        #: One row per class, with the row that stands for it; numbers rise with the classes' smallest ids.
        self.classes = saved(of.repartitionByRange("rep").sortWithinPartitions("rep", "v").select(F.monotonically_increasing_id().alias("id"), *of.columns[:-1]), "classes")

    def keys(self, leaders: np.ndarray, shared: np.ndarray | None = None) -> DataFrame:
        more = "" if shared is None else ", v binary, size int, segment int, own boolean"
        sets = self.sets.where("need > 0 AND id IS NOT NULL").select(F.xxhash64("row").alias("mark"), "v", "grams")
        return sets.mapInArrow(_keys(self.percent, leaders, shared), f"key long, kind tinyint{more}")

    def members(self) -> DataFrame:
        """key, id, size, probe: the rows of the keys that some class has paid for."""
        leaders = bitmap_of(self.classes.select(F.xxhash64("lead").alias("key")))
        exact, near = F.count(F.when(F.col("kind") < 2, 1)), F.count(F.when(F.col("kind") == 2, 1))
        counts = self.keys(leaders).groupBy("key").agg(exact.alias("exact"), near.alias("near"))
        counts = saved(counts.where("exact + near > 1"), "counts")
        # Rows that the bitmap lets through beside the leaders repeat their class's keys.
        shared = saved(self.keys(leaders, bitmap_of(counts)).distinct().join(self.classes.select("v", "id"), "v").drop("v"), "shared")
        met = saved(spread_join(shared, counts, ["key"], ["id"], counts=counts.select("key", (F.col("exact") + F.col("near")).alias("__rows"))), "met")
        discard(shared, counts)

        one = F.max(F.when(F.col("kind") < 2, F.col("exact") - 1).otherwise(0))
        two = F.sum(F.when(F.col("kind") == 2, F.col("exact")).when(F.col("kind") == 1, F.col("near")).otherwise(0))
        price = met.where("own").groupBy("id", "segment").agg(one.alias("one"), two.alias("two"), F.max((F.col("kind") > 0).cast("int")).alias("deep"))
        items = price.select("id", "segment", F.explode(F.array(F.struct(F.lit(1).alias("unit"), F.col("one").alias("cost")), F.struct(F.lit(2).alias("unit"), F.when(F.col("deep") == 1, F.greatest("one", "two")).otherwise(0).alias("cost")))).alias("x"))
        items = items.select("id", "segment", "x.*").where("cost > 0")
        ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("cost", "unit", "segment"))).withColumn("paid", F.count("*").over(Window.partitionBy("id")))
        bought = ranked.join(self.classes.where("need > 0").select("id", "cover", "need"), "id").where("rank <= need - (cover - paid)")
        bought = bought.groupBy("id", "segment").agg(F.max("unit").alias("unit"))
        probes = met.where("own").join(bought, ["id", "segment"]).where("kind < 2 OR unit = 2").select("key", "id").distinct()
        probes = saved(probes, "probes")
        paid = probes.groupBy("key").agg(F.lit(True).alias("paid"))
        narrow = met.select("key", "id", "size")
        reached = saved(spread_join(narrow, paid, ["key"], ["id"]).drop("paid").distinct(), "paid")
        discard(met)
        self.done = [probes, reached]
        rows = reached.join(probes.withColumn("probe", F.lit(True)), ["key", "id"], "left")
        rows = rows.select("key", "id", "size", F.coalesce("probe", F.lit(False)).alias("probe"))
        return rows.unionByName(self.uncovered())

    def uncovered(self) -> DataFrame:
        """Classes whose set fills too few segments for the cover they need: they meet all of their band and the next."""
        own = self.classes.where("need > 0")
        edges = [-(-self.percent // (100 - self.percent))]
        while edges[-1] < 1 << 31:
            edges.append(band_end(edges[-1]))
        of = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("size"))).cast("long")
        short = own.where("cover < need").select(F.explode(F.array(of, of + 1)).alias("key"), "id", F.col("size").cast("int").alias("size"))
        if short.isEmpty():
            return short.select("key", "id", "size", F.lit(True).alias("probe")).limit(0)
        keys = short.select("key").distinct()
        all_of = own.select(of.alias("key"), "id", F.col("size").cast("int").alias("size")).join(keys, "key")
        flags = short.select("key", "id").withColumn("probe", F.lit(True))
        every = all_of.unionByName(short).distinct()
        return every.join(flags, ["key", "id"], "left").select("key", "id", "size", F.coalesce("probe", F.lit(False)).alias("probe"))

    def verify(self, pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Of saved pairs a, b those that are linked."""
        side = lambda c: known.select(F.col("id").alias(c), F.col("grams").alias(f"g{c}"))
        n = pairs.count()
        both = spread_join(spread_join(pairs, side("a"), ["a"], ["b"], sized=pairs, total=n), side("b"), ["b"], ["a"], sized=pairs, total=n)
        return both.where(_linked(self.percent)("ga", "gb")).select("a", "b")

    def components(self, rows: DataFrame) -> DataFrame:
        """id, component of the linked classes."""
        rows = saved(rows, "members")
        discard(*self.done)
        spark = rows.sparkSession
        none = spark.createDataFrame([], "a long, b long")
        wanted = saved(self.classes.join(rows.select("id").distinct(), "id", "left_semi").select("id", F.col("lead").alias("row")), "wanted")
        sets = self.sets.select("row", F.col("size").alias("n"), "counts", "grams", F.xxhash64("row").alias("mark"))
        marked = marked_rows(sets, "mark", bitmap_of(wanted.select(F.xxhash64("row").alias("key")))).drop("mark")
        known = saved(marked.join(wanted, "row").drop("row"), "known")
        side = lambda c: known.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"c_{c}"))

        leaders = rows.groupBy("key").agg(F.min(F.struct("id", "size", "probe")).alias("leader"), F.max("probe").alias("p")).where("p")
        near = (F.least("size", "leader.size") * 100 >= F.greatest("size", "leader.size") * self.percent) & (F.col("probe") | F.col("leader.probe"))
        pairs = spread_join(rows, leaders, ["key"], ["id"]).where((F.col("id") != F.col("leader.id")) & near)
        pairs = saved(pairs.select(F.col("leader.id").alias("a"), F.col("id").alias("b")).distinct(), "candidates")
        n = pairs.count()
        room = spread_join(spread_join(pairs, side("a"), ["a"], ["b"], sized=pairs, total=n), side("b"), ["b"], ["a"], sized=pairs, total=n).where(_may_link(self.percent)("c_a", "c_b", F.col("n_a") + F.col("n_b")))
        candidates, pairs = pairs, saved(room.select("a", "b"), "pairs")
        discard(candidates)
        # First one pair per member; the rest only where that left members apart.
        first = saved(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
        links, found = self.joined(none, spark.createDataFrame([], "id long, component long"), self.verify(first, known))
        of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
        rest = pairs.join(first, ["a", "b"], "left_anti")
        n = pairs.count()
        rest = spread_join(spread_join(rest, of("a"), ["a"], ["b"], "left", sized=pairs, total=n), of("b"), ["b"], ["a"], "left", sized=pairs, total=n)
        rest = saved(rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "rest")
        links, found = self.joined(links, found, self.verify(rest, known))
        # What a leader left apart joins by the closest of its key first, so that few pairs are left for the last step, all of them.
        tried = pairs
        for nearest in (True, False):
            tiles = saved(self.open_tiles(rows, found, known, nearest).join(tried, ["a", "b"], "left_anti"), "tiles")
            discard(*self.done)
            if tiles.isEmpty():
                continue
            links, found = self.joined(links, found, self.verify(tiles, known))
            tried = tried.union(tiles)
        discard(known)
        return found

    def open_tiles(self, rows: DataFrame, found: DataFrame, known: DataFrame, nearest: bool) -> DataFrame:
        """Pairs a, b under one key, of different components, that may be linked."""
        placed = saved(rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
        per_home = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.max("probe").alias("p"))
        keys = per_home.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.sum("n").alias("all"), F.max("n").alias("most"), F.max("p").alias("p")).where("p AND all > most")
        blocks = lambda n: F.ceil(n / F.lit(BLOCK_ROWS)).cast("int")
        keys = saved(keys.select("key", "major", blocks(F.col("all") - F.col("most")).alias("minors"), blocks(F.col("all")).alias("alls")), "keys")
        homes, placed = placed, saved(spread_join(placed, keys, ["key"], ["id"], counts=placed.groupBy("key").agg(F.count("*").alias("__rows"))), "open")
        discard(homes)
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        cut = ["key", "id", "size", "probe", "component"]
        left = placed.where("component <> major").select(*cut, own("minors").alias("m"), every("alls").alias("e")).withColumn("side", F.lit(0))
        right = placed.select(*cut, own("alls").alias("e"), every("minors").alias("m")).select(*cut, "m", "e").withColumn("side", F.lit(1))
        sides = saved(left.unionByName(right).join(known.select("id", "counts"), "id").withColumn("tile", F.xxhash64("key", "m", "e")), "sides")
        self.done = [keys, placed, sides]
        groups = max(1, sides.count() // GROUP_ROWS)
        out = sides.withColumn("pack", F.pmod("tile", F.lit(groups))).groupBy("pack").applyInArrow(_tiles(self.percent, nearest), "a long, b long")
        return out.distinct()

    def joined(self, links: DataFrame, found: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = saved(new, "new")
        if new.isEmpty():
            return links, found
        links = links.union(new)
        return links, saved(connected_components(links), "found")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles (long), component_id: the smallest id reachable by links, itself included; a row per row of docs."""
    with small_batches(docs.sparkSession):
        join = _Join(docs, id_col, text, width, percent)
        found = join.components(join.members()).withColumnRenamed("component", "c")
    named = saved(join.classes.join(found, "id", "left").select("v", F.coalesce("c", "id").alias("c")), "named")
    rows = saved(spread_join(join.sets.select("id", "size", "v", "row"), named, ["v"], ["row"], "left").select("id", "size", F.when(F.col("id").isNotNull(), F.col("c")).alias("c")), "rows")
    discard(join.sets, named)
    # An id of several texts ties their components, and its rows without words belong there.
    rows = one_per_id(rows)
    least = rows.where("c IS NOT NULL").groupBy("c").agg(F.min("id").alias("least"))
    out = spread_join(rows, least, ["c"], ["id"], "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
