"""Document fingerprints from closed syncmers.

A text is cut into tokens (runs of letters and digits, lower-cased; each character of scripts written without spaces on its
own; a text without any is one token) with K - 1 border marks before and after them. A window of K tokens is kept, as an
anchor, if the smallest of its inner windows of S tokens stands at either edge. Whether a window is kept depends on the
window alone, so anchors of a passage are the same wherever it stands, and of K - S windows in a row one at least is kept, so
every text has anchors by the same rule, however short. The fingerprint lists them with their positions.

Two fingerprints are matched by position: each anchor is tied to the one before it and their distance (the first and last to
the borders), so a tie is shared only where both texts have the same two anchors equally far apart, at whatever place.
Likeness is the Jaccard similarity of the ties, and 1 only for the same tokens. All of it is DataFrame expressions.

Null texts count as empty. Equal texts have equal fingerprints. Null ids come before all others; rows of equal ids are
ordered by the hash of their text; repeated rows each get a result; an empty table gives an empty result; columns other than
the id and those asked for are carried along, or set aside with `_in` behind the name where a result has it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.llm.common import set_aside, text_or_empty

K, S = 5, 2
#: Neighbouring ids are dealt to buckets of about this many bytes, and to about this many buckets at most.
BUCKET_BYTES, BUCKETS = 4 << 20, 1 << 20
#: Quantiles of the ids that buckets start from; a square number.
CELLS = 1024

TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]+"


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """df with <out>_anchors (long), <out>_at (their positions) and <out>_ties (distinct), each an array."""
    tokens, inner, at_, anchors, ties = f"__{out}_tokens", f"__{out}_inner", f"{out}_at", f"{out}_anchors", f"{out}_ties"
    words = F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(TOKEN), F.lit(0)), lambda w: F.xxhash64(w))
    border = lambda mark: F.array(*[F.xxhash64(F.lit(mark))] * (k - 1))
    df = df.withColumn(tokens, words)
    own = F.when(F.size(tokens) == 0, F.array(F.xxhash64(F.col(text)))).otherwise(F.col(tokens))
    df = df.withColumn(tokens, F.concat(border("<"), own, border(">")))
    n = F.size(tokens)
    get = lambda column, i: F.get(F.col(column), i)
    df = df.withColumn(inner, F.transform(F.sequence(F.lit(0), n - s), lambda i: F.xxhash64(*[get(tokens, i + j) for j in range(s)])))
    last = k - s

    def closed(i: Column) -> Column:
        edges = F.least(get(inner, i), get(inner, i + last))
        middle = [get(inner, i + j) for j in range(1, last)]
        return edges <= (F.least(*middle) if len(middle) > 1 else middle[0])

    df = df.withColumn(at_, F.filter(F.sequence(F.lit(0), n - k), closed))
    # Inner windows that cover the whole window, edge to edge, identify it.
    steps = sorted({*range(0, last, s), last})
    df = df.withColumn(anchors, F.transform(at_, lambda i: F.xxhash64(*[get(inner, i + j) for j in steps])))
    # Before the first anchor and behind the last one stand the borders.
    before = lambda column, j, first: F.when(j > 0, get(column, j - 1)).otherwise(F.lit(first))
    here = lambda column, j, border: F.coalesce(get(column, j), border)
    tie = lambda j: F.xxhash64(before(anchors, j, 0), here(anchors, j, F.lit(0)), here(at_, j, n - k + 1) - before(at_, j, -1))
    return df.withColumn(ties, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(at_)), tie))).drop(tokens, inner)


def as_text(out: str) -> Column:
    """anchor@position of each anchor, comma-joined."""
    return F.array_join(F.zip_with(f"{out}_anchors", f"{out}_at", lambda h, i: F.concat(F.lower(F.hex(h)), F.lit("@"), i.cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _number(df: DataFrame, id_col: str) -> Column:
    """A double that never falls as the id rises: the id itself, or the first bytes of its text."""
    if isinstance(df.schema[id_col].dataType, T.NumericType):
        return F.col(id_col).cast("double")
    head = F.rpad(F.hex(F.substring(F.encode(F.col(id_col).cast("string"), "UTF-8"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def _cell_of(number: Column, edges: list[float]) -> Column:
    """How many of the edges are not above a number, by way of every so-manieth edge."""
    width = max(1, math.isqrt(len(edges)))
    literal = lambda values: "array(" + ",".join(f"double('{v!r}')" for v in values) + ")"
    groups = [edges[i : i + width] for i in range(0, len(edges), width)]
    group = F.size(F.filter(F.expr(literal([g[0] for g in groups])), lambda e: e <= number)) - 1
    inside = F.get(F.expr("array(" + ",".join(map(literal, groups)) + ")"), group)
    return F.when(group >= 0, group * width + F.size(F.filter(inside, lambda e: e <= number))).otherwise(0)


def ordered_buckets(df: DataFrame, id_col: str, tie: Column, weight: Column, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with __bucket, which never falls as (id, tie) rises; null ids stand first.

    Cells lie between quantiles of the ids; an id that fills more than a quantile is a cell of its own. Cells are cut by
    their bytes: evenly over the range of their ids, or of the ties where they hold one id. What reaches the driver is the
    quantiles and a row per cell.
    """
    number = _number(df, id_col)
    shares = ",".join(f"double({i / CELLS!r})" for i in range(CELLS))
    read = df.select(number.alias("x")).agg(F.expr(f"percentile_approx(x, array({shares}), {CELLS * 40})").alias("q"), F.max("x").alias("hi")).first()
    quantiles = read["q"] or [0.0]
    often = {a for a, b in zip(quantiles, quantiles[1:]) if a == b}
    edges = sorted({*quantiles, *[math.nextafter(v, math.inf) for v in often]})
    cell = F.when(number.isNull(), -1).otherwise(_cell_of(number, edges)).cast("int")
    sizes = {r["c"]: r["b"] for r in df.groupBy(cell.alias("c")).agg(F.sum(weight + 16).alias("b")).collect()}
    wanted = max(bucket_bytes, sum(sizes.values()) // BUCKETS, 1)
    first, filled, grid = 0, 0, []
    for c in range(-1, len(edges) + 1):
        held = sizes.get(c, 0)
        parts = max(1, -(-held // wanted))
        if filled and filled + held > wanted:
            first, filled = first + 1, 0
        low = edges[c - 1] if c > 0 else 0.0
        high = edges[c] if 0 <= c < len(edges) else max(read["hi"] or 0.0, low)
        grid.append((c, first, parts, low, max(high - low, 1e-300), c < 0 or low in often))
        filled += held
        if parts > 1:
            first, filled = first + parts, 0
    plan = df.sparkSession.createDataFrame(grid, "__cell int, __first long, __parts int, __low double, __width double, __one boolean")
    share = F.when(F.col("__one"), tie / F.lit(2.0**64) + 0.5).otherwise((number - F.col("__low")) / F.col("__width"))
    inside = F.greatest(F.lit(0), F.least(F.floor(share * F.col("__parts")), F.col("__parts") - 1))
    placed = df.withColumn("__cell", cell).join(F.broadcast(plan), "__cell").withColumn("__bucket", F.col("__first") + inside)
    return placed.drop("__cell", "__first", "__parts", "__low", "__width", "__one")


def with_next(df: DataFrame, columns: list[str], id_col: str = "doc_id", derive=lambda df: df, derived: tuple[str, ...] = (), bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """df with next_<column> of the row that follows by ascending id (equal ids by their text's hash), after the last the first.

    Rows are shuffled once, to ordered buckets; each bucket also gets the first row of the next one, found by a narrow pass.
    derive adds the columns `derived` to the shuffled rows, once each, and those get a next_ column as well.
    """
    hashed = [F.col(c) for c in columns if c != id_col]
    tie = F.xxhash64(*hashed)
    weight = sum((F.coalesce(F.octet_length(c.cast("string")), F.lit(0)) for c in hashed), F.lit(0))
    placed = ordered_buckets(df, id_col, tie, weight, bucket_bytes).withColumn("__tie", tie)
    spot = F.struct(F.col(id_col).isNotNull().alias("has"), F.col(id_col).alias("id"), F.col("__tie").alias("tie"))
    firsts = placed.groupBy("__bucket").agg(F.min(spot).alias("__first"))
    # One row per bucket: about BUCKETS + CELLS at most, so one window over them and their broadcast are bounded.
    order = Window.partitionBy(F.lit(0)).orderBy("__bucket")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead = firsts.select(F.coalesce(F.lag("__bucket").over(order), F.last("__bucket").over(whole)).alias("__to"), "__first")
    mine = F.coalesce(F.col(id_col) == F.col("__first.id"), F.col(id_col).isNull() & F.col("__first.id").isNull()) & (F.col("__tie") == F.col("__first.tie"))
    guests = placed.join(F.broadcast(ahead), mine, "inner").withColumn("__bucket", F.col("__to")).drop("__to", "__first")
    rows = placed.withColumn("__guest", F.lit(0)).unionByName(guests.withColumn("__guest", F.lit(1)))
    rows = derive(rows.repartition("__bucket"))
    follow = Window.partitionBy("__bucket").orderBy("__guest", F.col(id_col).asc_nulls_first(), "__tie")
    out = rows.select("*", *[F.lead(c).over(follow).alias(f"next_{c}") for c in [*columns, *derived]])
    return out.where("__guest = 0").drop("__guest", "__bucket", "__tie")


def compared(docs: DataFrame, id_col: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with n_chars, edited, the fingerprints' columns (own_, changed_), near_edited and near_next."""
    docs = set_aside(docs, ("n_chars", "edited", "near_edited", "near_next", f"next_{text}", "next_own_ties", *[f"{o}_{x}" for o in ("own", "changed") for x in ("anchors", "at", "ties")]))
    docs = docs.withColumn(text, text_or_empty(text))
    pairs = with_next(docs, [text], id_col, lambda df: with_anchors(df, text, "own"), ("own_ties",), bucket_bytes)
    n = F.char_length(text)
    kept, taken = F.substring(F.col(text), F.lit(1), (n - F.floor(n / 2)).cast("int")), F.substring(F.col(f"next_{text}"), F.lit(1), F.floor(n / 2).cast("int"))
    marked = with_anchors(pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(kept, taken)), "edited", "changed")
    return marked.withColumn("near_edited", likeness("own_ties", "changed_ties")).withColumn("near_next", likeness("own_ties", "next_own_ties"))


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = compared(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return marked.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("own").alias("fingerprint"), as_text("changed").alias("edited_fingerprint"), "near_edited", "near_next")
