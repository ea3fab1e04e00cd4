"""Chat formatting: a log of events is folded into final messages, which are rendered as a template's turns with a loss mask.

A log has a row per event: conversation, sequence, message, kind, role, text, from and to. `message` begins a message, `delta`
appends text, `edit` puts text in place of the code points from `from` to `to` (null: all of them), `regenerate` begins the text
anew, `delete` takes the message away; other kinds do nothing. The log is partitioned by conversation and message, so that a
conversation of any length is dealt to many tasks, sorted by sequence, and folded in one pass that holds one message at a time.
A message stands where its first event does. Every message becomes one segment of output: marks, role and text; the segments
of a conversation in order are its formatted text, and each names the code points of its own that are under the loss mask.

Control strings inside roles and texts are broken by the escape character, and escape characters doubled, so that marks are
found nowhere else and the texts can be had back. Reading back needs the segments only; digests of whole conversations hash
them in order, a segment at a time, and nothing of a conversation is gathered.

Null texts and roles are empty. Repeated rows are turns of their own; equal sequences are ordered by kind, role and text, null
sequences come first; a null conversation is a conversation. Very long texts are one segment. Columns other than those named
are not read, so no name can clash; an empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

#: Code points of an event of as_log().
PIECE = 256
KINDS = ("message", "regenerate", "delta", "edit", "delete")


@dataclass(frozen=True)
class Template:
    """A turn is begin, role, middle, text, end. `controls` must not occur in roles and texts as they stand."""

    begin: str = "<s>"
    middle: str = "[INST]"
    end: str = "[/INST]</s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    escape: str = "\\"
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if len(self.escape) != 1 or any(len(c) < 2 or self.escape in c for c in self.controls):
            raise ValueError("the escape is one character that no control string has, control strings are longer than one")
        marks = (self.begin, self.middle, self.end)
        if any(all(not m.startswith(c) for c in self.controls) for m in (self.middle, self.end)):
            raise ValueError("what ends a role or a text must begin with a control string")
        if any(m.startswith(c[i:]) for m in marks for c in self.controls for i in range(1, len(c))):
            raise ValueError("no mark may complete a control string that a text begins")

    def escaped(self, text: Column) -> Column:
        e = re.escape(self.escape)
        broken = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in self.controls)
        sign = self.escape.replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(text, f"{e}|{broken}", "$0" + sign)

    def plain(self, text: Column) -> Column:
        """What was escaped: of a doubled escape one stays, a single one goes."""
        e = re.escape(self.escape)
        return F.regexp_replace(text, f"{e}({e}?)", "$1")


TEMPLATE = Template()


def as_log(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of conversations that arrived turn by turn, each streamed in pieces."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.monotonically_increasing_id().alias("message"), F.coalesce(F.col(role), F.lit("")).alias("role"), body.alias("body"))
    parts = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length("body") / PIECE), F.lit(1)).cast("int") - 1))
    pieces = rows.withColumn("part", parts)
    kind = F.when(F.col("part") == 0, "message").otherwise("delta")
    return pieces.select("conv", F.struct("turn", "part").alias("seq"), "message", kind.alias("kind"), "role", F.expr(f"substring(body, part * {PIECE} + 1, {PIECE})").alias("text"), F.lit(None).cast("int").alias("from"), F.lit(None).cast("int").alias("to"))


class _Message:
    """The state of one message."""

    def __init__(self, key: tuple, seq: object):
        self.key, self.seq = key, seq
        self.role: str | None = None
        self.parts: list[str] | None = None

    def take(self, kind: str | None, role: str | None, text: str | None, start: int | None, stop: int | None) -> None:
        if kind in ("message", "regenerate") and (kind == "message" or self.parts is not None):
            self.role = self.role if role is None else role
            self.parts = [text or ""]
        elif kind == "delta" and self.parts is not None:
            self.parts.append(text or "")
        elif kind == "edit" and self.parts is not None:
            now = "".join(self.parts)
            start = 0 if start is None else min(max(start, 0), len(now))
            stop = len(now) if stop is None else min(max(stop, start), len(now))
            self.parts = [now[:start], text or "", now[stop:]]
        elif kind == "delete":
            self.parts = None


def _fold(kind: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def told(messages: list[_Message]) -> pa.RecordBatch:
            fields = [[m.key[0] for m in messages], [m.seq for m in messages], [m.role or "" for m in messages], ["".join(m.parts) for m in messages]]
            return pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, kind.types, strict=True)], schema=kind)

        for batch in batches:
            for conv, message, seq, *event in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.key != (conv, message):
                    if now and now.parts is not None:
                        done.append(now)
                    now = _Message((conv, message), seq)
                now.take(*event)
            if done:
                yield told(done)
                done = []
        if now and now.parts is not None:
            yield told([now])

    return rows


def messages(log: DataFrame) -> DataFrame:
    """conv, seq, role, text of each final message, from conv, seq, message, kind, role, text, from, to."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.coalesce("kind", F.lit("")))
    ordered = log.repartition("conv", "message").sortWithinPartitions("conv", "message", "seq", rank, "role", "text", "from", "to")
    rows = ordered.select("conv", "message", "seq", "kind", "role", "text", "from", "to")
    schema = log.select("conv", "seq", "role", "text").schema
    return rows.mapInArrow(_fold(to_arrow_schema(schema)), schema)


def segments(told: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv, seq, formatted, loss_start and loss_end (code points of formatted; null: not trained on) from conv, seq, role, text."""
    t = template
    parts = told.select("conv", "seq", "role", F.concat(F.lit(t.begin), t.escaped(F.col("role")), F.lit(t.middle)).alias("head"), t.escaped(F.col("text")).alias("body"))
    trained = F.col("role").isin(*t.trained)
    start = F.char_length("head")
    return parts.select("conv", "seq", F.concat("head", "body", F.lit(t.end)).alias("formatted"), F.when(trained, start).alias("loss_start"), F.when(trained, start + F.char_length("body")).alias("loss_end"))


def read_back(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv, seq, formatted, role, text and loss (null: not trained on), from segments alone."""
    t = template
    role = F.expr(f"substring(formatted, {len(t.begin) + 1}, middle - {len(t.begin) + 1})")
    text = F.expr(f"substring(formatted, middle + {len(t.middle)}, char_length(formatted) - {len(t.end) + len(t.middle) - 1} - middle)")
    loss = F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)")
    return formatted.withColumn("middle", F.locate(t.middle, "formatted")).select("conv", "seq", "formatted", t.plain(role).alias("role"), t.plain(text).alias("text"), t.plain(loss).alias("loss"))


def _hashed(kind: pa.Schema):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def told(rows: list[list]) -> pa.RecordBatch:
            fields = zip(*[(r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]) for r in rows], strict=True)
            return pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, kind.types, strict=True)], schema=kind)

        for batch in batches:
            for conv, chars, role, text, loss in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state[0] != conv:
                    done += [state] if state else []
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[3] += len(loss)
                    state[4].update(loss.encode())
                state[5] += chars
            if done:
                yield told(done)
                done = []
        if state:
            yield told([state])

    return rows


def digests(read: DataFrame) -> DataFrame:
    """A row per conversation: its turns and its text under the loss mask, hashed in order."""
    ordered = read.repartition("conv").sortWithinPartitions("conv", "seq", "role", "text")
    schema = read.select("conv", F.lit(0).cast("long").alias("n_turns"), F.lit("").alias("turns_sha256"), F.lit(0).cast("long").alias("loss_chars"), F.lit("").alias("loss_sha256"), F.lit(0).cast("long").alias("formatted_chars")).schema
    rows = ordered.select("conv", F.char_length("formatted").alias("chars"), "role", "text", "loss")
    return rows.mapInArrow(_hashed(to_arrow_schema(schema)), schema)


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    log = as_log(turns.unionByName(own))
    return digests(read_back(segments(messages(log)))).withColumnRenamed("conv", "conv_id")
