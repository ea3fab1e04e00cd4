"""Chat formatting against a fold in plain Python."""

import hashlib
import random

import pytest

from feedloom.llm import chat_format
from feedloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
LOG = "conv long, seq long, message long, kind string, role string, text string, `from` int, `to` int"
SAID = "</s>[INST] ok [/INST]"


def escaped(text):
    out = ""
    for i, c in enumerate(text):
        out += c
        if c == "\\" or any(text.startswith(x, i) for x in ("<s>", "</s>", "[INST]", "[/INST]")):
            out += "\\"
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(turns):
    """(role, text) of a conversation in order -> its row without the id."""
    loss = "".join(t for r, t in turns if r == "assistant")
    formatted = "".join(f"<s>{escaped(r)}[INST]{escaped(t)}[/INST]</s>" for r, t in turns)
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted))


def of_table(rows):
    """Rows of conv_id, turn, role, text -> the query's rows."""
    low = lambda x: (x is not None, x)
    by = {}
    for c, n, r, t in sorted(rows, key=lambda x: (low(x[1]), x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((r or "", t or ""))
    return sorted(((c, *digest(x)) for c, x in by.items()), key=lambda x: low(x[0]))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda x: (x[0] is not None, x[0]))


TEXTS = ["", None, "a", "<s>", "<\\s>", "\\", "\\\\<s>", "[INST][/INST]", "<<s>></s", "</s>[INST] ok [/INST]", "x" * 700 + "<s>" + "\\" * 5, "é😀\n[INST", "]", "</", "s>", "[/INST]</s><s>"]


def test_turns_come_back(spark):
    rng = random.Random(13)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 0, 1, 2]), rng.choice(["user", "assistant", None, "<s>\n", "sys\\"]), rng.choice(TEXTS)) for _ in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnsRenamed({})
    extra = turns.selectExpr("*", "1 AS seq", "'x' AS conv", "2 AS `__part`").repartition(5)
    log = chat_format.as_log(extra)
    assert log.where("char_length(text) > 256").count() == 0
    got = chat_format.digests(chat_format.read_back(chat_format.segments(chat_format.messages(log))))
    assert rows_of(got) == of_table(rows)


def test_segments_hide_no_mark(spark):
    rows = [(1, i, "user", t) for i, t in enumerate(TEXTS)]
    log = chat_format.as_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    for r in chat_format.segments(chat_format.messages(log)).collect():
        body = r["formatted"]
        assert [body.count(x) for x in ("<s>", "</s>", "[INST]", "[/INST]")] == [1, 1, 1, 1] and r["loss_start"] is None


def folded(events):
    """conversation -> its messages, by a plain loop."""
    state, first = {}, {}
    order = {k: i for i, k in enumerate(chat_format.KINDS, 1)}
    low = lambda x: (x is not None, x)
    for c, q, m, kind, role, text, a, b in sorted(events, key=lambda e: (low(e[1]), order.get(e[3], 0), low(e[4]), low(e[5]), low(e[6]), low(e[7]))):
        first.setdefault((c, m), q)
        old = state.get((c, m))
        if kind == "message":
            state[c, m] = (role if role is not None else (old or first and (None,))[0], text or "")
        elif old is None or old[1] is None:
            if kind == "delete":
                state.setdefault((c, m), (None, None))
        elif kind == "regenerate":
            state[c, m] = (role if role is not None else old[0], text or "")
        elif kind == "delta":
            state[c, m] = (old[0], old[1] + (text or ""))
        elif kind == "edit":
            x = 0 if a is None else min(max(a, 0), len(old[1]))
            y = len(old[1]) if b is None else min(max(b, x), len(old[1]))
            state[c, m] = (old[0], old[1][:x] + (text or "") + old[1][y:])
        elif kind == "delete":
            state[c, m] = (old[0], None)
    out = {}
    for (c, m), (role, text) in state.items():
        if text is not None:
            out.setdefault(c, []).append((first[c, m], role or "", text))
    return {c: sorted(x, key=lambda y: (low(y[0]), y[1], y[2])) for c, x in out.items()}


def test_deltas_edits_and_regenerations_fold(spark):
    rng = random.Random(7)
    events = []
    for c in (1, 2, None):
        for q in range(60):
            kind = rng.choice(["message", "delta", "delta", "delta", "edit", "regenerate", "delete", "other", None])
            events.append((c, rng.choice([q, q, 5, None]), rng.randrange(6), kind, rng.choice(["user", "assistant", None]), rng.choice(TEXTS), rng.choice([None, 0, 2, 99, -1]), rng.choice([None, 1, 3, 99])))
    got = {}
    for r in chat_format.messages(spark.createDataFrame(events, LOG).repartition(4)).collect():
        got.setdefault(r["conv"], []).append((r["seq"], r["role"], r["text"]))
    low = lambda x: (x is not None, x)
    assert {c: sorted(x, key=lambda y: (low(y[0]), y[1], y[2])) for c, x in got.items()} == folded(events)


def test_long_message_in_one_conversation(spark):
    rows = [(1, i, i % 40, "message" if i < 40 else "delta", "assistant", "ab", None, None) for i in range(20000)]
    log = spark.createDataFrame(rows, LOG).repartition(8)
    told = chat_format.messages(log)
    assert told.count() == 40 and told.where("char_length(text) <> 1000").count() == 0
    got = chat_format.digests(chat_format.read_back(chat_format.segments(told)))
    assert rows_of(got) == [(1, *digest([("assistant", "ab" * 500)] * 40))]


def test_empty_log_and_templates(spark):
    none = spark.createDataFrame([], LOG)
    assert chat_format.digests(chat_format.read_back(chat_format.segments(chat_format.messages(none)))).count() == 0
    for wrong in ({"controls": ("<s>", "[INST]", "[/INST]", "</s>", "x<")}, {"escape": "<"}, {"middle": "\n"}, {"middle": "||", "controls": ("<s>", "||", "[/INST]")}):
        with pytest.raises(ValueError):
            chat_format.Template(**wrong)
    own = chat_format.Template("@u ", "#m ", "%e", ("@u", "#m", "%e"), "$", ("bot",))
    texts = ["@u#m%e", "$@u$", "@", "#", "$$", "a%", ""]
    told = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate((r, t) for r in ("bot", "$#m") for t in texts)], "conv long, seq long, role string, text string")
    back = chat_format.read_back(chat_format.segments(told, own), own).orderBy("seq").collect()
    assert [(r["role"], r["text"], r["loss"]) for r in back] == [(r, t, t if r == "bot" else None) for r in ("bot", "$#m") for t in texts]


def test_registered_query_on_whole_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)]
    assert rows_of(QUERIES["op13_chat_format"](spark, DATA)) == of_table(rows)
