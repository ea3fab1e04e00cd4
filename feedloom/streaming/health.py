"""I8 and I9 as a stream: a board's health is state that outcomes change from batch to batch, and time makes quiet boards dormant."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

COMPANY = ["provider", "slug"]
#: What is known of a board; times are microseconds, so that no worker's time zone counts. `at` is how far time has come for it.
HEALTH = "last_fetched_at long, last_success_at long, last_error string, consecutive_failures long, postings_seen_total long, zero_yield_streak long, url_suspect boolean, status string, parsing_strategy string, at long"
OUTCOME = "at long, seq long, seen long, error string, transport_fault boolean"
TIMES = ("last_fetched_at", "last_success_at", "at")
_NAMES, _OUTCOME_NAMES = (tuple(f.split()[0] for f in x.split(", ")) for x in (HEALTH, OUTCOME))
_NEW = (None, None, None, 0, 0, 0, False, "active", None, None)


class Rules:
    """What an outcome, and the passing of time, do to a board's health."""

    def __init__(self, scraped: tuple[str, ...] = ("llm_scrape", "playwright"), failures: int = 5, min_streak: int = 3, sweep_hours: int = 24):
        self.scraped, self.failures, self.min_streak, self.sweep = scraped, failures, min_streak, sweep_hours * 3_600_000_000

    def at_risk(self, h: dict) -> bool:
        """The next sweep makes the board dormant."""
        return h["status"] == "active" and h["parsing_strategy"] in self.scraped and h["zero_yield_streak"] >= self.min_streak

    def next_sweep(self, at: int) -> int:
        return (at // self.sweep + 1) * self.sweep

    def passed(self, h: dict, at: int) -> dict:
        """Time comes to `at`: a sweep in between parks what is at risk."""
        if h["at"] is not None and self.next_sweep(h["at"]) <= at and self.at_risk(h):
            h = {**h, "status": "dormant"}
        return {**h, "at": at if h["at"] is None else max(at, h["at"])}

    def outcome(self, h: dict, o: dict) -> dict:
        h = {**self.passed(h, o["at"]), "last_fetched_at": o["at"]}
        if o["error"] is not None:
            h["last_error"] = o["error"][:500]
            if not o["transport_fault"]:
                h["consecutive_failures"] += 1
                h["status"] = "broken" if h["consecutive_failures"] >= self.failures else h["status"]
            return h
        seen = o["seen"] or 0
        h |= {"last_success_at": o["at"], "last_error": None, "consecutive_failures": 0, "postings_seen_total": h["postings_seen_total"] + seen, "zero_yield_streak": 0 if seen > 0 else h["zero_yield_streak"] + 1}
        if seen > 0:
            h |= {"url_suspect": False, "status": "active" if h["status"] == "dormant" else h["status"]}
        return h


class BoardHealth(StatefulProcessor):
    """Outcomes wait until the watermark has passed them and are then applied in the order of their time and number.

    So the state does not depend on how outcomes were split into batches. A timer wakes the board for the first outcome that
    waits, and for the sweep that would make it dormant.
    """

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.health = handle.getValueState("health", HEALTH)
        self.waiting = handle.getListState("waiting", OUTCOME)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.asDict()
        self._keep({n: row.get(n, d) if row.get(n) is not None else d for n, d in zip(_NAMES, _NEW, strict=True)})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        more = (tuple(r[n] for n in ("us", *_OUTCOME_NAMES[1:])) for r in rows)
        while some := list(islice(more, 1000)):
            self.waiting.appendList(some)
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def _known(self) -> dict:
        held = self.health.get() if self.health.exists() else None
        return dict(zip(_NAMES, _NEW if held is None else tuple(held), strict=True))

    def _keep(self, h: dict) -> None:
        self.health.update(tuple(h[n] for n in _NAMES))

    def _advance(self, key, watermark_ms: int) -> Iterator[Row]:
        """Apply all that lies before the watermark."""
        before, until = self._known(), watermark_ms * 1000
        h, due, later = before, [], []
        for r in self.waiting.get() if self.waiting.exists() else ():
            o = dict(zip(_OUTCOME_NAMES, tuple(r), strict=True))
            (due if o["at"] <= until else later).append(o)
        for o in sorted(due, key=lambda o: (o["at"], o["seq"])):
            h = self.rules.outcome(h, o)
        if h["at"] is not None and self.rules.at_risk(h) and (sweep := self.rules.next_sweep(h["at"])) <= until:
            h = self.rules.passed(h, sweep)
        if due and later:
            self.waiting.put([tuple(o[n] for n in _OUTCOME_NAMES) for o in later])
        elif due:
            self.waiting.clear()
        wake = [min(o["at"] for o in later)] if later else []
        if h["at"] is not None and self.rules.at_risk(h):
            wake.append(self.rules.next_sweep(h["at"]))
        for at in wake:
            # A timer's millisecond must not lie before what it is for.
            self.handle.registerTimer(-(-at // 1000))
        if h != before:
            self._keep(h)
            yield Row(**dict(zip(COMPANY, key, strict=True)), **h)


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """State stores of queries started while this holds keep keyed state in RocksDB."""
    name, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def health_stream(outcomes: DataFrame, companies: DataFrame | None = None, rules: Rules | None = None, late: str = "1 day") -> DataFrame:
    """Every change of a board's health, from a stream of outcomes (provider, slug, at, seq, seen, error, transport_fault).

    companies: the health that boards begin with. Outcomes later than `late` behind the newest are dropped, as streams do.
    A row holds all that is known of the board at its `at`; the last of a board is its present state.
    """
    rows = outcomes.select(*COMPANY, "at", F.unix_micros("at").alias("us"), *_OUTCOME_NAMES[1:])
    begin = None
    if companies is not None:
        held = {n: F.col(n) if n in companies.columns else F.lit(None) for n in _NAMES}
        known = [(F.unix_micros(held[n].cast("timestamp")) if n in TIMES else held[n]).cast(t).alias(n) for n, t in (f.split() for f in HEALTH.split(", "))]
        begin = companies.select(*COMPANY, *known).groupBy(*COMPANY)
    schema = T.StructType([*rows.select(*COMPANY).schema, *T.StructType.fromDDL(HEALTH)])
    found = rows.withWatermark("at", late).groupBy(*COMPANY).transformWithState(BoardHealth(rules or Rules()), schema, "Append", "EventTime", begin)
    return found.withColumns({n: F.timestamp_micros(n) for n in TIMES})
