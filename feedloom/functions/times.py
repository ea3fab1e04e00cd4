"""Dates and times; the clock is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY_MS = 86_400_000


def unix_to_ts(c: Column) -> Column:
    """Seconds; null and 0 give null."""
    return F.when(c != 0, F.timestamp_seconds(c))


def epoch_ms_to_ts(c: Column) -> Column:
    """Milliseconds; null and 0 give null."""
    return F.when(c != 0, F.timestamp_millis(c))


def parse_date(c: Column) -> Column:
    """ISO text; null where it is not a date."""
    return F.try_to_timestamp(c)


def _ago(now: Column, days: Column) -> Column:
    return F.timestamp_millis(F.unix_millis(now) - days.cast("long") * _DAY_MS)


def parse_relative(c: Column, now: Column) -> Column:
    """`Posted Today`, `Yesterday`, `3+ weeks ago`, against the clock given; a month has 30 days."""
    text = F.lower(c)
    count = F.try_to_number(F.regexp_extract(text, r"(\d+)\s*\+?\s*(day|week|month)s?\s*ago", 1), F.lit("9999999")).cast("long")
    unit = F.regexp_extract(text, r"(\d+)\s*\+?\s*(day|week|month)s?\s*ago", 2)
    days = F.when(unit == "day", 1).when(unit == "week", 7).when(unit == "month", 30)
    return F.when(text.rlike("today|just"), now).when(text.contains("yesterday"), _ago(now, F.lit(1))).when(unit != "", _ago(now, count * days))


def parse_age(c: Column, now: Column) -> Column:
    """`about 1 month`, `2 years`; a month has 30 days, a year 365."""
    pattern = r"(?i)(\d+)\s*(minute|hour|day|week|month|year)s?"
    count, unit = F.regexp_extract(c, pattern, 1), F.lower(F.regexp_extract(c, pattern, 2))
    ms = F.when(unit == "minute", 60_000).when(unit == "hour", 3_600_000).when(unit == "day", _DAY_MS).when(unit == "week", 7 * _DAY_MS).when(unit == "month", 30 * _DAY_MS).when(unit == "year", 365 * _DAY_MS)
    return F.when(unit != "", F.timestamp_millis(F.unix_millis(now) - F.expr("1") * count.try_cast("long") * ms))


# Date formats by shape.
FORMATS = (
    (r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"),
    (r"^\d{2}-\d{2}-\d{4} \d{2}:\d{2}:\d{2}$", "dd-MM-yyyy HH:mm:ss"),
    (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}-[A-Z][a-z]{2}-\d{4}$", "d-MMM-yyyy"),
)
# The one format that a vendor's dates have; those of other vendors go by shape.
VENDOR_FORMATS = {"moglix": 0, "redbus": 1, "zappyhire": 2, "sfcsb": 3, "bmw": 5, "brassring": 6}


def parse_vendor_date(c: Column, vendor: str | None = None) -> Column:
    """A date in the vendor's format, or by its shape, else ISO; null where it is neither. A time without a zone is UTC.

    Vendors with a format of their own take no other, except that brassring's falls back to ISO.
    """
    text = F.btrim(c)
    tried = [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(form))) for shape, form in FORMATS]
    if vendor in VENDOR_FORMATS and vendor != "brassring":
        return tried[VENDOR_FORMATS[vendor]]
    return F.coalesce(*tried, F.try_to_timestamp(text))


def ist_date(ts: Column) -> Column:
    """The date in India."""
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Kolkata"))
