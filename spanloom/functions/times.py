"""Timestamps, day keys and fixed-width time slots."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339_PATTERN = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})$"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(at: datetime | str) -> Column:
    """A point in time given by the caller; without a zone it means UTC."""
    if isinstance(at, datetime) and at.tzinfo is None:
        at = at.replace(tzinfo=timezone.utc)
    return F.lit(at).cast("timestamp")


def is_rfc3339(text: Column) -> Column:
    return text.rlike(RFC3339_PATTERN)


def parse_rfc3339(text: Column) -> Column:
    """RFC 3339 text as a timestamp cut to milliseconds; NULL for a date that does not exist.

    The cast takes more spellings than RFC 3339 has, so ask :func:`is_rfc3339` first.
    """
    return F.date_trunc("MILLISECOND", text.try_cast("timestamp"))


def to_millis(ts: Column | str) -> Column:
    return F.date_trunc("MILLISECOND", _col(ts))


def day_key(ts: Column | str) -> Column:
    """Event day as the integer yyyyMMdd, the partition column of every table."""
    return F.date_format(_col(ts), "yyyyMMdd").cast("int")


def expires_at(ts: Column | str, days: int) -> Column:
    """When a row of this age leaves its table."""
    return F.date_trunc("SECOND", _col(ts)) + F.expr(f"INTERVAL {int(days)} DAYS")


def slot(ts: Column | str, seconds: int) -> Column:
    """Number of the ``seconds``-wide slot a timestamp falls in."""
    return F.floor(F.unix_seconds(_col(ts).cast("timestamp")) / F.lit(int(seconds))).cast("bigint")


def slot_start(ts: Column | str, seconds: int) -> Column:
    """Start of the ``seconds``-wide slot a timestamp falls in."""
    return F.timestamp_seconds(slot(ts, seconds) * F.lit(int(seconds)))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.unix_seconds(_col(end).cast("timestamp")) - F.unix_seconds(_col(start).cast("timestamp"))
