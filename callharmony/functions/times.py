"""Call-time rules. Each gives null for text it cannot read, also under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def text_to_ts(value: Column) -> Column:
    """Timestamp text as it stands, with no zone shift."""
    return F.try_to_timestamp(value)


def wall_to_utc(wall: Column, tz: str) -> Column:
    """A wall-clock timestamp in the named zone, as UTC. The session zone must be UTC.

    An hour skipped in spring moves forward; an hour repeated in autumn takes the
    earlier of its two offsets.
    """
    return F.to_utc_timestamp(wall, tz)


def local_to_utc(value: Column, tz: str) -> Column:
    """Wall-clock text in the named zone, as UTC."""
    return wall_to_utc(text_to_ts(value), tz)


def join_date_time(date: Column, time: Column) -> Column:
    """Date text and time text as one; null if either is missing."""
    return F.concat(date, F.lit(" "), time)


def epoch_ms_to_ts(value: Column) -> Column:
    """Milliseconds since 1970, kept exact to the millisecond."""
    return F.timestamp_millis(value)
