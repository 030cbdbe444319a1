"""Durations and event-time arithmetic in whole microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_US = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


def micros(duration: str | int) -> int:
    """``"15 minutes"`` or a number of microseconds as microseconds."""
    if isinstance(duration, int):
        return duration
    amount, unit = duration.split()
    return int(amount) * _UNIT_US[unit.rstrip("s")]


def as_column(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def us(ts: Column | str) -> Column:
    return F.unix_micros(as_column(ts).cast("timestamp"))


def shift(ts: Column | str, by_us: Column | int) -> Column:
    """Event time moved by a number of microseconds."""
    offset = F.lit(by_us) if isinstance(by_us, int) else by_us
    return F.timestamp_micros(us(ts) + offset)


def bucket(ts: Column | str, width: str | int | None) -> Column | None:
    """Number of the fixed-width time bucket that holds ``ts``; no width, no bucket."""
    if width is None:
        return None
    width_us = F.lit(micros(width))
    value = us(ts)
    return ((value - F.pmod(value, width_us)) / width_us).cast("bigint")

