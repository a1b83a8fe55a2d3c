"""Dates, local seconds and time windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The working horizon of a day, in seconds.
HORIZON = (28800.0, 86400.0)


def day_type(day: Column) -> Column:
    return F.when(F.weekday(day) >= 5, "weekend").otherwise("weekday")


def local_seconds(ts: Column, zone: str, day: Column) -> Column:
    """Seconds of a UTC timestamp after local midnight of `day`."""
    return F.unix_timestamp(F.from_utc_timestamp(ts, zone)) - F.unix_timestamp(day.cast("timestamp"))


def window_hours(start: Column, end: Column) -> Column:
    return (F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600.0


def clipped_window(start: Column, end: Column) -> tuple[Column, Column, Column]:
    """A window cut to HORIZON, and whether anything was cut."""
    low, high = F.greatest(start, F.lit(HORIZON[0])), F.least(end, F.lit(HORIZON[1]))
    return low, high, (low != start) | (high != end)


def travel_seconds(length_m: Column, kph: Column) -> Column:
    return length_m * 3.6 / kph
