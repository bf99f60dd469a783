"""Date and time column expressions. ``today`` and ``now`` are parameters, so reruns agree."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from shiftlens.functions.fixed import DATE_FORMAT, ISO_FORMAT, LOG_FORMAT, TODAY, YESTERDAY


def iso_text(ts: Column) -> Column:
    """A timestamp as ISO text with microseconds."""
    return F.date_format(ts, ISO_FORMAT)


def parse_time(text: Column) -> Column:
    """A timestamp without zone from ISO or log text; null when it is neither."""
    return text.try_cast("timestamp_ntz")


def log_time_text(ts: Column) -> Column:
    """A timestamp the way the token log writes it."""
    return F.date_format(ts, LOG_FORMAT)


def date_text(ts: Column) -> Column:
    """The calendar date as text."""
    return F.date_format(ts, DATE_FORMAT)


def relative_date(ts: Column, today: dt.date) -> Column:
    """``Today``, ``Yesterday`` or the date."""
    day = F.to_date(ts)
    return (
        F.when(day == F.lit(today), TODAY)
        .when(day == F.date_sub(F.lit(today), 1), YESTERDAY)
        .otherwise(date_text(ts))
    )


def on_date(ts: Column, day: dt.date) -> Column:
    """Rows of one calendar date, as a range on the timestamp so that it reaches the file scan."""
    start = dt.datetime.combine(day, dt.time())
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (
        ts < F.lit(start + dt.timedelta(days=1)).cast("timestamp_ntz")
    )


def created_or(ts: Column, now: dt.datetime) -> Column:
    """The creation time, ``now`` when it is missing."""
    return F.coalesce(ts, F.lit(now).cast("timestamp_ntz"))
