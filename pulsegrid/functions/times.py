"""Time column functions. Everything is UTC; the present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3.6e9


def hours_between(start: Column, end: Column) -> Column:
    """Hours from start to end; null where unknown or negative."""
    h = (F.unix_micros(end) - F.unix_micros(start)) / HOUR
    return F.when(h >= 0, h)


def age_hours(ts: Column, now: Column) -> Column:
    """Hours since ts, 0 for the future, null where unknown."""
    return F.when(ts.isNotNull(), F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(ts)) / HOUR))


def to_timestamp_lenient(text: Column) -> Column:
    """Epoch seconds (below 1e11), epoch milliseconds, stream ids (milliseconds-sequence) or ISO text; else null."""
    t = F.trim(text)
    number = t.try_cast("double")
    millis = F.when(F.abs(number) < 1e11, number * 1000).otherwise(number)
    stream = F.regexp_extract(t, r"^(\d+)-\d+$", 1).try_cast("long")
    iso = F.try_to_timestamp(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t))
    return F.when(number.isNotNull(), F.timestamp_millis(millis.cast("long"))).when(t.rlike(r"^\d+-\d+$"), F.timestamp_millis(stream)).otherwise(iso)


def zoned_timestamp(text: Column) -> Column:
    """ISO text that names its offset; naive times are null."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), text)))


def collector_time(text: Column) -> Column:
    """`Wed Oct 10 20:19:24 +0000 2018`; null where it is in another form."""
    return F.try_to_timestamp(F.when(text.rlike(r"^\w{3} \w{3} \d{2} "), F.substring(text, 5, 100)), F.lit("MMM dd HH:mm:ss Z yyyy"))


def epoch_seconds(value: Column) -> Column:
    """Epoch seconds; 0 and missing are null."""
    return F.timestamp_seconds(F.nullif(value.try_cast("double"), F.lit(0.0)))


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM d")


def hour_label(ts: Column) -> Column:
    return F.date_format(ts, "MMM d HH:00")
