"""Date and interval functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_to_utc(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_utc_timestamp(ts, zone)


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Closed intervals overlap; an unknown interval overlaps everything."""
    return F.coalesce((a0 <= b1) & (b0 <= a1), F.lit(True))


def disjoint(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Closed intervals are apart; an unknown one is apart from none."""
    return F.coalesce((a1 < b0) | (b1 < a0), F.lit(False))


def matches(a0: Column, a1: Column, w0: Column, w1: Column) -> Column:
    """A known interval meets a window."""
    return F.coalesce((a0 <= w1) & (w0 <= a1), F.lit(False))


def next_occurrence(now: Column, minute_of_day: Column, weekdays: Column) -> Column:
    """The next local time, strictly after now, at a minute of the day on one of the weekdays (0 is Monday); null without one in eight days."""
    days = F.sequence(F.lit(0), F.lit(7))
    midnight = F.date_trunc("day", now)
    at = lambda d: F.timestamp_add("MINUTE", (d * 1440 + minute_of_day).cast("int"), midnight)
    good = F.filter(F.transform(days, at), lambda t: (t > now) & F.array_contains(weekdays, F.weekday(t)))
    return F.array_min(good)


def backoff_seconds(attempt: Column, base: float) -> Column:
    """base doubled with each attempt after the first."""
    return F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
