"""Service-day clock values, weekdays and speeds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_text(seconds: Column) -> Column:
    """HH:MM:SS of seconds of the service day; hours may pass 24."""
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat_ws(":", part(F.floor(seconds / 3600)), part(F.floor(seconds / 60) % 60), part(seconds % 60))


def clock_seconds(text: Column) -> Column:
    """Seconds of H:MM or H:MM:SS; null if malformed. Hours may pass 24."""
    parts = F.split(F.trim(text), ":")
    at = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    good = text.rlike(r"^\s*\d{1,2}:[0-5]\d(:[0-5]\d)?\s*$")
    return F.when(good, at(0) * 3600 + at(1) * 60 + F.coalesce(at(2), F.lit(0)))


def display_clock(seconds: Column) -> Column:
    """Wall-clock label HH:MM[:SS] with +days behind it; seconds are shown unless 00."""
    part = lambda x: F.lpad(x.cast("string"), 2, "0")
    days = F.floor(seconds / 86400)
    label = F.concat_ws(":", part(F.floor(seconds / 3600) % 24), part(F.floor(seconds / 60) % 60), F.when(seconds % 60 > 0, part(seconds % 60)))
    return F.concat(label, F.when(days > 0, F.concat(F.lit(" +"), days.cast("string"))).otherwise(F.lit("")))


def is_rush_hour(weekday: Column, second: Column) -> Column:
    """Monday to Friday 07:00-09:30 and 16:30-19:30, half-open; weekday 0 is Monday."""
    within = lambda a, b: (second >= a) & (second < b)
    return (weekday < 5) & (within(25_200, 34_200) | within(59_400, 70_200))


#: km/h of each kind of line, in rush hours and else.
SPEEDS = {"city": (16, 23), "district": (25, 35), "tram": (25, 25)}


def speed_kmh(kind: Column, rush: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, (busy, free) in SPEEDS.items():
        out = F.when(kind == name, F.when(rush, busy).otherwise(free)).otherwise(out)
    return out
