"""Relative dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def on_or_after(day: Column, weekday: int) -> Column:
    """The first such weekday (Monday 0) from ``day`` on."""
    return F.date_add(day, F.pmod(F.lit(weekday) - F.weekday(day), F.lit(7)))


def relative(name: str, day: Column) -> Column:
    """What an expression means on a day."""
    known = {
        "today": day,
        "tonight": day,
        "tomorrow": F.date_add(day, 1),
        "tomorrow_evening": F.date_add(day, 1),
        "day_after_tomorrow": F.date_add(day, 2),
        "this_weekend_saturday": on_or_after(day, 5),
        "this_weekend_sunday": on_or_after(day, 6),
        "this_saturday": on_or_after(day, 5),
        "this_sunday": on_or_after(day, 6),
        "next_monday": F.next_day(day, "MON"),
        "next_friday": F.next_day(day, "FRI"),
        "next_weekend": on_or_after(F.date_add(day, 1), 5),
    }
    return known[name]


#: The names that are known.
RELATIVE = ("today", "tonight", "tomorrow", "tomorrow_evening", "day_after_tomorrow", "this_weekend_saturday", "this_weekend_sunday", "this_saturday", "this_sunday", "next_monday", "next_friday", "next_weekend")


def is_calendar_day(text: Column) -> Column:
    """Null, or a zero-padded real day."""
    return text.isNull() | (text.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(text, "yyyy-MM-dd").isNotNull())


def is_clock_time(text: Column) -> Column:
    return text.isNull() | text.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
