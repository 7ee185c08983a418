"""H1–H5, H7: date expressions (all built-in, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def week_label(ts) -> Column:
    """H1: weekly bin closed on the right and labelled by its Monday.

    A bin is (Tuesday 00:00 .. Monday 23:59:59.999]; any instant on a Monday
    maps to that Monday, Tuesday..Sunday map to the following Monday.
    """
    return F.next_day(F.date_sub(F.to_date(_c(ts)), 1), "MON")


def iso_week(d) -> Column:
    """H3: ISO-8601 week number (2018-12-31 → 1)."""
    return F.weekofyear(_c(d))


def day_of_week(d) -> Column:
    """H4: Monday = 0 … Sunday = 6."""
    return F.weekday(_c(d))


def calendar_columns(d="Date", holiday_col: bool = False) -> dict[str, Column]:
    """H2–H4: Year, Month, Week (ISO), Quarter, DayOfWeek, IsWeekend."""
    d = _c(d)
    dow = day_of_week(d)
    return {
        "Year": F.year(d),
        "Month": F.month(d),
        "Week": iso_week(d),
        "Quarter": F.quarter(d),
        "DayOfWeek": dow,
        "IsWeekend": dow.isin(5, 6).cast("int"),
    }


def week_spine_bounds(lo, hi) -> Column:
    """H5: array of every Monday-aligned week label between two week labels."""
    return F.sequence(_c(lo), _c(hi), F.expr("INTERVAL 7 DAYS"))


def fmt_date(d) -> Column:
    """H7: yyyy-MM-dd text."""
    return F.date_format(_c(d), "yyyy-MM-dd")
