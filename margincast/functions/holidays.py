"""H6: national holiday calendar built as a Spark table from the year range.

Fixed-date holidays plus Easter-relative ones (Good Friday, optional Carnival
and Corpus Christi), with Easter Sunday computed by the Gregorian computus in
plain SQL arithmetic.  The table has at most a dozen rows per year, so it is
safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# National holidays (month, day, name, first year in force).
BASE_HOLIDAYS = [
    (1, 1, "New Year's Day", None),
    (4, 21, "Tiradentes' Day", None),
    (5, 1, "Worker's Day", None),
    (9, 7, "Independence Day", None),
    (10, 12, "Our Lady of Aparecida", None),
    (11, 2, "All Souls' Day", None),
    (11, 15, "Republic Proclamation Day", None),
    (11, 20, "National Day of Zumbi and Black Awareness", 2024),
    (12, 25, "Christmas Day", None),
]

# Easter offsets in days.  Good Friday is always on; the other two differ
# between calendar versions and are opt-in.
EASTER_HOLIDAYS = {"good_friday": (-2, "Good Friday"),
                   "carnival_monday": (-48, "Carnival"),
                   "carnival_tuesday": (-47, "Carnival"),
                   "corpus_christi": (60, "Corpus Christi")}


def _easter_sunday(y):
    a = y % 19
    b = F.floor(y / 100)
    c = y % 100
    d = F.floor(b / 4)
    e = b % 4
    f = F.floor((b + 8) / 25)
    g = F.floor((b - f + 1) / 3)
    h = (19 * a + b - d - g + 15) % 30
    i = F.floor(c / 4)
    k = c % 4
    l_ = (32 + 2 * e + 2 * i - h - k) % 7
    m = F.floor((a + 11 * h + 22 * l_) / 451)
    t = h + l_ - 7 * m + 114
    month = F.floor(t / 31)
    day = t % 31 + 1
    return F.make_date(y, month.cast("int"), day.cast("int"))


def holiday_calendar(years: DataFrame, year_col: str = "year",
                     extra: tuple[str, ...] = ()) -> DataFrame:
    """(holiday_date date, name string) for every year in ``years``.

    ``years`` is any DataFrame with one int column of years (e.g. the distinct
    years of the cube, or ``sequence(min, max)`` exploded).
    """
    y = F.col(year_col)
    fixed = F.array(*[
        F.struct(F.when(F.lit(since).isNull() | (y >= F.lit(since)), F.make_date(y, F.lit(m), F.lit(d)))
                 .alias("holiday_date"), F.lit(name).alias("name"))
        for m, d, name, since in BASE_HOLIDAYS])
    easter = _easter_sunday(y)
    movable = F.array(*[
        F.struct(F.date_add(easter, off).alias("holiday_date"), F.lit(name).alias("name"))
        for key, (off, name) in EASTER_HOLIDAYS.items()
        if key == "good_friday" or key in extra])
    return (years.select(F.explode(F.concat(fixed, movable)).alias("h"))
            .select("h.holiday_date", "h.name")
            .where(F.col("holiday_date").isNotNull())
            .groupBy("holiday_date")
            .agg(F.concat_ws("; ", F.array_sort(F.collect_set("name"))).alias("name")))


def year_range(df: DataFrame, date_col: str = "Date") -> DataFrame:
    """Years from the data's min to max date, as a one-column table."""
    return (df.agg(F.min(F.year(date_col)).alias("lo"), F.max(F.year(date_col)).alias("hi"))
            .select(F.explode(F.sequence("lo", "hi")).alias("year")))
