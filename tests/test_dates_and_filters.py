import datetime as dt

from pyspark.sql import functions as F

from margincast.functions.dates import calendar_columns, week_label
from margincast.functions.holidays import holiday_calendar
from margincast.operators.sales import category_family


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_week_bucket_closed_on_monday(spark):
    rows = [("2018-01-01 00:00:00", "2018-01-01"),   # Monday 00:00 → itself
            ("2018-01-01 15:00:00", "2018-01-01"),   # Monday afternoon → itself
            ("2018-01-01 23:59:59", "2018-01-01"),
            ("2018-01-02 00:00:00", "2018-01-08"),   # Tuesday → next Monday
            ("2018-01-07 10:00:00", "2018-01-08")]   # Sunday → next Monday
    df = spark.createDataFrame([(ts(a), b) for a, b in rows], "t timestamp_ntz, want string")
    got = df.select(F.date_format(week_label("t"), "yyyy-MM-dd").alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_iso_week_at_year_end(spark):
    df = spark.createDataFrame([(dt.date(2018, 12, 31),)], "Date date")
    r = df.select(*[v.alias(k) for k, v in calendar_columns("Date").items()]).first()
    assert (r.Year, r.Week, r.DayOfWeek, r.IsWeekend) == (2018, 1, 0, 0)
    sun = spark.createDataFrame([(dt.date(2018, 12, 30),)], "Date date")
    r = sun.select(*[v.alias(k) for k, v in calendar_columns("Date").items()]).first()
    assert (r.DayOfWeek, r.IsWeekend) == (6, 1)


def test_family_filter_prefix_case_and_null(spark):
    df = spark.createDataFrame([("fashion_x",), ("FASHION_x",), ("fashio_x",), (None,)],
                               "product_category_name_english string")
    kept = sorted(r[0] for r in category_family(df).collect())
    assert kept == ["FASHION_x", "fashion_x"]


def test_holiday_calendar_rules(spark):
    years = spark.createDataFrame([(2018,), (2023,), (2024,)], "year int")
    days = {r.holiday_date for r in holiday_calendar(years).collect()}
    assert dt.date(2018, 3, 30) in days          # Good Friday 2018 (Easter 1 April)
    assert dt.date(2024, 3, 29) in days          # Good Friday 2024 (Easter 31 March)
    assert dt.date(2024, 11, 20) in days and dt.date(2023, 11, 20) not in days
    assert dt.date(2018, 9, 7) in days and dt.date(2018, 12, 25) in days
    assert len([d for d in days if d.year == 2018]) == 9
    assert len([d for d in days if d.year == 2024]) == 10
