from margincast.functions.dates import (week_label, calendar_columns, week_spine_bounds,
                                        fmt_date)
from margincast.functions.holidays import holiday_calendar, BASE_HOLIDAYS
from margincast.functions import scalars

__all__ = ["week_label", "calendar_columns", "week_spine_bounds", "fmt_date",
           "holiday_calendar", "BASE_HOLIDAYS", "scalars"]
