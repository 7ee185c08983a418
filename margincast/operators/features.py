"""E1–E6 (+ X1–X3, J9, J10, A18, A20): the three feature frames.

* ``batch_features``   — 22 features of the batch script (lags 1/4, inclusive
  rolling mean 4, diffs, holiday flag, zero-filled);
* ``service_features`` — 20 features of the service (exclusive rolling mean 4,
  rows with any null dropped);
* ``dense_features``   — 41 features over the densified product × week grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margincast.functions.dates import calendar_columns
from margincast.functions.holidays import holiday_calendar, year_range
from margincast.functions.scalars import cyclical, discount_pct, is_discounted, round_places
from margincast.operators.cube import (collapse_regions, densify, encode_large, encode_small, fallback_value,
                                       mean_over_weeks, min_volume, popular)
from margincast.operators.sales import CATEGORY
from margincast.operators.windows import by_product, fill_sequence, fill_within_product, lag, rolling
from margincast.session import reuse

DIM_MEANS = ["Weight_g_Mean", "Length_cm_Mean", "Height_cm_Mean", "Width_cm_Mean"]
P, Q = "AverageSellingPrice", "QuantitySold"

# Feature lists of the three frames, in their original order.
BATCH_FEATURES = [
    "product_encoded", "category_encoded", "seller_state_encoded",
    "AverageSellingPrice", "Weight_g_Mean", "Length_cm_Mean", "Height_cm_Mean", "Width_cm_Mean",
    "Year", "Month", "Week", "Quarter", "IsWeekend", "IsHoliday",
    "AverageSellingPrice_Lag_1", "AverageSellingPrice_Lag_4", "AverageSellingPrice_Roll_Mean_4",
    "QuantitySold_Lag_1", "QuantitySold_Lag_4", "QuantitySold_Roll_Mean_4",
    "Price_Diff_Lag_1", "Qty_Diff_Lag_1",
]
# The two columns that contain the target (units = lag1 + diff; the
# inclusive roll averages the current units); left out unless parity is asked.
LEAKY = ["QuantitySold_Roll_Mean_4", "Qty_Diff_Lag_1"]
SAFE_BATCH_FEATURES = [c for c in BATCH_FEATURES if c not in LEAKY]

SERVICE_FEATURES = [
    "category_encoded", "seller_state_encoded",
    "AverageSellingPrice", "Weight_g_Mean", "Length_cm_Mean", "Height_cm_Mean", "Width_cm_Mean",
    "Year", "Month", "Week", "Quarter", "IsWeekend",
    "AverageSellingPrice_Lag_1", "AverageSellingPrice_Lag_4",
    "QuantitySold_Lag_1", "QuantitySold_Lag_4",
    "AverageSellingPrice_Roll_Mean_4", "QuantitySold_Roll_Mean_4",
    "Price_Diff_Lag_1", "Qty_Diff_Lag_1",
]

DENSE_FEATURES = [
    "category_encoded", "seller_state_encoded",
    "Year", "Month", "Week", "Month_Sin", "Month_Cos", "Week_Sin", "Week_Cos",
    "DayOfWeek", "IsWeekend", "Quarter",
    "AverageSellingPrice", "Price_Lag_1", "Price_Diff_Lag_1", "Price_Roll_Mean_4",
    "Qty_Lag_1", "Qty_Roll_Mean_4",
    "Qty_Lag_2", "Qty_Lag_52", "Qty_Roll_Std_4", "Qty_Roll_Mean_12", "Qty_Lag_3", "Qty_Lag_4",
    "Qty_Lag_8", "Price_Lag_2", "Qty_Roll_Mean_8", "Qty_Roll_Std_8", "Qty_Roll_Max_8",
    "Price_Roll_Mean_8", "Qty_Roll_Max_4", "Qty_Roll_Max_12",
    "Discount_Pct_Approx", "Is_Discounted_Approx",
    "Weight_g_Mean", "Length_cm_Mean", "Height_cm_Mean", "Width_cm_Mean",
    "Cat_x_Weekend", "PriceLag1_x_MonthSin", "QtyLag1_x_SellerState",
]
# the null-drop list of the dense frame (22 columns)
DENSE_REQUIRED = [
    "Qty_Lag_1", "Price_Lag_1", "Qty_Roll_Mean_4", "Price_Roll_Mean_4",
    "Qty_Lag_2", "Qty_Lag_52", "Qty_Roll_Std_4", "Qty_Roll_Mean_12",
    "Qty_Lag_3", "Qty_Lag_4", "Qty_Lag_8", "Price_Lag_2",
    "Qty_Roll_Mean_8", "Qty_Roll_Std_8", "Qty_Roll_Max_8", "Price_Roll_Mean_8",
    "Qty_Roll_Max_4", "Qty_Roll_Max_12",
    "Discount_Pct_Approx", "Cat_x_Weekend", "PriceLag1_x_MonthSin", "QtyLag1_x_SellerState",
]


def holiday_flag(df: DataFrame, date_col: str = "Date", out: str = "IsHoliday",
                 years: DataFrame | None = None) -> DataFrame:
    """1 when the row's date is a holiday (broadcast: ≤ a dozen rows a year).
    ``years`` (one int column ``year``) defaults to the span of ``df``."""
    years = years if years is not None else year_range(df, date_col)
    hol = holiday_calendar(years).select(
        F.col("holiday_date").alias(date_col), F.lit(1).alias(out))
    return (df.join(F.broadcast(hol), date_col, "left")
            .withColumn(out, F.coalesce(out, F.lit(0))))


def holiday_week_flag(df: DataFrame, out: str = "IsHolidayWeek",
                      years: DataFrame | None = None) -> DataFrame:
    """1 when any holiday shares the row's (calendar Year, ISO Week).

    Calendar year with ISO week is the literal key (2018-12-31 is (2018, 1)
    and so collides with January of 2018)."""
    hol = holiday_calendar(years if years is not None else year_range(df, "Date"))
    weeks = (hol.select(F.year("holiday_date").alias("Year"),
                        F.weekofyear("holiday_date").alias("Week"))
             .distinct().withColumn(out, F.lit(1)))
    return (df.join(F.broadcast(weeks), ["Year", "Week"], "left")
            .withColumn(out, F.coalesce(out, F.lit(0))))


def calendar_days(cube: DataFrame, rounded: dict[str, int] | None = None) -> DataFrame:
    """X1, J9, H2-H4 by date: calendar columns, holiday week flag and cyclical
    terms of every day from the first to the last of ``cube``, so a frame of many
    products looks a date up instead of working it out in every row.  ``rounded``
    (column: places) rounds its columns; ``_month_sin`` stays as it is."""
    days = (cube.agg(F.min("Date").alias("lo"), F.max("Date").alias("hi"))
            .select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("Date")))
    days = holiday_week_flag(days.withColumns(calendar_columns("Date")), years=year_range(cube))
    ms, mc = cyclical("Month", 12)
    days = days.withColumns({"Month_Sin": ms, "Month_Cos": mc, "Week": F.col("Week").cast("double")})
    ws, wc = cyclical("Week", 52)
    days = days.withColumns({"Week_Sin": ws, "Week_Cos": wc, "_month_sin": F.col("Month_Sin")})
    return days.withColumns({c: round_places(c, n) for c, n in (rounded or {}).items() if c in days.columns})


def rolls_by_frame(w) -> dict:
    """W2-W4 of the dense frame as sliding frames, which skip nulls."""
    return {
        "Qty_Roll_Mean_4": rolling(Q, 4, "mean", False, w),
        "Price_Roll_Mean_4": rolling(P, 4, "mean", False, w),
        "Qty_Roll_Std_4": rolling(Q, 4, "std", False, w),
        "Qty_Roll_Mean_12": rolling(Q, 12, "mean", False, w),
        "Qty_Roll_Mean_8": rolling(Q, 8, "mean", False, w),
        "Qty_Roll_Std_8": rolling(Q, 8, "std", False, w),
        "Qty_Roll_Max_8": rolling(Q, 8, "max", False, w),
        "Price_Roll_Mean_8": rolling(P, 8, "mean", False, w),
        "Qty_Roll_Max_4": rolling(Q, 4, "max", False, w),
        "Qty_Roll_Max_12": rolling(Q, 12, "max", False, w),
    }


def rolls_by_lag(df: DataFrame) -> DataFrame:
    """The same from lag columns without nulls (units 1-12, price 1-8).  Prices are
    added oldest first, as a frame adds them; units are whole numbers, so their
    sums and squares are exact."""
    def total(c, first, last, power=1):
        terms = [F.col(f"{c}_Lag_{k}").cast("double") for k in range(last, first - 1, -1)]
        terms = [t * t for t in terms] if power == 2 else terms
        return sum(terms[1:], terms[0])

    def std(s, x, n):
        return F.sqrt((n * F.col(x) - F.col(s) * F.col(s)) / F.lit(float(n * (n - 1))))

    most = lambda n: F.greatest(*[f"Qty_Lag_{k}" for k in range(1, n + 1)])
    df = df.withColumns({"_s4": total("Qty", 1, 4), "_x4": total("Qty", 1, 4, 2), "_s5": total("Qty", 5, 8), "_x5": total("Qty", 5, 8, 2),
                         "_s9": total("Qty", 9, 12)})
    df = df.withColumns({"_s8": F.col("_s5") + F.col("_s4"), "_x8": F.col("_x5") + F.col("_x4")})
    out = df.withColumns({
        "Qty_Roll_Mean_4": F.col("_s4") / 4.0, "Price_Roll_Mean_4": total("Price", 1, 4) / 4.0, "Qty_Roll_Std_4": std("_s4", "_x4", 4),
        "Qty_Roll_Mean_12": (F.col("_s9") + F.col("_s8")) / 12.0, "Qty_Roll_Mean_8": F.col("_s8") / 8.0,
        "Qty_Roll_Std_8": std("_s8", "_x8", 8), "Qty_Roll_Max_8": most(8), "Price_Roll_Mean_8": total("Price", 1, 8) / 8.0,
        "Qty_Roll_Max_4": most(4), "Qty_Roll_Max_12": most(12)})
    return out.drop("_s4", "_x4", "_s5", "_x5", "_s9", "_s8", "_x8")


def encode_all(df: DataFrame, product: bool = True) -> DataFrame:
    """E1 on category (small) and product (any size)."""
    out = encode_small(df, CATEGORY, "category_encoded")
    if product:
        out = encode_large(out, "product_id", "product_encoded")
    return out


def batch_features(cube: DataFrame, min_units: int = 1,
                   fill_scope: str = "product", fill_order: list[str] | None = None) -> DataFrame:
    """The batch feature frame (every column of the 22-feature list).

    One window pass fills price and dimensions (forward then backward within
    the product; ``fill_scope="global"`` for the whole-sequence backward
    fill; ``fill_scope="sequence"`` for fills over the rows in ``fill_order``, by
    default the cube's own (category, region, date), with the backward fill
    running on across products); the filled frame is kept for reuse so the median fallback, the
    dictionaries and the lag/roll windows all read it once, on its product
    partitioning."""
    df = popular(cube, min_units)
    default = {c: 0.0 for c in DIM_MEANS}
    if fill_scope == "sequence":
        df = fill_sequence(df, [P] + DIM_MEANS, fill_order or [CATEGORY, "seller_state_encoded", "Date"], default)
    else:
        df = fill_within_product(df, [P] + DIM_MEANS, fill_order, default=default, scope=fill_scope)
    df = reuse(df)
    med = fallback_value(df, P, "median")
    df = df.withColumn(P, F.coalesce(P, F.lit(med)))
    df = encode_all(df)
    cal = calendar_columns("Date")
    df = df.withColumns({k: cal[k] for k in ("Year", "Month", "Week", "Quarter", "IsWeekend")})
    df = holiday_flag(df, years=year_range(cube))
    w = by_product()
    df = df.withColumns({
        f"{P}_Lag_1": lag(P, 1, w), f"{P}_Lag_4": lag(P, 4, w),
        f"{P}_Roll_Mean_4": rolling(P, 4, "mean", True, w),
        f"{Q}_Lag_1": lag(Q, 1, w), f"{Q}_Lag_4": lag(Q, 4, w),
        f"{Q}_Roll_Mean_4": rolling(Q, 4, "mean", True, w),
        "Price_Diff_Lag_1": F.col(P) - lag(P, 1, w),
        "Qty_Diff_Lag_1": F.col(Q) - lag(Q, 1, w),
    })
    # every remaining null → 0 (first rows of each product)
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                         for c in [f"{P}_Lag_1", f"{P}_Lag_4", f"{Q}_Lag_1", f"{Q}_Lag_4",
                                   "Price_Diff_Lag_1", "Qty_Diff_Lag_1"]})
    return df


def service_features(cube: DataFrame, min_units: int = 10) -> DataFrame:
    """The service feature frame; rows with any null are dropped (F8).
    The popular rows are kept for reuse: the category dictionary and the
    window pass both read them (one shuffle of the cube by product)."""
    df = reuse(popular(cube, min_units))
    df = encode_small(df, CATEGORY, "category_encoded")
    cal = calendar_columns("Date")
    df = df.withColumns({k: cal[k] for k in ("Year", "Month", "Week", "Quarter", "IsWeekend")})
    w = by_product()
    df = df.withColumns({
        f"{Q}_Lag_1": lag(Q, 1, w), f"{Q}_Lag_4": lag(Q, 4, w),
        f"{P}_Lag_1": lag(P, 1, w), f"{P}_Lag_4": lag(P, 4, w),
        f"{Q}_Roll_Mean_4": rolling(Q, 4, "mean", False, w),
        f"{P}_Roll_Mean_4": rolling(P, 4, "mean", False, w),
    })
    df = df.withColumns({"Price_Diff_Lag_1": F.col(P) - F.col(f"{P}_Lag_1"),
                         "Qty_Diff_Lag_1": F.col(Q) - F.col(f"{Q}_Lag_1")})
    return df.na.drop(how="any")


def dense_features(cube: DataFrame, drop_filled: bool = False, min_total: float = 5,
                   collapse: bool = False, rounded: dict[str, int] | None = None) -> DataFrame:
    """The dense frame: grid, fills, calendar, holiday week, cyclical,
    lags 1–4/8/52, shifted rolling mean/std/max, discount and interaction
    features, 22-column null drop, low-volume filter (A20).

    Fills run on the cube's rows; the generator that makes the grid carries the
    filled values into the empty weeks, so the products × weeks frame is only
    read by the lag and rolling windows.  The global mean fallback,
    dictionaries and the calendar come from the much smaller cube.

    ``rounded`` (column: places) rounds those columns of the result as ``round``
    does: what a date fixes once a day, the rest after the filters.  A generated
    method of over 8,000 bytecodes is never compiled, so no stage may take on
    much more than it has (``explain("codegen")`` gives the sizes)."""
    if collapse:
        cube = collapse_regions(cube)
    order = ["Date", "seller_state_encoded"]
    full = reuse(fill_within_product(cube, [P] + DIM_MEANS, order, default={c: 0.0 for c in DIM_MEANS}))
    mean_price = mean_over_weeks(full, P)
    df = densify(full.withColumn(P, F.coalesce(P, F.lit(mean_price))), drop_filled=drop_filled, carry=True)
    df = encode_small(df, CATEGORY, "category_encoded", source=cube)
    days = calendar_days(cube, rounded)                              # one row a day of the span
    at_day = [c for c in days.columns if c not in ("Date", "Year", "Week")]
    df = df.join(F.broadcast(days), "Date", "left").select("Year", "Week", *df.columns, *at_day)
    w = by_product(order)
    lags = {**{f"Qty_Lag_{k}": lag(Q, k, w) for k in (1, 2, 3, 4, 8, 52)}, **{f"Price_Lag_{k}": lag(P, k, w) for k in (1, 2)}}
    if full.where(F.col(Q).isNull()).isEmpty():
        # a sliding frame goes over its rows again in every row; lags do not.  A row that has
        # a 52nd one before it has the nearer ones, and the price is filled in all of a product's rows or in none
        near = {**{f"Qty_Lag_{k}": lag(Q, k, w) for k in (5, 6, 7, 9, 10, 11, 12)},
                **{f"Price_Lag_{k}": lag(P, k, w) for k in range(3, 9)}}
        df = rolls_by_lag(df.withColumns({**lags, **near}).na.drop(subset=[*lags, *near])).drop(*near)
        required = [c for c in DENSE_REQUIRED if c not in lags and "_Roll_" not in c]
    else:
        df = df.withColumns({**lags, **rolls_by_frame(w)})
        required = DENSE_REQUIRED
    df = df.withColumn("Price_Diff_Lag_1", F.col(P) - F.col("Price_Lag_1"))
    disc = discount_pct("Price_Roll_Mean_4", P)
    df = df.withColumn("Discount_Pct_Approx", disc)
    df = df.withColumns({
        "Is_Discounted_Approx": is_discounted("Discount_Pct_Approx"),
        "Cat_x_Weekend": F.col("category_encoded") * F.col("IsWeekend"),
        "PriceLag1_x_MonthSin": F.coalesce("Price_Lag_1", F.lit(0.0)) * F.col("_month_sin"),
        "QtyLag1_x_SellerState": F.coalesce("Qty_Lag_1", F.lit(0)) * F.col("seller_state_encoded"),
    }).drop("_month_sin")
    df = min_volume(df.na.drop(subset=required), min_total)
    return df.withColumns({c: round_places(c, n) for c, n in (rounded or {}).items() if c not in days.columns})
