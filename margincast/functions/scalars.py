"""Scalar column expressions (math, text, conditional)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values used by the reports.
BRL_TO_THB = 6.8          # currency conversion rate
PCT_EPS = 1e-6            # guard added to every denominator of a % change
DISCOUNT_FLAG = 0.05      # "discounted" when price sits 5 % under its rolling mean


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cyclical(x, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2π·x/period."""
    ang = F.lit(2 * math.pi) * _c(x).cast("double") / F.lit(float(period))
    return F.sin(ang), F.cos(ang)


def discount_pct(roll_mean, price) -> Column:
    """Approximate discount versus the rolling mean price."""
    return (_c(roll_mean) - _c(price)) / (_c(roll_mean) + F.lit(PCT_EPS))


def is_discounted(pct) -> Column:
    # a missing rolling mean compares false, i.e. not discounted
    return F.when(_c(pct) > F.lit(DISCOUNT_FLAG), F.lit(1)).otherwise(F.lit(0))


def to_currency(x, rate: float = BRL_TO_THB) -> Column:
    """Money in another currency at a fixed rate."""
    return _c(x) * F.lit(rate)


def round_half_up(x, d: int = 2) -> Column:
    """Round half up on the value's decimal form (through an exact
    decimal), so a half-cent mean rounds the same on every engine."""
    return F.round(_c(x).cast("decimal(38,9)"), d).cast("double")


def round_places(x, d: int = 6) -> Column:
    """``round(x, d)`` of a double, value for value, without a decimal a row.

    ``F.round`` takes a double through its shortest decimal form.  Where the
    scaled value is not near a tie its nearest whole number is the same one, and
    dividing it by the power of ten gives the double nearest to that decimal.
    Ties, large values and values that are not finite go through ``F.round``.
    Never gives a negative zero."""
    x = _c(x).cast("double")
    scaled = x * F.lit(10.0 ** d)
    # below 1e12 the scaled value is within 1e-3 of the exact one
    clear = (F.abs(scaled) < F.lit(1e12)) & (F.abs(scaled - F.rint(scaled)) < F.lit(0.499))
    return F.when(clear, F.rint(scaled) / F.lit(10.0 ** d)).otherwise(F.round(x, d)) + F.lit(0.0)


def as_units(pred) -> Column:
    """Demand as a whole number of units: round half to even, floor at 0."""
    return F.greatest(F.lit(0.0), F.rint(_c(pred)))


def pct_change(new, old) -> Column:
    """(new / (old + ε) − 1) · 100."""
    return (_c(new) / (_c(old) + F.lit(PCT_EPS)) - F.lit(1.0)) * F.lit(100.0)


def revenue(units, price) -> Column:
    """X8."""
    return _c(units) * _c(price)


def log_target(y) -> Column:
    """X9."""
    return F.log1p(_c(y))


def from_log_target(y) -> Column:
    return F.expm1(_c(y))


def linspace(lo, hi, n: int) -> Column:
    """Array of n evenly spaced values from lo to hi inclusive
    (lo + i·step with step = (hi − lo)/(n − 1), the last one exactly hi)."""
    lo, hi = _c(lo), _c(hi)
    if n == 1:
        return F.array(lo)
    step = (hi - lo) / F.lit(float(n - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: F.when(i == n - 1, hi).otherwise(i.cast("double") * step + lo))


def short_id(x, n: int = 30) -> Column:
    """X11: first n characters followed by an ellipsis."""
    return F.concat(F.substring(_c(x).cast("string"), 1, n), F.lit("..."))


def has_prefix(x, prefix: str) -> Column:
    """Case-insensitive prefix test; null is false inside filter."""
    return F.lower(_c(x)).startswith(prefix.lower())


# Recommendation texts of the price report, in band order
# (> +15 %, > +5 %, < −15 %, < −5 %, otherwise); %s is the 1-decimal change.
RECOMMENDATION_TEXT = [
    "แนะนำขึ้นราคา %s% (ทำทีละน้อย 5-10% ก่อน)",
    "แนะนำขึ้นราคาเล็กน้อย %s%",
    "แนะนำลดราคา %s% (ทำโปรโมชั่น)",
    "แนะนำลดราคาเล็กน้อย %s%",
    "ราคาปัจจุบันเหมาะสมแล้ว คงราคาไว้",
]


def recommendation(optimal_price, current_price) -> Column:
    """Five-band price advice from the % change of optimal vs current."""
    ch = pct_change(optimal_price, current_price)
    mag = F.format_string("%.1f", F.abs(ch))
    up = F.format_string("%.1f", ch)

    def txt(i, num):
        head, _, tail = RECOMMENDATION_TEXT[i].partition("%s")
        return F.concat(F.lit(head), num, F.lit(tail))
    return (F.when(ch > 15, txt(0, up))
            .when(ch > 5, txt(1, up))
            .when(ch < -15, txt(2, mag))
            .when(ch < -5, txt(3, mag))
            .otherwise(F.lit(RECOMMENDATION_TEXT[4])))


def r2_verdict(r2) -> Column:
    """Quality band of the test R²."""
    r2 = _c(r2)
    return (F.when(r2 > 0.8, "excellent").when(r2 > 0.7, "good")
            .when(r2 > 0.6, "fair").otherwise("poor"))


def overfit_verdict(train_r2, test_r2) -> Column:
    gap = _c(train_r2) - _c(test_r2)
    return F.when(gap < 0.1, "none").when(gap < 0.2, "slight").otherwise("significant")


def mape_verdict(mape) -> Column:
    m = _c(mape)
    return F.when(m.isNull(), F.lit(None).cast("string")).when(m < 20, "good").otherwise("improve")
