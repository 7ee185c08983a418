"""Per-product window operators.

Every window is partitioned by product and ordered by the explicit total
order (Date, region code); rows per product are bounded by weeks × regions,
so no window partition can grow with the fact table.  Specs are shared so
Catalyst evaluates them in a single Window operator over one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

ORDER = ["Date", "seller_state_encoded"]


def by_product(order: list[str] | None = None, key: str = "product_id") -> WindowSpec:
    return Window.partitionBy(key).orderBy(*(order or ORDER))


def lag(col: str, k: int, w: WindowSpec | None = None) -> Column:
    """W1."""
    return F.lag(col, k).over(w or by_product())


def rolling(col: str, n: int, how: str = "mean", include_current: bool = True,
            w: WindowSpec | None = None) -> Column:
    """Mean / std / max over the last n rows (min 1 observation).

    ``include_current`` → rows [−(n−1), 0]; otherwise the n rows before the
    current one, [−n, −1] (a shift-by-one rolling window)."""
    w = w or by_product()
    frame = w.rowsBetween(-(n - 1), 0) if include_current else w.rowsBetween(-n, -1)
    fn = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum}[how]
    return fn(col).over(frame)


def diff(col: str, w: WindowSpec | None = None) -> Column:
    """First difference."""
    return F.col(col) - F.lag(col, 1).over(w or by_product())


def ffill(col: str, w: WindowSpec | None = None) -> Column:
    """Last non-null value at or before the row, within the product."""
    return F.last(col, ignorenulls=True).over(
        (w or by_product()).rowsBetween(Window.unboundedPreceding, 0))


def bfill(col: str, order: list[str] | None = None,
          key: str = "product_id") -> Column:
    """W8 (product scope): first non-null value at or after the row.

    Evaluated as a forward fill over the reversed order: a running frame
    (unbounded preceding .. current) is updated incrementally, whereas a
    (current .. unbounded following) frame is re-aggregated for every row,
    quadratic in the rows per product.  The reversed spec is built from
    ``order``."""
    order = order or ORDER
    rev = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return F.last(col, ignorenulls=True).over(rev.rowsBetween(Window.unboundedPreceding, 0))


def fill_within_product(df: DataFrame, cols: list[str], order: list[str] | None = None,
                        default: dict | None = None, scope: str = "product",
                        key: str = "product_id") -> DataFrame:
    """W7 then W8, then a literal default for what is left.

    ``scope="product"`` fills only from the same product.  ``scope="global"``
    reproduces a backward fill over the whole (product, order) sequence: a
    product with no value at all takes the first value of the next product
    that has one (per-product first values → distributed next-non-null)."""
    w = by_product(order, key)
    out = df.withColumns({c: F.coalesce(ffill(c, w), bfill(c, order=order, key=key)) for c in cols})
    if scope == "global":
        from margincast.operators.ordering import next_non_null
        order = order or ORDER
        firsts = df.groupBy(key).agg(*[
            F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in cols])
        for c in cols:
            nxt = next_non_null(firsts.select(key, c), key, c, f"_next_{c}")
            out = (out.join(nxt.select(key, f"_next_{c}"), key, "left")
                   .withColumn(c, F.coalesce(c, f"_next_{c}")).drop(f"_next_{c}"))
    elif scope != "product":
        raise ValueError(scope)
    return out.na.fill(default) if default else out


def fill_sequence(df: DataFrame, cols: list[str], order: list[str], default: dict | None = None,
                  key: str = "product_id") -> DataFrame:
    """W7 + W8 over the rows as one sequence (key, *order): forward fill within
    the key, then a backward fill that runs on across keys, then a default.
    ``order`` may be any columns that make the sequence total."""
    from margincast.operators.ordering import global_backfill
    w = by_product(order, key)
    out = global_backfill(df.withColumns({c: ffill(c, w) for c in cols}), [key, *order], cols)
    return out.na.fill(default) if default else out


def latest_rows(df: DataFrame, order: list[str] | None = None, key: str = "product_id") -> DataFrame:
    """The last row of each product in the total order.

    A grouped ``max_by`` over a struct of all columns: partial aggregation
    keeps hot products from landing in one task."""
    order = order or ORDER
    others = [c for c in df.columns if c != key]
    agg = df.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return agg.select(key, "_r.*")


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """Last n rows of an ordered table (distributed top-k)."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
