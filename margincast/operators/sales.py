"""From the five sources to one row per sold unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margincast.functions.scalars import has_prefix

CATEGORY = "product_category_name_english"
DIM_COLS = ["product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]
# above this many translation rows the table is joined, not broadcast, and
# the family filter is not resolved on the driver
TRANSLATION_MAX = 100_000


def delivered(orders: DataFrame, status: str = "delivered") -> DataFrame:
    """F1."""
    return orders.where(F.col("order_status") == status)


def with_purchase_ts(df: DataFrame, col: str = "order_purchase_timestamp") -> DataFrame:
    """text timestamps become timestamp_ntz; with ANSI on, bad text raises."""
    if dict(df.dtypes)[col] == "string":
        return df.withColumn(col, F.to_timestamp_ntz(F.col(col)))
    return df


def category_family(df: DataFrame, prefix: str = "fashion_", col: str = CATEGORY) -> DataFrame:
    """keep rows whose category starts with ``prefix`` (case-insensitive);
    a null category is dropped."""
    return df.where(has_prefix(col, prefix))


def require(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a null in any listed column."""
    return df.na.drop(subset=cols)


def complete_rows(df: DataFrame) -> DataFrame:
    """F8: drop rows with any null."""
    return df.na.drop(how="any")


def fill(df: DataFrame, values: dict) -> DataFrame:
    """literal replacement of nulls per column."""
    return df.na.fill(values)


def zero_fill(df: DataFrame) -> DataFrame:
    """every remaining numeric null becomes 0."""
    return df.na.fill(0)


def assert_nonempty(df: DataFrame, what: str) -> DataFrame:
    """fail fast on an empty input (one-row probe, not a count)."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def products_with_category(products: DataFrame, translation: DataFrame,
                           prefix: str | None = "fashion_") -> DataFrame:
    """J2 + J3 + F3 on the product dimension *before* it meets the order
    lines, so the family filter shrinks the dimension, not the fact table."""
    t = translation.select("product_category_name", CATEGORY)
    small = t.limit(TRANSLATION_MAX + 1).count() <= TRANSLATION_MAX
    if small:
        t = F.broadcast(t)
    if prefix and small:
        # resolve the family to source category names on the (proven small)
        # translation table so the products scan gets a pushable IN filter
        names = [r[0] for r in category_family(t, prefix).select("product_category_name")
                 .where(F.col("product_category_name").isNotNull()).distinct().collect()]
        products = products.where(F.col("product_category_name").isin(names))
    dim = products.join(t, "product_category_name", "left")
    return category_family(dim, prefix) if prefix else dim


def sales_lines(src: dict[str, DataFrame], status: str = "delivered",
                prefix: str | None = "fashion_") -> DataFrame:
    """One row per sold unit with product, category, region and timestamp.

    Join order is chosen for scale: items ⋈ family products (the filtered
    dimension cuts the fact table first; a hot product is split by AQE skew
    handling because the next join re-shuffles anyway), ⋈ delivered orders,
    ⋈ seller region.  Left joins followed by a filter on the right side are
    written as inner joins on the pre-filtered dimension (same rows).
    """
    orders = with_purchase_ts(delivered(src["orders"], status)).select(
        "order_id", "order_purchase_timestamp")
    items = src["order_items"].select("order_id", "product_id", "seller_id", "price")
    prods = products_with_category(src["products"], src["translation"], prefix).select(
        "product_id", CATEGORY, *DIM_COLS)
    sellers = src["sellers"].select("seller_id", "seller_state")
    joined = (items.join(prods, "product_id", "inner" if prefix else "left")   # J2/J3 (+F3)
              .join(orders, "order_id", "inner")                              # J1
              .join(sellers, "seller_id", "left"))                            # J4
    return (require(joined, [CATEGORY])                                        # F4
            .withColumn("seller_state", F.coalesce("seller_state", F.lit("Unknown")))  # F7
            .withColumn("quantity", F.lit(1))                                  # F6
            .select("order_purchase_timestamp", "product_id", CATEGORY, "seller_state",
                    "price", "quantity", *DIM_COLS))                            # F5
