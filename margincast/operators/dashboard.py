"""Dashboard reads over any cube (raw or post-feature).

All are aggregations (partial, map-side) or distributed top-k; the only
windows are per product.  ``grain="row"`` keeps the literal "last N rows"
reading, ``grain="week"`` reads "last N weeks".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from margincast.functions.dates import fmt_date
from margincast.functions.scalars import (PCT_EPS, pct_change, revenue, round_half_up, short_id,
                                          to_currency)
from margincast.operators.ordering import ordered_index
from margincast.operators.sales import CATEGORY

P, Q = "AverageSellingPrice", "QuantitySold"
ROW_ORDER = ["Date", "product_id", "seller_state_encoded"]


def product_summary(cube: DataFrame) -> DataFrame:
    """Units, mean weekly price and revenue = units × mean price."""
    return (cube.groupBy("product_id", CATEGORY)
            .agg(F.sum(Q).alias("total_units"), F.avg(P).alias("avg_price"))
            .withColumn("revenue", revenue("total_units", "avg_price")))


def money_report(df: DataFrame, cols: list[str], digits: int = 2) -> DataFrame:
    """X4 + X5: each money column rounded in BRL and converted to THB."""
    out = {}
    for c in cols:
        out[f"{c}_brl"] = round_half_up(c, digits)
        out[f"{c}_thb"] = round_half_up(to_currency(c), digits)
    return df.withColumns(out).drop(*cols)


def product_listing(cube: DataFrame, id_chars: int = 30) -> DataFrame:
    """Every product by revenue (reported cents; ties → lower product id): its
    ``position`` in the list, short id, category, total sales, mean price and
    revenue in both currencies.  Positions come from a distributed order."""
    rows = money_report(product_summary(cube).withColumnRenamed(CATEGORY, "category")
                        .withColumnRenamed("total_units", "total_sales")
                        .withColumn("product_id_short", short_id("product_id", id_chars)), ["avg_price", "revenue"])
    listed = ordered_index(rows.withColumn("_neg", -F.col("revenue_brl")), ["_neg", "product_id"], out="position")
    return listed.withColumn("position", (F.col("position") + 1).cast("long")).drop("_neg")


def top_products(cube: DataFrame, n: int = 10, id_chars: int = 20) -> DataFrame:
    """Top n products by revenue (ties → lower product id)."""
    top = product_summary(cube).orderBy(F.desc("revenue"), F.asc("product_id")).limit(n)
    return money_report(top.withColumn("product_id_short", short_id("product_id", id_chars))
                        .withColumnRenamed(CATEGORY, "category"),
                        ["avg_price", "revenue"])


def _last_rows(cube: DataFrame, n: int, grain: str) -> DataFrame:
    if grain == "row":
        return (cube.select(*ROW_ORDER, Q, P, F.col(Q) * F.col(P)).toDF(*ROW_ORDER, Q, P, "_rev")
                .orderBy(*[F.desc(c) for c in ROW_ORDER]).limit(n))
    weekly = cube.groupBy("Date").agg(F.sum(Q).alias(Q), F.avg(P).alias(P),
                                      F.sum(F.col(Q) * F.col(P)).alias("_rev"))
    return weekly.orderBy(F.desc("Date")).limit(n)


def recent_change(cube: DataFrame, n: int = 4, grain: str = "row") -> DataFrame:
    """% change of revenue and units, last n vs the n before; 0 when
    fewer than 2n rows (or weeks) exist."""
    last = _last_rows(cube, 2 * n, grain)
    order = ROW_ORDER if grain == "row" else ["Date"]
    # at most 2n rows here
    rk = last.withColumn("_rk", F.row_number().over(Window.orderBy(*[F.desc(c) for c in order])))
    recent = F.col("_rk") <= n
    agg = rk.agg(F.count(F.lit(1)).alias("_n"),
                 F.sum(F.when(recent, F.col("_rev"))).alias("rev_recent"),
                 F.sum(F.when(~recent, F.col("_rev"))).alias("rev_prev"),
                 F.sum(F.when(recent, F.col(Q))).alias("units_recent"),
                 F.sum(F.when(~recent, F.col(Q))).alias("units_prev"))
    full = F.col("_n") == 2 * n
    return agg.select(
        F.when(full, pct_change("rev_recent", "rev_prev")).otherwise(F.lit(0.0)).alias("revenue_change"),
        F.when(full, pct_change(F.col("units_recent").cast("double"), F.col("units_prev").cast("double")))
         .otherwise(F.lit(0.0)).alias("sales_change"))


def kpis(cube: DataFrame, grain: str = "row") -> DataFrame:
    """A8 (+A9): revenue Σ(units × price), distinct products, mean price,
    units, and the recent-vs-previous changes, as one row."""
    base = cube.agg(F.sum(F.col(Q) * F.col(P)).alias("total_revenue"),
                    F.countDistinct("product_id").alias("total_products"),
                    F.avg(P).alias("avg_price"),
                    F.sum(Q).alias("total_sales"))
    ch = recent_change(cube, 4, grain)
    # both sides are single rows; a keyless equi-join on a constant keeps it lazy
    return (money_report(base.withColumn("_k", F.lit(1)), ["total_revenue", "avg_price"])
            .join(ch.withColumn("_k", F.lit(1)), "_k").drop("_k")
            .withColumns({"revenue_change": round_half_up("revenue_change", 1),
                          "sales_change": round_half_up("sales_change", 1)}))


def sales_trend(cube: DataFrame, n: int = 12, grain: str = "row") -> DataFrame:
    """A10: last n rows (or weeks) → per date Σ units and mean price."""
    if grain == "row":
        last = _last_rows(cube, n, "row")
        per_date = last.groupBy("Date").agg(F.sum(Q).alias("sales"), F.avg(P).alias("price"))
    else:
        per_date = (cube.groupBy("Date").agg(F.sum(Q).alias("sales"), F.avg(P).alias("price"))
                    .orderBy(F.desc("Date")).limit(n))
    return (money_report(per_date, ["price"]).withColumn("week", fmt_date("Date"))
            .orderBy("Date").drop("Date"))


def product_analysis(cube: DataFrame) -> DataFrame:
    """Per-product statistics for every product at once.

    ``weeks_active`` is the row count (a product sold in two regions in one
    week counts twice), ``avg_weekly_sales`` the mean units per row."""
    first_key = F.struct("Date", "seller_state_encoded")
    agg = cube.groupBy("product_id").agg(
        F.min_by(CATEGORY, first_key).alias("category"),
        F.sum(Q).alias("total_sales"),
        F.avg(P).alias("avg_price"), F.min(P).alias("min_price"), F.max(P).alias("max_price"),
        F.sum(F.col(Q) * F.col(P)).alias("total_revenue"),
        F.count(F.lit(1)).alias("weeks_active"),
        F.avg(Q).alias("avg_weekly_sales"))
    return (money_report(agg, ["avg_price", "min_price", "max_price", "total_revenue"])
            .withColumn("avg_weekly_sales", round_half_up("avg_weekly_sales", 1))
            .withColumn("product_id_short", short_id("product_id", 30)))


def product_history(cube: DataFrame, n: int = 12) -> DataFrame:
    """Per product, the last n dates with Σ units and mean price."""
    per = cube.groupBy("product_id", "Date").agg(F.sum(Q).alias("sales"), F.avg(P).alias("price"))
    rk = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("Date")))
    last = per.withColumn("_rk", rk).where(F.col("_rk") <= n).drop("_rk")
    return money_report(last, ["price"]).withColumn("week", fmt_date("Date")).drop("Date")


def for_product(df: DataFrame, product_id, key: str = "product_id") -> DataFrame:
    """point lookup (pushed to the scan when df is a table)."""
    return df.where(F.col(key) == F.lit(product_id))


def target_info(train: DataFrame, targets: DataFrame) -> DataFrame:
    """Mean price, total units and last category of each target product."""
    last_key = F.struct("Date", "seller_state_encoded")
    return (train.join(targets.select("product_id"), "product_id", "left_semi")
            .groupBy("product_id")
            .agg(F.avg(P).alias("avg_price"), F.sum(Q).alias("total_units"),
                 F.max_by(CATEGORY, last_key).alias("category")))


def mean_features(train: DataFrame, cols: list[str]) -> DataFrame:
    """Column means as a fallback feature vector (one row)."""
    return train.agg(*[F.avg(c).alias(c) for c in cols])


def profit_total(results: DataFrame, by: str = "model", col: str = "max_profit") -> DataFrame:
    """Total expected profit per model."""
    return results.groupBy(by).agg(F.sum(col).alias("total_profit"),
                                   F.count(F.lit(1)).alias("products"))


__all__ = ["product_summary", "top_products", "recent_change", "kpis", "sales_trend",
           "product_analysis", "product_history", "for_product", "target_info",
           "mean_features", "profit_total", "PCT_EPS"]
