"""Adapter: the driver's TPC-H-style parquet tables → the five marketplace
sources the engine consumes (mapping fixed in FIXTURES.md §3).

The same mapping is written twice: as DataFrame code (what the engine runs)
and as SQL CTEs (what the DuckDB oracle runs), so both read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the driver tables' status code that plays "delivered".  The
# status column stays raw so the equality filter reaches the parquet scan.
DELIVERED = "F"

# Category translation rows used on the driver tables.
# STANDARD has no translation on purpose (exercises the null branch), and
# MEDIUM maps to the misspelt family name that must NOT match "fashion_".
TRANSLATION_ROWS = [
    ("ECONOMY", "fashion_shoes"),
    ("LARGE", "fashion_bags_accessories"),
    ("MEDIUM", "fashio_female_clothing"),
    ("PROMO", "health_beauty"),
    ("SMALL", "fashion_sport"),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_driver_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lazy DataFrames for orders, order_items, products, translation, sellers."""
    orders = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"))
    items = _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    products = _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("product_category_name"),
        F.col("p_size").cast("double").alias("product_weight_g"),
        F.col("p_retailprice").cast("double").alias("product_length_cm"),
        F.expr("cast(nullif(p_size % 10, 0) as double)").alias("product_height_cm"),
        F.expr("cast(p_size % 7 as double)").alias("product_width_cm"))
    translation = spark.createDataFrame(
        TRANSLATION_ROWS, "product_category_name string, product_category_name_english string")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sellers = (_read(spark, sf_dir, "supplier")
               .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"), "left")
               .select(F.col("s_suppkey").alias("seller_id"),
                       F.when(F.col("s_nationkey") % 8 == 0, F.lit(None).cast("string"))
                        .otherwise(F.col("n_name")).alias("seller_state")))
    return {"orders": orders, "order_items": items, "products": products,
            "translation": translation, "sellers": sellers}


_TRANSLATION_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in TRANSLATION_ROWS)

# The same five sources as DuckDB CTEs over the pre-registered driver views.
ORACLE_SOURCES_SQL = f"""
src_orders AS (
  SELECT o_orderkey AS order_id, o_orderstatus AS order_status,
         o_orderdate AS order_purchase_timestamp
  FROM orders),
src_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price
  FROM lineitem),
src_products AS (
  SELECT p_partkey AS product_id, p_type AS product_category_name,
         CAST(p_size AS DOUBLE) AS product_weight_g,
         CAST(p_retailprice AS DOUBLE) AS product_length_cm,
         CAST(nullif(p_size % 10, 0) AS DOUBLE) AS product_height_cm,
         CAST(p_size % 7 AS DOUBLE) AS product_width_cm
  FROM part),
src_translation(product_category_name, product_category_name_english) AS (
  VALUES {_TRANSLATION_VALUES}),
src_sellers AS (
  SELECT s_suppkey AS seller_id,
         CASE WHEN s_nationkey % 8 = 0 THEN NULL ELSE n_name END AS seller_state
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)"""


# ---- the same tables with demand that varies and falls with price ----
# A product is a part type and size class, so a week holds several units of it.
# Its unit price in a week falls as the week's lines exceed the product's mean:
# 1.4 of the base price without lines, 1.0 at the mean, 0.6 at twice the mean.
# Integers throughout, so both sides get the same cents.
_CODE = "(p_size % 4) * 100 + ascii(substr(p_type, 2, 1))"
_BASE_CENTS = "(2000 + (product_id % 13) * 300)"


def load_demand_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five sources over coarser products, with a planted demand curve."""
    src = load_driver_sources(spark, sf_dir)
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", F.expr(f"cast({_CODE} as bigint)").alias("product_id"))
    line = (_read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_partkey",
                                                    F.col("l_suppkey").alias("seller_id"))
            .join(part.select(F.col("p_partkey").alias("l_partkey"), "product_id"), "l_partkey")
            .join(src["orders"].select("order_id", F.date_trunc("week", "order_purchase_timestamp").alias("_week")), "order_id"))
    weekly = line.groupBy("product_id", "_week").agg(F.count(F.lit(1)).alias("_n"))
    mean = weekly.groupBy("product_id").agg(F.sum("_n").alias("_total"), F.count(F.lit(1)).alias("_weeks"))
    price = weekly.join(mean, "product_id").select("product_id", "_week", F.expr(
        f"{_BASE_CENTS} * (1400 - (4 * least(2000, (1000 * _n * _weeks) div _total)) div 10) div 1000").alias("_cents"))
    items = line.join(price, ["product_id", "_week"]).select(
        "order_id", "product_id", "seller_id", F.expr("cast(cast(_cents as decimal(18, 0)) / 100 as decimal(12, 2))").alias("price"))
    size = F.col("p_size") % 4
    products = part.select("product_id", F.col("p_type").alias("product_category_name"),
                           (size + 1).cast("double").alias("product_weight_g"), (size * 2 + 1).cast("double").alias("product_length_cm"),
                           F.expr("cast(nullif(p_size % 4, 0) as double)").alias("product_height_cm"),
                           F.lit(1.0).alias("product_width_cm")).distinct()
    sellers = src["sellers"].select("seller_id", F.lit("all").alias("seller_state"))
    return src | {"order_items": items, "products": products, "sellers": sellers}


ORACLE_DEMAND_SQL = f"""
src_orders AS (
  SELECT o_orderkey AS order_id, o_orderstatus AS order_status,
         o_orderdate AS order_purchase_timestamp
  FROM orders),
demand_part AS (SELECT p_partkey, p_type, p_size % 4 AS s, CAST({_CODE} AS BIGINT) AS product_id FROM part),
demand_line AS (
  SELECT l_orderkey AS order_id, product_id, l_suppkey AS seller_id, date_trunc('week', o_orderdate) AS week
  FROM lineitem JOIN demand_part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
demand_week AS (SELECT product_id, week, count(*) AS n FROM demand_line GROUP BY 1, 2),
demand_mean AS (SELECT product_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS weeks FROM demand_week GROUP BY 1),
demand_price AS (
  SELECT product_id, week, {_BASE_CENTS} * (1400 - (4 * least(2000, (1000 * n * weeks) // total)) // 10) // 1000 AS cents
  FROM demand_week JOIN demand_mean USING (product_id)),
src_items AS (
  SELECT order_id, product_id, seller_id, CAST(CAST(cents AS DECIMAL(18, 2)) / 100 AS DECIMAL(12, 2)) AS price
  FROM demand_line JOIN demand_price USING (product_id, week)),
src_products AS (
  SELECT DISTINCT product_id, p_type AS product_category_name, CAST(s + 1 AS DOUBLE) AS product_weight_g,
         CAST(s * 2 + 1 AS DOUBLE) AS product_length_cm, CAST(nullif(s, 0) AS DOUBLE) AS product_height_cm,
         CAST(1 AS DOUBLE) AS product_width_cm
  FROM demand_part),
src_translation(product_category_name, product_category_name_english) AS (
  VALUES {{_TRANSLATION_VALUES}}),
src_sellers AS (SELECT s_suppkey AS seller_id, 'all' AS seller_state FROM supplier)""".replace("{_TRANSLATION_VALUES}", _TRANSLATION_VALUES)
