"""Shared pieces of the registered queries: Spark builders and the matching
DuckDB CTE text over the same driver tables."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from margincast.functions.holidays import BASE_HOLIDAYS
from margincast.operators.cube import weekly_cube, weekly_cube_from_sources
from margincast.operators.sales import sales_lines
from margincast.sources.driver_tables import (DELIVERED, ORACLE_DEMAND_SQL, ORACLE_SOURCES_SQL, load_demand_sources,
                                              load_driver_sources)


# ----------------------------------------------------------------- Spark side
_LOAD = [load_driver_sources]


@contextmanager
def demand_sources():
    """Within, queries are built over the tables with varying, planted demand."""
    _LOAD.append(load_demand_sources)
    try:
        yield
    finally:
        _LOAD.pop()


def sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return _LOAD[-1](spark, d)


def lines(spark: SparkSession, d: str, family: bool = True) -> DataFrame:
    return sales_lines(sources(spark, d), status=DELIVERED, prefix="fashion_" if family else None)


def cube(spark: SparkSession, d: str, family: bool = True) -> DataFrame:
    # pre-aggregated build: one line-level shuffle (equal to weekly_cube(lines))
    return weekly_cube_from_sources(sources(spark, d), DELIVERED, "fashion_" if family else None)


def out(df: DataFrame) -> DataFrame:
    """Report form: dates as yyyy-MM-dd text, timestamps as text."""
    conv = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            conv[f.name] = F.date_format(f.name, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            conv[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(conv) if conv else df


def r6(*cols: str):
    return {c: F.round(c, 6) for c in cols}


def rm(expr: str, d: int = 2) -> str:
    """SQL twin of ``scalars.round_half_up``: HALF_UP on the decimal value."""
    return f"CAST(round(CAST(({expr}) AS DECIMAL(38,9)), {d}) AS DOUBLE)"


# ----------------------------------------------------------------- SQL side
def with_(*blocks: str) -> str:
    return "WITH " + ",\n".join(b.strip() for b in blocks)


SRC = ORACLE_SOURCES_SQL.strip()
DEMAND_SRC = ORACLE_DEMAND_SQL.strip()


def lines_sql(name: str = "lines", family: bool = True) -> str:
    fam = "WHERE starts_with(lower(t.product_category_name_english), 'fashion_')" if family else ""
    return f"""
{name}_products AS (
  SELECT p.product_id, t.product_category_name_english, p.product_weight_g,
         p.product_length_cm, p.product_height_cm, p.product_width_cm
  FROM src_products p LEFT JOIN src_translation t
    ON p.product_category_name = t.product_category_name
  {fam}),
{name} AS (
  SELECT o.order_purchase_timestamp, i.product_id, p.product_category_name_english,
         coalesce(s.seller_state, 'Unknown') AS seller_state, i.price, 1 AS quantity,
         p.product_weight_g, p.product_length_cm, p.product_height_cm, p.product_width_cm
  FROM src_items i
  JOIN {name}_products p ON i.product_id = p.product_id
  JOIN src_orders o ON i.order_id = o.order_id
  LEFT JOIN src_sellers s ON i.seller_id = s.seller_id
  WHERE o.order_status = 'F' AND p.product_category_name_english IS NOT NULL
    AND o.order_purchase_timestamp IS NOT NULL)"""


def _mean(c: str, scale: int = 4) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(30,{scale}))) AS DOUBLE) / nullif(count({c}), 0)"


WEEK_SQL = "CAST(date_trunc('week', CAST({c} AS DATE) + 6) AS DATE)"


def cube_sql(src: str = "lines", name: str = "cube") -> str:
    wk = WEEK_SQL.format(c="order_purchase_timestamp")
    return f"""
{name}_raw AS (
  SELECT product_id, product_category_name_english, seller_state, {wk} AS Date,
         CAST(count(*) AS BIGINT) AS QuantitySold,
         {_mean('price', 2)} AS AverageSellingPrice,
         {_mean('product_weight_g')} AS Weight_g_Mean,
         {_mean('product_length_cm')} AS Length_cm_Mean,
         {_mean('product_height_cm')} AS Height_cm_Mean,
         {_mean('product_width_cm')} AS Width_cm_Mean
  FROM {src} GROUP BY 1, 2, 3, 4),
{name}_states AS (
  SELECT seller_state, CAST(dense_rank() OVER (ORDER BY seller_state) - 1 AS INTEGER) AS seller_state_encoded
  FROM (SELECT DISTINCT seller_state FROM {name}_raw)),
{name} AS (
  SELECT product_id, product_category_name_english, seller_state_encoded, Date, QuantitySold,
         AverageSellingPrice, Weight_g_Mean, Length_cm_Mean, Height_cm_Mean, Width_cm_Mean
  FROM {name}_raw JOIN {name}_states USING (seller_state))"""


CUBE_CTES = [SRC, lines_sql(), cube_sql()]
ALL_CUBE_CTES = [SRC, lines_sql("lines_all", family=False), cube_sql("lines_all", "cube_all")]


def holidays_sql(src: str, name: str = "hol", extra_good_friday: bool = True) -> str:
    """Holiday dates for the year span of ``src``.Date (same rules as H6)."""
    fixed = []
    for m, d, nm, since in BASE_HOLIDAYS:
        cond = f"WHERE y >= {since}" if since else ""
        fixed.append(f"SELECT make_date(y, {m}, {d}) AS holiday_date FROM {name}_years {cond}")
    easter = """SELECT make_date(y, CAST((h + l - 7 * m + 114) // 31 AS INTEGER),
                      CAST((h + l - 7 * m + 114) % 31 + 1 AS INTEGER)) - 2 AS holiday_date
  FROM (SELECT y, h, l, (a + 11 * h + 22 * l) // 451 AS m FROM (
    SELECT y, a, h, (32 + 2 * e + 2 * i - h - k) % 7 AS l FROM (
      SELECT y, a, e, i, k, (19 * a + b - d - g + 15) % 30 AS h FROM (
        SELECT y, y % 19 AS a, y // 100 AS b, (y // 100) // 4 AS d, (y // 100) % 4 AS e,
               ((y // 100) - ((y // 100) + 8) // 25 + 1) // 3 AS g,
               (y % 100) // 4 AS i, (y % 100) % 4 AS k
        FROM {name}_years))))""".replace("{name}", name)
    return f"""
{name}_years AS (
  SELECT CAST(range AS INTEGER) AS y FROM range(
    (SELECT min(year(Date)) FROM {src}), (SELECT max(year(Date)) FROM {src}) + 1)),
{name} AS (
  SELECT DISTINCT holiday_date FROM (
  {' UNION ALL '.join(fixed)} UNION ALL {easter}))"""
