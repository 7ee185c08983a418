"""Registered queries: one per operator row of the inventory.

Each entry is ``name -> (builder(spark, sf_dir) -> DataFrame, oracle SQL or
None)``.  Builders only compose library functions over the driver tables;
the SQL re-derives the same answer independently in DuckDB.  Every query
runs over whole tables: no id subsets, no row caps beyond top-k features.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from margincast.sources.driver_tables import DELIVERED
from margincast.plans.common import (ALL_CUBE_CTES, CUBE_CTES, DEMAND_SRC, SRC, demand_sources, WEEK_SQL, cube, holidays_sql,
                                     lines, lines_sql, out, r6, rm, sources, with_)
from margincast.operators import cube as C
from margincast.operators import dashboard as D
from margincast.operators import sales as S
from margincast.operators.joins import keep_products
from margincast.operators.pricing import PRODUCT_COSTS
from margincast.operators.sales import CATEGORY

REGISTRY: dict = {}


def q(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


CAT = CATEGORY

# =========================================================== S: sources / sinks

_SRC_COUNTS_SQL = with_(SRC) + """
SELECT 'orders' AS source, CAST(count(*) AS BIGINT) AS rows FROM src_orders
UNION ALL SELECT 'order_items', count(*) FROM src_items
UNION ALL SELECT 'products', count(*) FROM src_products
UNION ALL SELECT 'translation', count(*) FROM src_translation
UNION ALL SELECT 'sellers', count(*) FROM src_sellers"""


@q("s1_read_sources", _SRC_COUNTS_SQL)
def s1_read_sources(spark, d):
    src = sources(spark, d)
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("source"), "rows")
             for n, df in src.items()]
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res


def _csv_copy(spark, d):
    """The given tables as the five CSV files: byte-order marks, quoted line
    breaks and quotes inside values, and one order line whose number is no number."""
    import uuid
    from margincast.session import ensure_checkpoint_dir
    from margincast.sources.tables import write_sources_csv
    src = dict(sources(spark, d))
    noted = F.concat(F.lit('note "'), F.col("order_id").cast("string"), F.lit('",\nsecond line'))
    src["orders"] = src["orders"].withColumn("customer_id", noted)
    items = src["order_items"].withColumn("order_item_id", F.lit(1).cast("string"))
    one = items.agg(*[F.min(F.col(c).cast("string")).alias(c) for c in items.columns if c != "order_item_id"])
    src["order_items"] = items.select(*[F.col(c).cast("string").alias(c) for c in items.columns]).unionByName(
        one.withColumn("order_item_id", F.lit("first")))
    path = f"{ensure_checkpoint_dir(spark)}/csv/{uuid.uuid4().hex}"
    write_sources_csv(src, path, bom=True)
    return path


@q("s1_csv_ingest", with_(SRC) + """
SELECT 'orders' AS source, CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS bad_rows,
       CAST(sum(length('note "' || order_id || '",' || chr(10) || 'second line')) AS BIGINT) AS checksum FROM src_orders
UNION ALL SELECT 'order_items', count(*), 1, CAST(sum(CAST(price * 100 AS BIGINT)) AS BIGINT) FROM src_items
UNION ALL SELECT 'products', count(*), 0, CAST(sum(product_weight_g) AS BIGINT) FROM src_products
UNION ALL SELECT 'translation', count(*), 0, CAST(sum(length(product_category_name_english)) AS BIGINT) FROM src_translation
UNION ALL SELECT 'sellers', count(*), 0, CAST(sum(length(seller_state)) AS BIGINT) FROM src_sellers""")
def s1_csv_ingest(spark, d):
    from margincast.sources.tables import read_sources_checked
    src, bad = read_sources_checked(spark, _csv_copy(spark, d))
    sums = {"orders": F.sum(F.length("customer_id")), "order_items": F.sum(F.round(F.col("price") * 100).cast("long")),
            "products": F.sum("product_weight_g").cast("long"), "translation": F.sum(F.length("product_category_name_english")),
            "sellers": F.sum(F.length("seller_state"))}
    read = None
    for name, df in src.items():
        one = df.agg(F.count(F.lit(1)).alias("rows"), sums[name].alias("checksum")).withColumn("source", F.lit(name))
        read = one if read is None else read.unionByName(one)
    bad = bad.groupBy("source").agg(F.count(F.lit(1)).alias("bad_rows"))
    return read.join(bad, "source", "left").select("source", "rows", F.coalesce("bad_rows", F.lit(0)).alias("bad_rows"), "checksum")


@q("s1c_csv_cube", with_(*CUBE_CTES) + """
SELECT CAST(product_id AS VARCHAR) AS product_id, product_category_name_english, seller_state_encoded,
       strftime(Date, '%Y-%m-%d') AS Date, QuantitySold, AverageSellingPrice, Weight_g_Mean,
       Length_cm_Mean, Height_cm_Mean, Width_cm_Mean FROM cube""")
def s1c_csv_cube(spark, d):
    """The weekly cube straight from CSV files."""
    from margincast.sources.tables import read_sources_checked
    src, _ = read_sources_checked(spark, _csv_copy(spark, d))
    return out(C.weekly_cube_from_sources(src, DELIVERED, "fashion_"))


@q("s2_check_sources")
def s2_check_sources(spark, d):
    from margincast.sources.tables import check_sources
    need = ["orders.parquet", "lineitem.parquet", "part.parquet", "supplier.parquet",
            "nation.parquet", "sellers.csv"]
    return check_sources(spark, d, need)


@q("s4_write_result", with_(*CUBE_CTES) + """
SELECT product_id, product_category_name_english, seller_state_encoded,
       strftime(Date, '%Y-%m-%d') AS Date, QuantitySold, AverageSellingPrice, Weight_g_Mean,
       Length_cm_Mean, Height_cm_Mean, Width_cm_Mean FROM cube""")
def s4_write_result(spark, d):
    from margincast.session import ensure_checkpoint_dir
    from margincast.sources.tables import write_result
    import uuid
    base = ensure_checkpoint_dir(spark)
    path = f"{base}/results/cube-{uuid.uuid4().hex}"
    write_result(cube(spark, d).withColumn("year", F.year("Date")), path, partition_by=["year"])
    return out(spark.read.parquet(path).drop("year"))


# =========================================================== F: filters

@q("f1_delivered", with_(SRC) + """
SELECT order_id, strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp
FROM src_orders WHERE order_status = 'F'""")
def f1_delivered(spark, d):
    return out(S.delivered(sources(spark, d)["orders"], DELIVERED).select("order_id", "order_purchase_timestamp"))


@q("f2_purchase_ts", with_(SRC) + """
SELECT order_id, strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp,
       CAST(month(order_purchase_timestamp) AS INTEGER) AS month
FROM src_orders WHERE order_status = 'F'""")
def f2_purchase_ts(spark, d):
    o = S.delivered(sources(spark, d)["orders"], DELIVERED)
    text = o.select("order_id", F.date_format("order_purchase_timestamp", "yyyy-MM-dd HH:mm:ss")
                    .alias("order_purchase_timestamp"))
    parsed = S.with_purchase_ts(text)          # string → timestamp_ntz (ANSI: malformed raises)
    return out(parsed.withColumn("month", F.month("order_purchase_timestamp")))


@q("f3_category_family", with_(SRC, lines_sql()) + """
SELECT product_id, product_category_name_english FROM lines_products""")
def f3_category_family(spark, d):
    src = sources(spark, d)
    return S.products_with_category(src["products"], src["translation"]).select("product_id", CAT)


@q("f4_require_category", with_(SRC, lines_sql("lines_all", family=False)) + """
SELECT product_category_name_english, CAST(count(*) AS BIGINT) AS rows FROM lines_all GROUP BY 1""")
def f4_require_category(spark, d):
    return C.category_counts(lines(spark, d, family=False))


@q("f5_sales_lines", with_(SRC, lines_sql()) + """
SELECT strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp, product_id,
       product_category_name_english, seller_state, CAST(price AS DOUBLE) AS price,
       CAST(quantity AS INTEGER) AS quantity, product_weight_g, product_length_cm,
       product_height_cm, product_width_cm FROM lines""")
def f5_sales_lines(spark, d):
    return out(lines(spark, d).withColumn("price", F.col("price").cast("double")))


@q("f6_unit_quantity", with_(SRC, lines_sql()) + """
SELECT CAST(sum(quantity) AS BIGINT) AS units, CAST(count(*) AS BIGINT) AS rows FROM lines""")
def f6_unit_quantity(spark, d):
    return lines(spark, d).agg(F.sum("quantity").cast("long").alias("units"),
                               F.count(F.lit(1)).alias("rows"))


@q("f7_fill_unknown_region", with_(SRC, lines_sql()) + """
SELECT seller_state, CAST(count(*) AS BIGINT) AS rows FROM lines GROUP BY 1""")
def f7_fill_unknown_region(spark, d):
    return lines(spark, d).groupBy("seller_state").agg(F.count(F.lit(1)).alias("rows"))


@q("f11_product_lookup", with_(*CUBE_CTES) + """,
top AS (SELECT product_id FROM cube GROUP BY 1 ORDER BY sum(QuantitySold) DESC, product_id LIMIT 1)
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date, QuantitySold, AverageSellingPrice
FROM cube WHERE product_id = (SELECT product_id FROM top)""")
def f11_product_lookup(spark, d):
    cb = cube(spark, d)
    top = C.top_n_products(cb, 1).first()["product_id"]
    return out(D.for_product(cb, top).select("product_id", "seller_state_encoded", "Date",
                                             "QuantitySold", "AverageSellingPrice"))


def _stored_cube(spark, d):
    import uuid
    from margincast.session import ensure_checkpoint_dir
    from margincast.sources.cube_table import store_cube
    name = f"cube_{uuid.uuid4().hex}"
    store_cube(cube(spark, d), name, f"{ensure_checkpoint_dir(spark)}/tables/{name}")
    return name


@q("f11t_stored_product_rows", with_(*CUBE_CTES) + """
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date, QuantitySold, AverageSellingPrice
FROM cube WHERE product_id = (SELECT min(product_id) FROM cube)""")
def f11t_stored_product_rows(spark, d):
    from margincast.sources.cube_table import product_rows
    name = _stored_cube(spark, d)
    pid = spark.table(name).agg(F.min("product_id")).first()[0]
    return out(product_rows(spark, name, pid).select("product_id", "seller_state_encoded", "Date", "QuantitySold",
                                                     "AverageSellingPrice"))


@q("f12t_stored_last_weeks", with_(*CUBE_CTES) + """
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date, QuantitySold
FROM cube WHERE Date >= (SELECT max(Date) - 21 FROM cube)""")
def f12t_stored_last_weeks(spark, d):
    from margincast.sources.cube_table import between_weeks
    import datetime as dt
    name = _stored_cube(spark, d)
    last = spark.table(name).agg(F.max("Date")).first()[0]
    return out(between_weeks(spark, name, last - dt.timedelta(days=21), last)
               .select("product_id", "seller_state_encoded", "Date", "QuantitySold"))


@q("f14_drop_column", with_(*CUBE_CTES) + """
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date, QuantitySold FROM cube""")
def f14_drop_column(spark, d):
    return out(cube(spark, d).drop(CAT, "AverageSellingPrice", "Weight_g_Mean", "Length_cm_Mean",
                                   "Height_cm_Mean", "Width_cm_Mean"))


@q("f15_nonempty_guard", with_(*CUBE_CTES) + """
SELECT CAST(count(*) AS BIGINT) AS rows FROM cube""")
def f15_nonempty_guard(spark, d):
    cb = S.assert_nonempty(cube(spark, d), "weekly cube")
    return cb.agg(F.count(F.lit(1)).alias("rows"))


# =========================================================== J: joins

@q("j1_orders_items", with_(SRC) + """
SELECT i.order_id, i.product_id, i.seller_id, CAST(i.price AS DOUBLE) AS price
FROM src_items i JOIN src_orders o ON i.order_id = o.order_id WHERE o.order_status = 'F'""")
def j1_orders_items(spark, d):
    src = sources(spark, d)
    o = S.delivered(src["orders"], DELIVERED).select("order_id")
    return (src["order_items"].join(o, "order_id")
            .select("order_id", "product_id", "seller_id", F.col("price").cast("double")))


@q("j2_items_products", with_(SRC) + """
SELECT p.product_category_name, CAST(count(*) AS BIGINT) AS rows,
       CAST(count(p.product_id) AS BIGINT) AS matched
FROM src_items i LEFT JOIN src_products p ON i.product_id = p.product_id GROUP BY 1""")
def j2_items_products(spark, d):
    src = sources(spark, d)
    j = src["order_items"].join(src["products"], "product_id", "left")
    return j.groupBy("product_category_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count("product_weight_g").alias("matched"))


@q("j3_translation", with_(SRC) + """
SELECT p.product_id, p.product_category_name, t.product_category_name_english
FROM src_products p LEFT JOIN src_translation t ON p.product_category_name = t.product_category_name""")
def j3_translation(spark, d):
    src = sources(spark, d)
    return S.products_with_category(src["products"], src["translation"], prefix=None).select(
        "product_id", "product_category_name", CAT)


@q("j4_seller_region", with_(SRC) + """
SELECT i.seller_id, coalesce(s.seller_state, 'Unknown') AS seller_state, CAST(count(*) AS BIGINT) AS rows
FROM src_items i LEFT JOIN src_sellers s ON i.seller_id = s.seller_id GROUP BY 1, 2""")
def j4_seller_region(spark, d):
    src = sources(spark, d)
    j = src["order_items"].join(src["sellers"], "seller_id", "left")
    return (j.withColumn("seller_state", F.coalesce("seller_state", F.lit("Unknown")))
            .groupBy("seller_id", "seller_state").agg(F.count(F.lit(1)).alias("rows")))


@q("j5_keep_products", with_(*CUBE_CTES) + """,
top AS (SELECT product_id FROM cube GROUP BY 1 ORDER BY sum(QuantitySold) DESC, product_id LIMIT 10)
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date, QuantitySold
FROM cube WHERE product_id IN (SELECT product_id FROM top)""")
def j5_keep_products(spark, d):
    cb = cube(spark, d)
    return out(keep_products(cb, C.top_n_products(cb, 10))
               .select("product_id", "seller_state_encoded", "Date", "QuantitySold"))


_GRID_SQL = """,
span AS (SELECT min(Date) AS lo, max(Date) AS hi FROM cube_all),
prods AS (SELECT product_id, min(product_category_name_english) AS product_category_name_english
          FROM cube_all GROUP BY 1),
grid AS (SELECT p.product_id, p.product_category_name_english, CAST(w.wk AS DATE) AS Date
         FROM prods p, span, LATERAL (SELECT unnest(generate_series(span.lo, span.hi, INTERVAL 7 DAY)) AS wk) w)"""


@q("j6_product_week_grid", with_(*ALL_CUBE_CTES) + _GRID_SQL + """
SELECT product_id, product_category_name_english, strftime(Date, '%Y-%m-%d') AS Date FROM grid""")
def j6_product_week_grid(spark, d):
    return out(C.product_week_grid(cube(spark, d, family=False)))


_DENSE_SQL = _GRID_SQL + """,
dense AS (
  SELECT g.product_id, g.product_category_name_english,
         CAST(coalesce(c.seller_state_encoded, -1) AS INTEGER) AS seller_state_encoded, g.Date,
         CAST(coalesce(c.QuantitySold, 0) AS BIGINT) AS QuantitySold, c.AverageSellingPrice,
         c.Weight_g_Mean, c.Length_cm_Mean, c.Height_cm_Mean, c.Width_cm_Mean
  FROM grid g LEFT JOIN cube_all c ON g.product_id = c.product_id AND g.Date = c.Date)"""


@q("j7_densify", with_(*ALL_CUBE_CTES) + _DENSE_SQL + """
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date, QuantitySold,
       AverageSellingPrice FROM dense""")
def j7_densify(spark, d):
    return out(C.densify(cube(spark, d, family=False)).select(
        "product_id", "seller_state_encoded", "Date", "QuantitySold", "AverageSellingPrice"))


@q("j8_refill_category", with_(*ALL_CUBE_CTES) + _DENSE_SQL + """
SELECT product_category_name_english, CAST(count(*) AS BIGINT) AS rows,
       CAST(sum(CASE WHEN AverageSellingPrice IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS filled_rows
FROM dense GROUP BY 1""")
def j8_refill_category(spark, d):
    dn = C.densify(cube(spark, d, family=False))
    return dn.groupBy(CAT).agg(F.count(F.lit(1)).alias("rows"),
                               F.sum(F.col("AverageSellingPrice").isNull().cast("long")).alias("filled_rows"))


# =========================================================== A: aggregations

_CUBE_OUT_SQL = """
SELECT product_id, product_category_name_english, seller_state_encoded,
       strftime(Date, '%Y-%m-%d') AS Date, QuantitySold, AverageSellingPrice, Weight_g_Mean,
       Length_cm_Mean, Height_cm_Mean, Width_cm_Mean FROM cube"""


@q("a1_weekly_cube", with_(*CUBE_CTES) + _CUBE_OUT_SQL)
def a1_weekly_cube(spark, d):
    return out(cube(spark, d))


@q("a2_product_totals", with_(*CUBE_CTES) + """
SELECT product_id, CAST(sum(QuantitySold) AS BIGINT) AS total_units FROM cube GROUP BY 1""")
def a2_product_totals(spark, d):
    return C.product_totals(cube(spark, d))


@q("a3_popular_products", with_(*CUBE_CTES) + """
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date, QuantitySold FROM cube
WHERE product_id IN (SELECT product_id FROM cube GROUP BY 1 HAVING sum(QuantitySold) >= 10)""")
def a3_popular_products(spark, d):
    return out(C.popular(cube(spark, d), 10).select("product_id", "seller_state_encoded", "Date",
                                                    "QuantitySold"))


@q("a4_top_n_products", with_(*CUBE_CTES) + """
SELECT product_id, CAST(sum(QuantitySold) AS BIGINT) AS total_units FROM cube GROUP BY 1
ORDER BY total_units DESC, product_id LIMIT 500""")
def a4_top_n_products(spark, d):
    return C.top_n_products(cube(spark, d), 500)


@q("a5_top_by_units", with_(*CUBE_CTES) + """
SELECT product_id, product_category_name_english, CAST(sum(QuantitySold) AS BIGINT) AS total_units
FROM cube GROUP BY 1, 2 ORDER BY total_units DESC, product_id LIMIT 20""")
def a5_top_by_units(spark, d):
    return C.top_by_units(cube(spark, d), 20)


_SUMMARY_SQL = """,
summary AS (
  SELECT product_id, product_category_name_english, CAST(sum(QuantitySold) AS BIGINT) AS total_units,
         avg(AverageSellingPrice) AS avg_price
  FROM cube GROUP BY 1, 2)"""


@q("a6_product_summary", with_(*CUBE_CTES) + _SUMMARY_SQL + """
SELECT product_id, product_category_name_english, total_units, round(avg_price, 6) AS avg_price,
       round(total_units * avg_price, 6) AS revenue FROM summary""")
def a6_product_summary(spark, d):
    return D.product_summary(cube(spark, d)).withColumns(r6("avg_price", "revenue"))


@q("a7_top_products", with_(*CUBE_CTES) + _SUMMARY_SQL + """
SELECT product_id, product_category_name_english AS category, total_units,
       substr(CAST(product_id AS VARCHAR), 1, 20) || '...' AS product_id_short,
       CAST(round(CAST((avg_price) AS DECIMAL(38,9)), 2) AS DOUBLE) AS avg_price_brl, CAST(round(CAST((avg_price * 6.8) AS DECIMAL(38,9)), 2) AS DOUBLE) AS avg_price_thb,
       CAST(round(CAST((total_units * avg_price) AS DECIMAL(38,9)), 2) AS DOUBLE) AS revenue_brl, CAST(round(CAST((total_units * avg_price * 6.8) AS DECIMAL(38,9)), 2) AS DOUBLE) AS revenue_thb
FROM summary ORDER BY total_units * avg_price DESC, product_id LIMIT 10""")
def a7_top_products(spark, d):
    return D.top_products(cube(spark, d), 10)


@q("a6l_product_listing", with_(*CUBE_CTES) + f""",
u AS (SELECT product_id, product_category_name_english AS category, CAST(sum(QuantitySold) AS BIGINT) AS total_sales,
             avg(AverageSellingPrice) AS p, sum(QuantitySold) * avg(AverageSellingPrice) AS r FROM cube GROUP BY 1, 2)
SELECT CAST(row_number() OVER (ORDER BY {rm('r')} DESC, product_id) AS BIGINT) AS position, product_id,
       substr(CAST(product_id AS VARCHAR), 1, 30) || '...' AS product_id_short, category, total_sales,
       {rm('p')} AS avg_price_brl, {rm('p * 6.8')} AS avg_price_thb, {rm('r')} AS revenue_brl, {rm('r * 6.8')} AS revenue_thb
FROM u""")
def a6l_product_listing(spark, d):
    return D.product_listing(cube(spark, d))


_LAST8_SQL = """,
last8 AS (SELECT QuantitySold AS q, QuantitySold * AverageSellingPrice AS rev,
                 row_number() OVER (ORDER BY Date DESC, product_id DESC, seller_state_encoded DESC) AS rk
          FROM cube ORDER BY Date DESC, product_id DESC, seller_state_encoded DESC LIMIT 8),
chg AS (SELECT CASE WHEN count(*) = 8 THEN
                 (sum(CASE WHEN rk <= 4 THEN rev END) / (sum(CASE WHEN rk > 4 THEN rev END) + 1e-6) - 1) * 100
               ELSE 0.0 END AS revenue_change,
               CASE WHEN count(*) = 8 THEN
                 (CAST(sum(CASE WHEN rk <= 4 THEN q END) AS DOUBLE)
                  / (CAST(sum(CASE WHEN rk > 4 THEN q END) AS DOUBLE) + 1e-6) - 1) * 100
               ELSE 0.0 END AS sales_change FROM last8)"""


@q("a8_kpis", with_(*CUBE_CTES) + _LAST8_SQL + """
SELECT CAST(round(CAST((sum(QuantitySold * AverageSellingPrice)) AS DECIMAL(38,9)), 2) AS DOUBLE) AS total_revenue_brl,
       CAST(round(CAST((sum(QuantitySold * AverageSellingPrice) * 6.8) AS DECIMAL(38,9)), 2) AS DOUBLE) AS total_revenue_thb,
       CAST(count(DISTINCT product_id) AS BIGINT) AS total_products,
       CAST(round(CAST((avg(AverageSellingPrice)) AS DECIMAL(38,9)), 2) AS DOUBLE) AS avg_price_brl, CAST(round(CAST((avg(AverageSellingPrice) * 6.8) AS DECIMAL(38,9)), 2) AS DOUBLE) AS avg_price_thb,
       CAST(sum(QuantitySold) AS BIGINT) AS total_sales,
       CAST(round(CAST((any_value(chg.revenue_change)) AS DECIMAL(38,9)), 1) AS DOUBLE) AS revenue_change, CAST(round(CAST((any_value(chg.sales_change)) AS DECIMAL(38,9)), 1) AS DOUBLE) AS sales_change
FROM cube, chg""")
def a8_kpis(spark, d):
    return D.kpis(cube(spark, d))


@q("a9_recent_change", with_(*CUBE_CTES) + _LAST8_SQL + """
SELECT round(revenue_change, 6) AS revenue_change, round(sales_change, 6) AS sales_change FROM chg""")
def a9_recent_change(spark, d):
    return D.recent_change(cube(spark, d), 4, "row").withColumns(r6("revenue_change", "sales_change"))


@q("a9w_recent_change_weeks", with_(*CUBE_CTES) + """,
wk AS (SELECT Date, sum(QuantitySold) AS q, sum(QuantitySold * AverageSellingPrice) AS rev,
              row_number() OVER (ORDER BY Date DESC) AS rk FROM cube GROUP BY Date),
last8 AS (SELECT * FROM wk WHERE rk <= 8)
SELECT round(CASE WHEN count(*) = 8 THEN (sum(CASE WHEN rk <= 4 THEN rev END)
             / (sum(CASE WHEN rk > 4 THEN rev END) + 1e-6) - 1) * 100 ELSE 0.0 END, 6) AS revenue_change,
       round(CASE WHEN count(*) = 8 THEN (CAST(sum(CASE WHEN rk <= 4 THEN q END) AS DOUBLE)
             / (CAST(sum(CASE WHEN rk > 4 THEN q END) AS DOUBLE) + 1e-6) - 1) * 100 ELSE 0.0 END, 6) AS sales_change
FROM last8""")
def a9w_recent_change_weeks(spark, d):
    return D.recent_change(cube(spark, d), 4, "week").withColumns(r6("revenue_change", "sales_change"))


@q("a10_sales_trend", with_(*CUBE_CTES) + """,
last12 AS (SELECT * FROM cube ORDER BY Date DESC, product_id DESC, seller_state_encoded DESC LIMIT 12)
SELECT CAST(sum(QuantitySold) AS BIGINT) AS sales, CAST(round(CAST((avg(AverageSellingPrice)) AS DECIMAL(38,9)), 2) AS DOUBLE) AS price_brl,
       CAST(round(CAST((avg(AverageSellingPrice) * 6.8) AS DECIMAL(38,9)), 2) AS DOUBLE) AS price_thb, strftime(Date, '%Y-%m-%d') AS week
FROM last12 GROUP BY Date""")
def a10_sales_trend(spark, d):
    return D.sales_trend(cube(spark, d), 12, "row")


@q("a10w_sales_trend_weeks", with_(*CUBE_CTES) + """
SELECT CAST(sum(QuantitySold) AS BIGINT) AS sales, CAST(round(CAST((avg(AverageSellingPrice)) AS DECIMAL(38,9)), 2) AS DOUBLE) AS price_brl,
       CAST(round(CAST((avg(AverageSellingPrice) * 6.8) AS DECIMAL(38,9)), 2) AS DOUBLE) AS price_thb, strftime(Date, '%Y-%m-%d') AS week
FROM cube GROUP BY Date ORDER BY Date DESC LIMIT 12""")
def a10w_sales_trend_weeks(spark, d):
    return D.sales_trend(cube(spark, d), 12, "week")


@q("a11_product_analysis", with_(*CUBE_CTES) + """
SELECT product_id, arg_min(product_category_name_english, (Date, seller_state_encoded)) AS category,
       CAST(sum(QuantitySold) AS BIGINT) AS total_sales,
       CAST(count(*) AS BIGINT) AS weeks_active, CAST(round(CAST((avg(QuantitySold)) AS DECIMAL(38,9)), 1) AS DOUBLE) AS avg_weekly_sales,
       CAST(round(CAST((avg(AverageSellingPrice)) AS DECIMAL(38,9)), 2) AS DOUBLE) AS avg_price_brl, CAST(round(CAST((avg(AverageSellingPrice) * 6.8) AS DECIMAL(38,9)), 2) AS DOUBLE) AS avg_price_thb,
       CAST(round(CAST((min(AverageSellingPrice)) AS DECIMAL(38,9)), 2) AS DOUBLE) AS min_price_brl, CAST(round(CAST((min(AverageSellingPrice) * 6.8) AS DECIMAL(38,9)), 2) AS DOUBLE) AS min_price_thb,
       CAST(round(CAST((max(AverageSellingPrice)) AS DECIMAL(38,9)), 2) AS DOUBLE) AS max_price_brl, CAST(round(CAST((max(AverageSellingPrice) * 6.8) AS DECIMAL(38,9)), 2) AS DOUBLE) AS max_price_thb,
       CAST(round(CAST((sum(QuantitySold * AverageSellingPrice)) AS DECIMAL(38,9)), 2) AS DOUBLE) AS total_revenue_brl,
       CAST(round(CAST((sum(QuantitySold * AverageSellingPrice) * 6.8) AS DECIMAL(38,9)), 2) AS DOUBLE) AS total_revenue_thb,
       substr(CAST(product_id AS VARCHAR), 1, 30) || '...' AS product_id_short
FROM cube GROUP BY product_id""")
def a11_product_analysis(spark, d):
    return D.product_analysis(cube(spark, d))


@q("a12_product_history", with_(*CUBE_CTES) + """,
per AS (SELECT product_id, Date, sum(QuantitySold) AS sales, avg(AverageSellingPrice) AS price
        FROM cube GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY Date DESC) AS r FROM per)
SELECT product_id, CAST(sales AS BIGINT) AS sales, CAST(round(CAST((price) AS DECIMAL(38,9)), 2) AS DOUBLE) AS price_brl,
       CAST(round(CAST((price * 6.8) AS DECIMAL(38,9)), 2) AS DOUBLE) AS price_thb, strftime(Date, '%Y-%m-%d') AS week FROM rk WHERE r <= 12""")
def a12_product_history(spark, d):
    return D.product_history(cube(spark, d), 12)


@q("a13_distinct_counts", with_(*CUBE_CTES) + """
SELECT CAST(count(DISTINCT product_category_name_english) AS BIGINT) AS n_product_category_name_english,
       CAST(count(DISTINCT product_id) AS BIGINT) AS n_product_id,
       CAST(count(DISTINCT Date) AS BIGINT) AS n_Date FROM cube""")
def a13_distinct_counts(spark, d):
    return C.distinct_counts(cube(spark, d), [CAT, "product_id", "Date"])


@q("a13s_distinct_sketches", with_(*CUBE_CTES) + """
SELECT CAST(count(DISTINCT product_id) AS BIGINT) AS products, CAST(count(DISTINCT Date) AS BIGINT) AS weeks,
       true AS within_bound, true AS later_within_bound FROM cube""")
def a13s_distinct_sketches(spark, d):
    """Sketches per week, merged at once, and merged from two halves; both
    within three standard errors (1.04 / sqrt(2^12) each) of the exact count."""
    cb = cube(spark, d).checkpoint(eager=True)
    weekly = C.distinct_sketches(cb, ["product_id", "Date"]).checkpoint(eager=True)
    early = F.col("Date") < F.lit(cb.agg(F.min("Date")).first()[0]) + F.expr("INTERVAL 100 DAYS")
    union = [F.hll_union_agg(f"s_{c}").alias(f"s_{c}") for c in ("product_id", "Date")]
    halves = weekly.where(early).agg(*union).unionByName(weekly.where(~early).agg(*union))
    once, later = C.merged_distinct(weekly, ["product_id", "Date"]), C.merged_distinct(halves, ["product_id", "Date"])
    exact = C.distinct_counts(cb, ["product_id", "Date"]).toDF("products", "weeks")
    near = lambda e, n: F.abs(F.col(e) - F.col(n)) <= F.greatest(F.lit(1), 3 * 1.04 / 64 * F.col(n))
    return (exact.crossJoin(once).crossJoin(later.toDF("p2", "w2"))       # one row each
            .select("products", "weeks", (near("n_product_id", "products") & near("n_Date", "weeks")).alias("within_bound"),
                    (near("p2", "products") & near("w2", "weeks")).alias("later_within_bound")))


@q("a14_category_counts", with_(SRC, lines_sql()) + """
SELECT product_category_name_english, CAST(count(*) AS BIGINT) AS rows FROM lines GROUP BY 1""")
def a14_category_counts(spark, d):
    return C.category_counts(lines(spark, d))


@q("a15_stage_counts", with_(*CUBE_CTES) + """
SELECT 0 AS step, 'delivered_orders' AS stage, CAST(count(*) AS BIGINT) AS rows FROM src_orders WHERE order_status = 'F'
UNION ALL SELECT 1, 'family_lines', count(*) FROM lines
UNION ALL SELECT 2, 'weekly_cube', count(*) FROM cube
UNION ALL SELECT 3, 'popular_cube', count(*) FROM cube
  WHERE product_id IN (SELECT product_id FROM cube GROUP BY 1 HAVING sum(QuantitySold) >= 10)""")
def a15_stage_counts(spark, d):
    src = sources(spark, d)
    ln = lines(spark, d)
    cb = cube(spark, d)
    return C.stage_counts({"delivered_orders": S.delivered(src["orders"], DELIVERED), "family_lines": ln,
                           "weekly_cube": cb, "popular_cube": C.popular(cb, 10)})


@q("a16_date_span", with_(*CUBE_CTES) + """
SELECT strftime(min(Date), '%Y-%m-%d') AS min_date, strftime(max(Date), '%Y-%m-%d') AS max_date FROM cube""")
def a16_date_span(spark, d):
    return out(C.date_span(cube(spark, d)))


@q("a17_price_stats", with_(*CUBE_CTES) + """
SELECT product_id, round(avg(AverageSellingPrice), 6) AS mean_price,
       round(stddev_samp(AverageSellingPrice), 6) AS std_price,
       min(AverageSellingPrice) AS min_price, max(AverageSellingPrice) AS max_price FROM cube GROUP BY 1""")
def a17_price_stats(spark, d):
    return C.price_stats(cube(spark, d)).withColumns(r6("mean_price", "std_price"))


@q("a18_fallback_price", with_(*CUBE_CTES) + """
SELECT median(AverageSellingPrice) AS median_price,
       round(avg(AverageSellingPrice), 6) AS mean_price FROM cube""")
def a18_fallback_price(spark, d):
    cb = cube(spark, d)
    med = C.fallback_value(cb, "AverageSellingPrice", "median")
    mean = C.fallback_value(cb, "AverageSellingPrice", "mean")
    return spark.createDataFrame([(float(med), round(float(mean), 6))], "median_price double, mean_price double")


@q("a19_distinct_rows", with_(*CUBE_CTES) + """
SELECT DISTINCT product_id, product_category_name_english FROM cube""")
def a19_distinct_rows(spark, d):
    return C.distinct_rows(cube(spark, d).select("product_id", CAT))


@q("a20_min_volume", with_(*CUBE_CTES) + """
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date, QuantitySold FROM (
  SELECT *, sum(QuantitySold) OVER (PARTITION BY product_id) AS tot FROM cube) WHERE tot > 5""")
def a20_min_volume(spark, d):
    return out(C.min_volume(cube(spark, d), 5).select("product_id", "seller_state_encoded", "Date",
                                                      "QuantitySold"))


# =========================================================== T: sorts / top-k

@q("t2_sort_by_units", with_(*CUBE_CTES) + """
SELECT product_id, CAST(sum(QuantitySold) AS BIGINT) AS total_units FROM cube GROUP BY 1
ORDER BY total_units DESC, product_id""")
def t2_sort_by_units(spark, d):
    return C.product_totals(cube(spark, d)).orderBy(F.desc("total_units"), "product_id")


@q("t4_top_targets", with_(*CUBE_CTES) + """
SELECT product_id, CAST(sum(QuantitySold) AS BIGINT) AS total_units FROM cube GROUP BY 1
ORDER BY total_units DESC, product_id LIMIT 10""")
def t4_top_targets(spark, d):
    return C.product_totals(cube(spark, d)).orderBy(F.desc("total_units"), "product_id").limit(10)


@q("t5_tail_rows", with_(*CUBE_CTES) + """
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date, QuantitySold FROM cube
ORDER BY Date DESC, product_id DESC, seller_state_encoded DESC LIMIT 12""")
def t5_tail_rows(spark, d):
    from margincast.operators.windows import tail
    return out(tail(cube(spark, d), ["Date", "product_id", "seller_state_encoded"], 12)
               .select("product_id", "seller_state_encoded", "Date", "QuantitySold"))


# =========================================================== H: dates

@q("h1_week_label", with_(SRC) + f"""
SELECT strftime({WEEK_SQL.format(c='order_purchase_timestamp')}, '%Y-%m-%d') AS week,
       CAST(count(*) AS BIGINT) AS orders,
       CAST(count(DISTINCT dayofweek(order_purchase_timestamp)) AS BIGINT) AS weekdays
FROM src_orders WHERE order_status = 'F' GROUP BY 1""")
def h1_week_label(spark, d):
    from margincast.functions.dates import week_label
    o = S.delivered(sources(spark, d)["orders"], DELIVERED)
    return out(o.groupBy(week_label("order_purchase_timestamp").alias("week")).agg(
        F.count(F.lit(1)).alias("orders"),
        F.countDistinct(F.dayofweek("order_purchase_timestamp")).alias("weekdays")))


_CAL_SQL = """
SELECT DISTINCT strftime(Date, '%Y-%m-%d') AS Date, CAST(year(Date) AS INTEGER) AS Year,
       CAST(month(Date) AS INTEGER) AS Month, CAST(weekofyear(Date) AS INTEGER) AS Week,
       CAST(quarter(Date) AS INTEGER) AS Quarter, CAST(isodow(Date) - 1 AS INTEGER) AS DayOfWeek,
       CAST(CASE WHEN isodow(Date) - 1 IN (5, 6) THEN 1 ELSE 0 END AS INTEGER) AS IsWeekend FROM cube"""


@q("h2_h4_calendar", with_(*CUBE_CTES) + _CAL_SQL)
def h2_h4_calendar(spark, d):
    from margincast.functions.dates import calendar_columns
    return out(cube(spark, d).select("Date").distinct().withColumns(calendar_columns("Date")))


@q("h3_iso_week_order_days", with_(SRC) + """
SELECT DISTINCT strftime(order_purchase_timestamp, '%Y-%m-%d') AS day,
       CAST(weekofyear(order_purchase_timestamp) AS INTEGER) AS iso_week,
       CAST(isodow(order_purchase_timestamp) - 1 AS INTEGER) AS weekday FROM src_orders""")
def h3_iso_week_order_days(spark, d):
    from margincast.functions.dates import day_of_week, iso_week
    o = sources(spark, d)["orders"]
    return o.select(F.date_format("order_purchase_timestamp", "yyyy-MM-dd").alias("day"),
                    iso_week("order_purchase_timestamp").alias("iso_week"),
                    day_of_week("order_purchase_timestamp").alias("weekday")).distinct()


@q("h5_week_spine", with_(*CUBE_CTES) + """
SELECT strftime(CAST(unnest(generate_series(min(Date), max(Date), INTERVAL 7 DAY)) AS DATE), '%Y-%m-%d') AS week
FROM cube""")
def h5_week_spine(spark, d):
    from margincast.functions.dates import week_spine_bounds
    span = C.date_span(cube(spark, d))
    return out(span.select(F.explode(week_spine_bounds("min_date", "max_date")).alias("week")))


@q("h6_holiday_calendar", with_(*CUBE_CTES, holidays_sql("cube")) + """
SELECT strftime(holiday_date, '%Y-%m-%d') AS holiday_date FROM hol""")
def h6_holiday_calendar(spark, d):
    from margincast.functions.holidays import holiday_calendar, year_range
    return out(holiday_calendar(year_range(cube(spark, d))).select("holiday_date"))


@q("h7_date_format", with_(*CUBE_CTES) + """
SELECT DISTINCT strftime(Date, '%Y-%m-%d') AS date_text FROM cube""")
def h7_date_format(spark, d):
    from margincast.functions.dates import fmt_date
    return cube(spark, d).select(fmt_date("Date").alias("date_text")).distinct()


# =========================================================== W: windows (over the cube)

_W = "PARTITION BY product_id ORDER BY Date, seller_state_encoded"
P_, Q_ = "AverageSellingPrice", "QuantitySold"


def _win_sql(select: str) -> str:
    return with_(*CUBE_CTES) + f"""
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date, {select} FROM cube"""


def _win(spark, d, cols: dict, rounded: tuple = ()):
    cb = cube(spark, d)
    res = cb.select("product_id", "seller_state_encoded", "Date", *[v.alias(k) for k, v in cols.items()])
    return out(res.withColumns(r6(*rounded)) if rounded else res)


@q("w1_lags", _win_sql(f"""lag({Q_}, 1) OVER ({_W}) AS qty_lag_1, lag({Q_}, 4) OVER ({_W}) AS qty_lag_4,
  lag({P_}, 1) OVER ({_W}) AS price_lag_1, lag({P_}, 4) OVER ({_W}) AS price_lag_4,
  lag({Q_}, 52) OVER ({_W}) AS qty_lag_52"""))
def w1_lags(spark, d):
    from margincast.operators.windows import lag
    return _win(spark, d, {"qty_lag_1": lag(Q_, 1), "qty_lag_4": lag(Q_, 4), "price_lag_1": lag(P_, 1),
                           "price_lag_4": lag(P_, 4), "qty_lag_52": lag(Q_, 52)})


@q("w2_rolling_inclusive", _win_sql(f"""
  round(avg({Q_}) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS qty_roll_4,
  round(avg({P_}) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS price_roll_4"""))
def w2_rolling_inclusive(spark, d):
    from margincast.operators.windows import rolling
    return _win(spark, d, {"qty_roll_4": rolling(Q_, 4, "mean", True), "price_roll_4": rolling(P_, 4, "mean", True)},
                ("qty_roll_4", "price_roll_4"))


@q("w3_rolling_previous", _win_sql(", ".join(
    f"round(avg({c}) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS {a}_prev_mean_{n}"
    for c, a in ((Q_, "qty"), (P_, "price")) for n in (4, 8, 12))))
def w3_rolling_previous(spark, d):
    from margincast.operators.windows import rolling
    cols = {f"{a}_prev_mean_{n}": rolling(c, n, "mean", False)
            for c, a in ((Q_, "qty"), (P_, "price")) for n in (4, 8, 12)}
    return _win(spark, d, cols, tuple(cols))


@q("w4_rolling_std", _win_sql(", ".join(
    f"round(stddev_samp({Q_}) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 6) AS qty_prev_std_{n}"
    for n in (4, 8))))
def w4_rolling_std(spark, d):
    from margincast.operators.windows import rolling
    cols = {f"qty_prev_std_{n}": rolling(Q_, n, "std", False) for n in (4, 8)}
    return _win(spark, d, cols, tuple(cols))


@q("w5_rolling_max", _win_sql(", ".join(
    f"max({Q_}) OVER ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS qty_prev_max_{n}"
    for n in (4, 8, 12))))
def w5_rolling_max(spark, d):
    from margincast.operators.windows import rolling
    return _win(spark, d, {f"qty_prev_max_{n}": rolling(Q_, n, "max", False) for n in (4, 8, 12)})


@q("w6_diffs", _win_sql(f"""{P_} - lag({P_}, 1) OVER ({_W}) AS price_diff,
  {Q_} - lag({Q_}, 1) OVER ({_W}) AS qty_diff"""))
def w6_diffs(spark, d):
    from margincast.operators.windows import diff
    return _win(spark, d, {"price_diff": diff(P_), "qty_diff": diff(Q_)})


@q("w7_w8_fill_height", _win_sql(f"""Height_cm_Mean,
  coalesce(last_value(Height_cm_Mean IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
           first_value(Height_cm_Mean IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
           0.0) AS height_filled"""))
def w7_w8_fill_height(spark, d):
    from margincast.operators.windows import bfill, ffill
    return _win(spark, d, {"Height_cm_Mean": F.col("Height_cm_Mean"),
                           "height_filled": F.coalesce(ffill("Height_cm_Mean"), bfill("Height_cm_Mean"),
                                                       F.lit(0.0))})


_LATEST_SQL = f""",
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id
                          ORDER BY Date DESC, seller_state_encoded DESC) AS rn FROM cube) WHERE rn = 1)"""


@q("w9_latest_rows", with_(*CUBE_CTES) + _LATEST_SQL + f"""
SELECT product_id, product_category_name_english, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date,
       {Q_}, {P_} FROM latest""")
def w9_latest_rows(spark, d):
    from margincast.operators.windows import latest_rows
    return out(latest_rows(cube(spark, d)).select("product_id", CAT, "seller_state_encoded", "Date", Q_, P_))


_ROWSPLIT_SQL = f""",
pos AS (SELECT *, row_number() OVER (ORDER BY product_id, Date, seller_state_encoded) - 1 AS p,
               count(*) OVER () AS n FROM cube)"""


@q("w10_row_split", with_(*CUBE_CTES) + _ROWSPLIT_SQL + """
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date,
       p < CAST(floor(n * 0.8) AS BIGINT) AS is_train FROM pos""")
def w10_row_split(spark, d):
    from margincast.operators.splits import row_split
    return out(row_split(cube(spark, d), 0.8).select("product_id", "seller_state_encoded", "Date", "is_train"))


@q("w11_date_split", with_(*CUBE_CTES) + """,
dates AS (SELECT Date, row_number() OVER (ORDER BY Date) AS rn, count(*) OVER () AS n
          FROM (SELECT DISTINCT Date FROM cube)),
split AS (SELECT Date AS split_date FROM dates WHERE rn = CAST(floor(n * 0.8) AS BIGINT) + 1)
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date,
       Date < (SELECT split_date FROM split) AS is_train FROM cube""")
def w11_date_split(spark, d):
    from margincast.operators.splits import date_split
    return out(date_split(cube(spark, d), 0.8).select("product_id", "seller_state_encoded", "Date", "is_train"))


@q("w12_tail", with_(*CUBE_CTES) + """
SELECT strftime(Date, '%Y-%m-%d') AS Date, product_id, seller_state_encoded, QuantitySold FROM cube
ORDER BY Date DESC, product_id DESC, seller_state_encoded DESC LIMIT 8""")
def w12_tail(spark, d):
    from margincast.operators.windows import tail
    return out(tail(cube(spark, d), ["Date", "product_id", "seller_state_encoded"], 8)
               .select("Date", "product_id", "seller_state_encoded", "QuantitySold"))


# =========================================================== E: encodings and feature frames

@q("e1_label_encode", with_(*CUBE_CTES) + """,
prods AS (SELECT product_id, CAST(dense_rank() OVER (ORDER BY product_id) - 1 AS INTEGER) AS product_encoded
          FROM (SELECT DISTINCT product_id FROM cube)),
cats AS (SELECT c AS product_category_name_english,
                CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS category_encoded
         FROM (SELECT DISTINCT product_category_name_english AS c FROM cube))
SELECT DISTINCT product_id, product_category_name_english, product_encoded, category_encoded
FROM cube JOIN prods USING (product_id) JOIN cats USING (product_category_name_english)""")
def e1_label_encode(spark, d):
    from margincast.operators.features import encode_all
    return encode_all(cube(spark, d)).select("product_id", CAT, "product_encoded", "category_encoded").distinct()


def _fill_sql(c: str, default: str | None = None) -> str:
    tail = f", {default}" if default else ""
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING){tail})")


_DIMS = ["Weight_g_Mean", "Length_cm_Mean", "Height_cm_Mean", "Width_cm_Mean"]
_CAL_COLS = """CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month,
       CAST(weekofyear(Date) AS INTEGER) AS Week, CAST(quarter(Date) AS INTEGER) AS Quarter,
       CAST(CASE WHEN isodow(Date) - 1 IN (5, 6) THEN 1 ELSE 0 END AS INTEGER) AS IsWeekend"""

_BATCH_SQL = with_(*CUBE_CTES) + f""",
pop AS (SELECT * FROM cube WHERE product_id IN
        (SELECT product_id FROM cube GROUP BY 1 HAVING sum(QuantitySold) >= 1)),
filled0 AS (SELECT product_id, product_category_name_english, seller_state_encoded, Date, QuantitySold,
            {_fill_sql(P_)} AS {P_}, {", ".join(f"{_fill_sql(c, '0.0')} AS {c}" for c in _DIMS)} FROM pop),
filled AS (SELECT * REPLACE (coalesce({P_}, (SELECT median({P_}) FROM filled0)) AS {P_}) FROM filled0),
prods AS (SELECT product_id, CAST(dense_rank() OVER (ORDER BY product_id) - 1 AS INTEGER) AS product_encoded
          FROM (SELECT DISTINCT product_id FROM filled)),
cats AS (SELECT c AS product_category_name_english,
                CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS category_encoded
         FROM (SELECT DISTINCT product_category_name_english AS c FROM filled)),
{holidays_sql('filled').strip()},
batch AS (
  SELECT f.*, product_encoded, category_encoded, {_CAL_COLS},
         CAST(CASE WHEN Date IN (SELECT holiday_date FROM hol) THEN 1 ELSE 0 END AS INTEGER) AS IsHoliday,
         CAST(coalesce(lag({P_}, 1) OVER ({_W}), 0) AS DOUBLE) AS {P_}_Lag_1,
         CAST(coalesce(lag({P_}, 4) OVER ({_W}), 0) AS DOUBLE) AS {P_}_Lag_4,
         avg({P_}) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {P_}_Roll_Mean_4,
         CAST(coalesce(lag({Q_}, 1) OVER ({_W}), 0) AS DOUBLE) AS {Q_}_Lag_1,
         CAST(coalesce(lag({Q_}, 4) OVER ({_W}), 0) AS DOUBLE) AS {Q_}_Lag_4,
         avg({Q_}) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS {Q_}_Roll_Mean_4,
         CAST(coalesce({P_} - lag({P_}, 1) OVER ({_W}), 0) AS DOUBLE) AS Price_Diff_Lag_1,
         CAST(coalesce({Q_} - lag({Q_}, 1) OVER ({_W}), 0) AS DOUBLE) AS Qty_Diff_Lag_1
  FROM filled f JOIN prods USING (product_id) JOIN cats USING (product_category_name_english))"""


def batch_frame(spark, d):
    from margincast.operators.features import batch_features
    return batch_features(cube(spark, d))


@q("e2_batch_features", _BATCH_SQL + f"""
SELECT * REPLACE (strftime(Date, '%Y-%m-%d') AS Date, round({P_}_Roll_Mean_4, 6) AS {P_}_Roll_Mean_4,
                  round({Q_}_Roll_Mean_4, 6) AS {Q_}_Roll_Mean_4) FROM batch""")
def e2_batch_features(spark, d):
    return out(batch_frame(spark, d).withColumns(r6(f"{P_}_Roll_Mean_4", f"{Q_}_Roll_Mean_4")))


# fills over the cube's own row order, the backward one across products
_SEQ = "product_id, product_category_name_english, seller_state_encoded, Date"
_PARITY_SQL = _BATCH_SQL.replace("filled0 AS (SELECT", f"""ff AS (SELECT * REPLACE ({", ".join(
    f"last_value({c} IGNORE NULLS) OVER (PARTITION BY product_id ORDER BY {_SEQ} ROWS UNBOUNDED PRECEDING) AS {c}"
    for c in [P_, *_DIMS])}) FROM pop),
bf AS (SELECT * REPLACE ({", ".join(
    f"first_value({c} IGNORE NULLS) OVER (ORDER BY {_SEQ} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}"
    for c in [P_, *_DIMS])}) FROM ff),
unused AS (SELECT""", 1).replace("filled AS (SELECT * REPLACE", f"""filled0 AS (
  SELECT * REPLACE ({", ".join(f"coalesce({c}, 0.0) AS {c}" for c in _DIMS)}) FROM bf),
filled AS (SELECT * REPLACE""", 1)


@q("e2p_parity_features", _PARITY_SQL + f"""
SELECT * REPLACE (strftime(Date, '%Y-%m-%d') AS Date, round({P_}_Roll_Mean_4, 6) AS {P_}_Roll_Mean_4,
                  round({Q_}_Roll_Mean_4, 6) AS {Q_}_Roll_Mean_4) FROM batch""")
def e2p_parity_features(spark, d):
    """The batch frame with fills over the cube's row order (category, region,
    date) and a backward fill that runs on across products."""
    from margincast.operators.features import batch_features
    return out(batch_features(cube(spark, d), fill_scope="sequence")
               .withColumns(r6(f"{P_}_Roll_Mean_4", f"{Q_}_Roll_Mean_4")))


_SERVICE_SQL = with_(*CUBE_CTES) + f""",
pop AS (SELECT * FROM cube WHERE product_id IN
        (SELECT product_id FROM cube GROUP BY 1 HAVING sum(QuantitySold) >= 10)),
cats AS (SELECT c AS product_category_name_english,
                CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS category_encoded
         FROM (SELECT DISTINCT product_category_name_english AS c FROM pop)),
svc0 AS (
  SELECT p.*, category_encoded, {_CAL_COLS},
         lag({Q_}, 1) OVER ({_W}) AS {Q_}_Lag_1, lag({Q_}, 4) OVER ({_W}) AS {Q_}_Lag_4,
         lag({P_}, 1) OVER ({_W}) AS {P_}_Lag_1, lag({P_}, 4) OVER ({_W}) AS {P_}_Lag_4,
         avg({Q_}) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS {Q_}_Roll_Mean_4,
         avg({P_}) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS {P_}_Roll_Mean_4,
         {P_} - lag({P_}, 1) OVER ({_W}) AS Price_Diff_Lag_1,
         {Q_} - lag({Q_}, 1) OVER ({_W}) AS Qty_Diff_Lag_1
  FROM pop p JOIN cats USING (product_category_name_english)),
service AS (SELECT * FROM svc0 WHERE COLUMNS(*) IS NOT NULL)"""


def service_frame(spark, d):
    from margincast.operators.features import service_features
    return service_features(cube(spark, d))


@q("e3_service_features", _SERVICE_SQL + f"""
SELECT * REPLACE (strftime(Date, '%Y-%m-%d') AS Date, round({P_}_Roll_Mean_4, 6) AS {P_}_Roll_Mean_4,
                  round({Q_}_Roll_Mean_4, 6) AS {Q_}_Roll_Mean_4) FROM service""")
def e3_service_features(spark, d):
    return out(service_frame(spark, d).withColumns(r6(f"{P_}_Roll_Mean_4", f"{Q_}_Roll_Mean_4")))


@q("f8_complete_rows", _SERVICE_SQL + """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT product_id) AS BIGINT) AS products FROM service""")
def f8_complete_rows(spark, d):
    sf = service_frame(spark, d)
    return sf.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("product_id").alias("products"))


@q("f10_zero_fill", _BATCH_SQL + f"""
SELECT CAST(sum(CASE WHEN {Q_}_Lag_4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_lag4,
       CAST(sum(CASE WHEN Height_cm_Mean = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_height FROM batch""")
def f10_zero_fill(spark, d):
    b = batch_frame(spark, d)
    return b.agg(F.sum((F.col(f"{Q_}_Lag_4") == 0).cast("long")).alias("zero_lag4"),
                 F.sum((F.col("Height_cm_Mean") == 0).cast("long")).alias("zero_height"))


@q("j10_holiday_flag", _BATCH_SQL + """
SELECT strftime(Date, '%Y-%m-%d') AS Date, IsHoliday, CAST(count(*) AS BIGINT) AS rows FROM batch
WHERE IsHoliday = 1 GROUP BY 1, 2""")
def j10_holiday_flag(spark, d):
    b = batch_frame(spark, d)
    return out(b.where(F.col("IsHoliday") == 1).groupBy("Date", "IsHoliday").agg(F.count(F.lit(1)).alias("rows")))


@q("h_cal_batch_columns", _BATCH_SQL + """
SELECT DISTINCT strftime(Date, '%Y-%m-%d') AS Date, Year, Month, Week, Quarter, IsWeekend, IsHoliday FROM batch""")
def h_cal_batch_columns(spark, d):
    return out(batch_frame(spark, d).select("Date", "Year", "Month", "Week", "Quarter", "IsWeekend",
                                            "IsHoliday").distinct())


# =========================================================== P: price search (closed-form demand)

_COSTS_CASE = "CAST(CASE rank " + " ".join(
    f"WHEN {i} THEN {float(c)}" for i, c in enumerate(PRODUCT_COSTS, 1)) + " ELSE 10.0 END AS DOUBLE)"

_PRICE_SQL = _BATCH_SQL + f""",
pos AS (SELECT *, row_number() OVER (ORDER BY product_id, Date, seller_state_encoded) - 1 AS p,
               count(*) OVER () AS n FROM batch),
train AS (SELECT * FROM pos WHERE p < CAST(floor(n * 0.8) AS BIGINT)),
base AS (SELECT *, {P_} AS current_price, {Q_} AS current_units FROM (
           SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY Date DESC, seller_state_encoded DESC) AS rn
           FROM batch) WHERE rn = 1),
ranked AS (SELECT product_id, CAST(sum({Q_}) AS BIGINT) AS total_units,
                  row_number() OVER (ORDER BY sum({Q_}) DESC, product_id) AS rank FROM train GROUP BY product_id),
costed AS (SELECT product_id, total_units, rank, {_COSTS_CASE} AS cost FROM ranked),
stats AS (SELECT product_id, avg({P_}) AS mean_price FROM batch GROUP BY 1),
unit_cost AS (SELECT product_id, coalesce(cost, 10.0) AS cost FROM stats LEFT JOIN costed USING (product_id)),
coef AS (SELECT product_id, regr_slope(CAST({Q_} AS DOUBLE), {P_}) AS b,
                regr_intercept(CAST({Q_} AS DOUBLE), {P_}) AS a, avg(CAST({Q_} AS DOUBLE)) AS mu
         FROM train GROUP BY 1),
pooled AS (SELECT regr_slope(CAST({Q_} AS DOUBLE), {P_}) AS pb, regr_intercept(CAST({Q_} AS DOUBLE), {P_}) AS pa,
                  avg(CAST({Q_} AS DOUBLE)) AS pmu FROM train),
model AS (SELECT product_id, CASE WHEN mu IS NULL THEN coalesce(pb, 0.0) ELSE coalesce(b, 0.0) END AS demand_slope,
                 CASE WHEN mu IS NOT NULL THEN CASE WHEN b IS NULL THEN mu ELSE a END
                      WHEN pb IS NULL THEN pmu ELSE pa END AS demand_intercept
          FROM stats LEFT JOIN coef USING (product_id), pooled),
bounds AS (SELECT product_id, mean_price, mean_price * 0.7 AS lower, mean_price * 1.3 AS upper FROM stats),
cand AS (SELECT product_id, CAST(k AS INTEGER) AS k, lower, upper,
                CASE WHEN k = 19 THEN upper ELSE CAST(k AS DOUBLE) * ((upper - lower) / 19.0) + lower END AS price
         FROM bounds, range(20) t(k)),
prof AS (SELECT c.*, cost, greatest(0.0, round_even(demand_intercept + demand_slope * price, 0)) AS demand,
                (price - cost) * greatest(0.0, round_even(demand_intercept + demand_slope * price, 0)) AS profit
         FROM cand c JOIN model USING (product_id) JOIN unit_cost USING (product_id)),
grid AS (SELECT product_id, price AS grid_price, profit AS grid_profit, demand AS grid_demand FROM (
           SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY profit DESC, price ASC) AS r FROM prof)
         WHERE r = 1)"""


class _Price:
    """The price-search inputs of the batch run, built once per query: costs by
    sales rank and demand from the train side, base rows and mean prices of
    every product from the whole frame."""

    def __init__(self, spark, d):
        from margincast.operators.pricing import LinearDemand, base_rows, product_costs, ranked_targets
        from margincast.operators.splits import row_split
        from margincast.session import reuse
        # every branch below (bases, ranks, stats, demand fit, candidates) reads this frame
        feats = self.feats = reuse(row_split(batch_frame(spark, d), 0.8))
        self.train = feats.where("is_train").drop("is_train")
        self.test = feats.where(~F.col("is_train")).drop("is_train")
        every = feats.drop("is_train")
        self.base = base_rows(every)
        self.costs = product_costs(self.train, products=every)
        self._ranked = lambda: ranked_targets(self.train, n=None)
        self.stats = C.price_stats(every).select("product_id", "mean_price")
        self.demand = LinearDemand(self.train)

    def bounds(self):
        from margincast.operators.pricing import price_bounds
        return price_bounds(self.stats, "mean")

    def candidates(self, n=20):
        from margincast.operators.pricing import price_candidates
        b = self.base.join(self.costs, "product_id")
        return price_candidates(self.bounds().join(b, "product_id"), n)

    def profits(self, variant="b"):
        from margincast.operators.pricing import score_candidates
        return score_candidates(self.candidates(), self.demand, variant)

    def grid(self):
        from margincast.operators.pricing import grid_search
        return grid_search(self.profits())


@q("j11_base_rows", _PRICE_SQL + f"""
SELECT product_id, strftime(Date, '%Y-%m-%d') AS Date, seller_state_encoded, current_price, current_units FROM base""")
def j11_base_rows(spark, d):
    return out(_Price(spark, d).base.select("product_id", "Date", "seller_state_encoded", "current_price",
                                            "current_units"))


_BASE_COLS = [P_, "Weight_g_Mean", f"{P_}_Lag_1", f"{Q_}_Lag_1", "Month"]


@q("j11f_base_rows_fallback", _BATCH_SQL + f""",
dates AS (SELECT Date, row_number() OVER (ORDER BY Date) AS rn, count(*) OVER () AS n
          FROM (SELECT DISTINCT Date FROM batch)),
train AS (SELECT * FROM batch WHERE Date < (SELECT Date FROM dates WHERE rn = CAST(floor(n * 0.8) AS BIGINT) + 1)),
lastd AS (SELECT max(Date) AS d FROM train),
week AS (SELECT *, 'last_week' AS base_level FROM train WHERE Date = (SELECT d FROM lastd)
         QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY seller_state_encoded) = 1),
lastrow AS (SELECT *, 'last_row' AS base_level FROM train WHERE product_id NOT IN (SELECT product_id FROM week)
            QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY Date DESC, seller_state_encoded DESC) = 1),
either AS (SELECT * FROM week UNION ALL SELECT * FROM lastrow),
means AS (SELECT {", ".join(f"avg({c}) AS {c}" for c in [*_BASE_COLS, Q_])} FROM train)
SELECT t.product_id, coalesce(base_level, 'mean') AS base_level, strftime(e.Date, '%Y-%m-%d') AS Date,
       {", ".join(f"round(CASE WHEN base_level IS NULL THEN m.{c} ELSE e.{c} END, 6) AS {c}" for c in _BASE_COLS)},
       round(CASE WHEN base_level IS NULL THEN m.{Q_} ELSE e.{Q_} END, 6) AS current_units
FROM (SELECT DISTINCT product_id FROM batch) t LEFT JOIN either e ON e.product_id = t.product_id, means m""")
def j11f_base_rows_fallback(spark, d):
    """Every product of the frame gets a base row from the train weeks."""
    from margincast.operators.pricing import base_rows_with_fallback
    from margincast.operators.splits import date_split
    feats = batch_frame(spark, d)
    train = date_split(feats, 0.8).where("is_train")
    base = base_rows_with_fallback(train, feats, _BASE_COLS)
    return out(base.select("product_id", "base_level", "Date", *[F.round(c, 6).alias(c) for c in _BASE_COLS],
                           F.round("current_units", 6).alias("current_units")))


@q("j12_cost_by_rank", _PRICE_SQL + """
SELECT product_id, total_units, CAST(rank AS INTEGER) AS rank, cost FROM costed""")
def j12_cost_by_rank(spark, d):
    return _Price(spark, d)._ranked().withColumn("rank", F.col("rank").cast("int"))


@q("a21_target_info", _PRICE_SQL + f""",
top AS (SELECT product_id FROM costed WHERE rank <= 10)
SELECT product_id, round(avg({P_}), 6) AS avg_price, CAST(sum({Q_}) AS BIGINT) AS total_units,
       arg_max(product_category_name_english, (Date, seller_state_encoded)) AS category
FROM train WHERE product_id IN (SELECT product_id FROM top) GROUP BY 1""")
def a21_target_info(spark, d):
    pr = _Price(spark, d)
    from margincast.operators.pricing import ranked_targets
    return D.target_info(pr.train, ranked_targets(pr.train, 10)).withColumns(r6("avg_price"))


_MEAN_COLS = ["AverageSellingPrice", "Weight_g_Mean", "Length_cm_Mean", "Height_cm_Mean", "Width_cm_Mean",
              "AverageSellingPrice_Lag_1", "QuantitySold_Lag_1"]


@q("a22_mean_features", _PRICE_SQL + "\nSELECT " + ", ".join(
    f"round(avg({c}), 6) AS {c}" for c in _MEAN_COLS) + " FROM train")
def a22_mean_features(spark, d):
    return D.mean_features(_Price(spark, d).train, _MEAN_COLS).withColumns(r6(*_MEAN_COLS))


@q("p1_price_bounds", _PRICE_SQL + """
SELECT product_id, round(lower, 6) AS lower, round(upper, 6) AS upper FROM bounds""")
def p1_price_bounds(spark, d):
    return _Price(spark, d).bounds().select("product_id", F.round("lower", 6).alias("lower"),
                                            F.round("upper", 6).alias("upper"))


@q("p2_price_candidates", _PRICE_SQL + """
SELECT product_id, k, round(price, 6) AS price FROM cand""")
def p2_price_candidates(spark, d):
    return _Price(spark, d).candidates().select("product_id", "k", F.round("price", 6).alias("price"))


@q("p3_counterfactual", _PRICE_SQL + f"""
SELECT c.product_id, c.k, round(c.price, 6) AS {P_}, round(b.current_price, 6) AS {P_}_Lag_1,
       round(c.price - b.current_price, 6) AS Price_Diff_Lag_1, CAST(b.current_units AS DOUBLE) AS Qty_Lag_1
FROM cand c JOIN base b USING (product_id)""")
def p3_counterfactual(spark, d):
    from margincast.operators.pricing import counterfactual
    cf = counterfactual(_Price(spark, d).candidates(), "c")
    cf = counterfactual(cf.drop(f"{P_}_Lag_1"), "b")     # both variants' moved columns
    return cf.select("product_id", "k", F.round(P_, 6).alias(P_), F.round(f"{P_}_Lag_1", 6).alias(f"{P_}_Lag_1"),
                     F.round("Price_Diff_Lag_1", 6).alias("Price_Diff_Lag_1"), "Qty_Lag_1")


@q("p4_profit", _PRICE_SQL + """
SELECT product_id, k, round(price, 6) AS price, cost, demand, CAST(round(CAST((profit) AS DECIMAL(38,9)), 4) AS DOUBLE) AS profit FROM prof""")
def p4_profit(spark, d):
    from margincast.functions.scalars import round_half_up
    return _Price(spark, d).profits().select("product_id", "k", F.round("price", 6).alias("price"), "cost",
                                             "demand", round_half_up("profit", 4).alias("profit"))


@q("p5_grid_search", _PRICE_SQL + """
SELECT product_id, round(grid_price, 6) AS grid_price, CAST(round(CAST((grid_profit) AS DECIMAL(38,9)), 4) AS DOUBLE) AS grid_profit,
       grid_demand FROM grid""")
def p5_grid_search(spark, d):
    from margincast.functions.scalars import round_half_up
    g = _Price(spark, d).grid()
    return g.select("product_id", F.round("grid_price", 6).alias("grid_price"),
                    round_half_up("grid_profit", 4).alias("grid_profit"), "grid_demand")


def _grid_best(pr):
    return pr.grid().withColumns({"optimal_price": F.col("grid_price"), "max_profit": F.col("grid_profit"),
                                  "method": F.lit("grid")})


def _report_sql() -> str:
    cp, op, mp = "current_price", "grid_price", "grid_profit"
    cprof = f"(({cp} - cost) * CAST(current_units AS DOUBLE))"
    ch = f"(({op} / ({cp} + 1e-6) - 1) * 100)"
    fmt1 = "printf('%.1f', {x})"
    rec = (f"CASE WHEN {ch} > 15 THEN 'แนะนำขึ้นราคา ' || {fmt1.format(x=ch)} || '% (ทำทีละน้อย 5-10% ก่อน)' "
           f"WHEN {ch} > 5 THEN 'แนะนำขึ้นราคาเล็กน้อย ' || {fmt1.format(x=ch)} || '%' "
           f"WHEN {ch} < -15 THEN 'แนะนำลดราคา ' || {fmt1.format(x=f'abs({ch})')} || '% (ทำโปรโมชั่น)' "
           f"WHEN {ch} < -5 THEN 'แนะนำลดราคาเล็กน้อย ' || {fmt1.format(x=f'abs({ch})')} || '%' "
           "ELSE 'ราคาปัจจุบันเหมาะสมแล้ว คงราคาไว้' END")
    return _PRICE_SQL + f""",
rep AS (SELECT * FROM base JOIN grid USING (product_id) JOIN unit_cost USING (product_id))
SELECT product_id, substr(CAST(product_id AS VARCHAR), 1, 30) || '...' AS product_id_short,
       product_category_name_english AS category,
       {rm(cp)} AS current_price_brl, {rm(cp + ' * 6.8')} AS current_price_thb,
       {rm(op)} AS optimal_price_brl, {rm(op + ' * 6.8')} AS optimal_price_thb,
       {rm(ch, 1)} AS price_change_pct,
       CAST(current_units AS BIGINT) AS current_demand, CAST(grid_demand AS BIGINT) AS expected_demand,
       CASE WHEN current_units > 0 THEN {rm(f'(grid_demand / (CAST(current_units AS DOUBLE) + 1e-6) - 1) * 100', 1)}
            ELSE 0.0 END AS demand_change_pct,
       {rm(cprof)} AS current_profit_brl, {rm(cprof + ' * 6.8')} AS current_profit_thb,
       {rm(mp)} AS expected_profit_brl, {rm(mp + ' * 6.8')} AS expected_profit_thb,
       {rm(f'{mp} - {cprof}')} AS profit_increase_brl, {rm(f'({mp} - {cprof}) * 6.8')} AS profit_increase_thb,
       CASE WHEN {cprof} > 0 THEN {rm(f'({mp} / ({cprof} + 1e-6) - 1) * 100', 1)} ELSE 0.0 END AS profit_increase_pct,
       {rec} AS recommendation, 'grid' AS method
FROM rep"""


@q("p8_optimization_report", _report_sql())
def p8_optimization_report(spark, d):
    from margincast.operators.pricing import optimization_report
    pr = _Price(spark, d)
    base = pr.base.join(pr.costs, "product_id")
    return optimization_report(base, _grid_best(pr))


@q("p9_profit_curve", _PRICE_SQL + f"""
SELECT product_id, k, {rm('price')} AS price_brl, {rm('price * 6.8')} AS price_thb,
       CAST(demand AS BIGINT) AS demand, {rm('profit')} AS profit_brl, {rm('profit * 6.8')} AS profit_thb FROM prof""")
def p9_profit_curve(spark, d):
    from margincast.operators.pricing import profit_curve
    return profit_curve(_Price(spark, d).profits())


@q("p10_optimization_summary", _PRICE_SQL + """
SELECT CAST(count(*) AS BIGINT) AS products,
       round(avg(grid_price / mean_price * 100 - 100), 4) AS avg_price_change_pct,
       round(sum(grid_profit), 2) AS total_profit
FROM grid JOIN bounds USING (product_id)""")
def p10_optimization_summary(spark, d):
    from margincast.operators.pricing import optimization_summary
    pr = _Price(spark, d)
    res = _grid_best(pr).join(pr.stats.withColumnRenamed("mean_price", "current_price"), "product_id")
    s = optimization_summary(res)
    return s.select("products", F.round("avg_price_change_pct", 4).alias("avg_price_change_pct"),
                    F.round("total_profit", 2).alias("total_profit"))


@q("p11_monotone_demand", _PRICE_SQL + """
SELECT product_id, k, round(price, 6) AS price,
       min(demand) OVER (PARTITION BY product_id ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS demand
FROM prof""")
def p11_monotone_demand(spark, d):
    from margincast.operators.pricing import monotone_demand
    m = monotone_demand(_Price(spark, d).profits())
    return m.select("product_id", "k", F.round("price", 6).alias("price"), "demand")


@q("p6_swarm_search")
def p6_swarm_search(spark, d):
    from margincast.operators.pricing import swarm_search
    pr = _Price(spark, d)
    base = pr.base.join(pr.costs, "product_id").join(pr.bounds(), "product_id")
    return swarm_search(base, pr.demand, particles=10, iters=30, seed=42, variant="b")


@q("p7_best_of")
def p7_best_of(spark, d):
    from margincast.operators.pricing import best_of, grid_search, price_candidates, score_candidates, swarm_search
    from margincast.session import reuse
    pr = _Price(spark, d)
    # both searches start from the same rows, one a product
    base = reuse(pr.base.join(pr.costs, "product_id").join(pr.bounds(), "product_id"))
    sw = swarm_search(base, pr.demand, particles=10, iters=30, seed=42, variant="b")
    grid = grid_search(score_candidates(price_candidates(base, 20), pr.demand, "b"))
    return best_of(grid, sw).select("product_id", "grid_price", "grid_profit", "swarm_price",
                                    "swarm_profit", "optimal_price", "max_profit", "method")


# =========================================================== M: metrics (closed-form demand as ŷ)

_PRED_SQL = _PRICE_SQL + f""",
test AS (SELECT * FROM pos WHERE p >= CAST(floor(n * 0.8) AS BIGINT)),
pred AS (SELECT t.product_id, CAST(t.{Q_} AS DOUBLE) AS y,
                m.demand_intercept + m.demand_slope * t.{P_} AS yhat
         FROM test t JOIN model m USING (product_id))"""


def _pred(spark, d):
    pr = _Price(spark, d)
    return pr.demand(pr.test).select("product_id", F.col(Q_).cast("double").alias("y"),
                                     F.col("prediction").alias("yhat"))


# a constant target has R² 1 when met exactly, else 0
_R2_SQL = ("CASE WHEN min(y) = max(y) THEN CASE WHEN sum((y - yhat) ^ 2) = 0 THEN 1.0 ELSE 0.0 END "
           "ELSE 1 - sum((y - yhat) ^ 2) / (count(*) * var_pop(y)) END")


@q("m8_metrics", _PRED_SQL + f"""
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(abs(y - yhat)), 6) AS mae, round(sqrt(avg((y - yhat) ^ 2)), 6) AS rmse,
       round({_R2_SQL}, 6) AS r2 FROM pred""")
def m8_metrics(spark, d):
    from margincast.operators.models import metrics
    return metrics(_pred(spark, d), "y", "yhat").withColumns(r6("mae", "rmse", "r2"))


@q("m9_mape", _PRED_SQL + """
SELECT round(avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) * 100, 6) AS mape_skip,
       round(avg(abs(y - yhat) / abs(CASE WHEN y = 0 THEN 1e-6 ELSE y END)) * 100, 6) AS mape_eps FROM pred""")
def m9_mape(spark, d):
    from margincast.operators.models import mape
    p = _pred(spark, d)
    a = mape(p, "y", "yhat", "skip").withColumnRenamed("mape", "mape_skip").withColumn("_k", F.lit(1))
    b = mape(p, "y", "yhat", "eps").withColumnRenamed("mape", "mape_eps").withColumn("_k", F.lit(1))
    return a.join(b, "_k").drop("_k").withColumns(r6("mape_skip", "mape_eps"))


@q("m15_residual_hist", _PRED_SQL + """,
res AS (SELECT y - yhat AS r FROM pred),
span AS (SELECT min(r) AS lo, max(r) AS hi FROM res),
binned AS (SELECT CAST(least(floor((r - lo) / ((hi - lo) / 99)), 98) AS INTEGER) AS bin FROM res, span)
SELECT CAST(b AS INTEGER) AS bin, CAST(coalesce(c, 0) AS BIGINT) AS count FROM range(99) t(b)
LEFT JOIN (SELECT bin, count(*) AS c FROM binned GROUP BY 1) ON bin = b""")
def m15_residual_hist(spark, d):
    from margincast.operators.models import residual_hist, residuals
    pts = residuals(_pred(spark, d), "y", "yhat")
    return residual_hist(pts, 100).select("bin", "count")


@q("m14_training_summary", _SERVICE_SQL + """,
spos AS (SELECT *, row_number() OVER (ORDER BY product_id, Date, seller_state_encoded) - 1 AS p,
                count(*) OVER () AS n FROM service)
SELECT CAST(count(*) AS BIGINT) AS data_size, CAST(count(DISTINCT product_id) AS BIGINT) AS num_products,
       CAST(count(DISTINCT product_category_name_english) AS BIGINT) AS num_categories,
       CAST(sum(CASE WHEN p < floor(n * 0.8) THEN 1 ELSE 0 END) AS BIGINT) AS train_samples,
       CAST(sum(CASE WHEN p >= floor(n * 0.8) THEN 1 ELSE 0 END) AS BIGINT) AS test_samples,
       20 AS num_features FROM spos""")
def m14_training_summary(spark, d):
    from margincast.operators.features import SERVICE_FEATURES
    from margincast.operators.models import training_summary
    from margincast.operators.splits import row_split
    sf = service_frame(spark, d)
    return training_summary(sf, row_split(sf, 0.8), SERVICE_FEATURES)


# =========================================================== X: scalar functions

@q("x1_cyclical", with_(*CUBE_CTES) + """
SELECT DISTINCT strftime(Date, '%Y-%m-%d') AS Date,
       round(sin(2 * pi() * month(Date) / 12), 6) AS month_sin, round(cos(2 * pi() * month(Date) / 12), 6) AS month_cos,
       round(sin(2 * pi() * weekofyear(Date) / 52), 6) AS week_sin,
       round(cos(2 * pi() * weekofyear(Date) / 52), 6) AS week_cos FROM cube""")
def x1_cyclical(spark, d):
    from margincast.functions.scalars import cyclical
    ms, mc = cyclical(F.month("Date"), 12)
    ws, wc = cyclical(F.weekofyear("Date"), 52)
    res = cube(spark, d).select("Date", ms.alias("month_sin"), mc.alias("month_cos"),
                                ws.alias("week_sin"), wc.alias("week_cos")).distinct()
    return out(res.withColumns(r6("month_sin", "month_cos", "week_sin", "week_cos")))


@q("x2_discount", _win_sql(f"""
  round((avg({P_}) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) - {P_})
        / (avg({P_}) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) + 1e-6), 6) AS discount_pct,
  CAST(CASE WHEN (avg({P_}) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) - {P_})
        / (avg({P_}) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) + 1e-6) > 0.05 THEN 1 ELSE 0 END AS INTEGER)
    AS is_discounted"""))
def x2_discount(spark, d):
    from margincast.functions.scalars import discount_pct, is_discounted
    from margincast.operators.windows import rolling
    cb = cube(spark, d).withColumn("_r", rolling(P_, 4, "mean", False))
    res = cb.select("product_id", "seller_state_encoded", "Date",
                    discount_pct("_r", P_).alias("discount_pct"),
                    is_discounted(discount_pct("_r", P_)).alias("is_discounted"))
    return out(res.withColumns(r6("discount_pct")))


@q("x3_interactions", _BATCH_SQL + f"""
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date,
       category_encoded * IsWeekend AS cat_x_weekend,
       round({P_}_Lag_1 * sin(2 * pi() * Month / 12), 6) + 0.0 AS pricelag1_x_monthsin,
       {Q_}_Lag_1 * seller_state_encoded AS qtylag1_x_state FROM batch""")
def x3_interactions(spark, d):
    from margincast.functions.scalars import cyclical
    b = batch_frame(spark, d)
    res = b.select("product_id", "seller_state_encoded", "Date",
                   (F.col("category_encoded") * F.col("IsWeekend")).alias("cat_x_weekend"),
                   (F.col(f"{P_}_Lag_1") * cyclical("Month", 12)[0]).alias("pricelag1_x_monthsin"),
                   (F.col(f"{Q_}_Lag_1") * F.col("seller_state_encoded")).alias("qtylag1_x_state"))
    return out(res.withColumn("pricelag1_x_monthsin", F.round("pricelag1_x_monthsin", 6) + F.lit(0.0)))


@q("x4_x5_currency", with_(*CUBE_CTES) + f"""
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date,
       {rm(P_)} AS price_brl, {rm(P_ + ' * 6.8')} AS price_thb, {rm(P_, 1)} AS price_1dp FROM cube""")
def x4_x5_currency(spark, d):
    from margincast.functions.scalars import round_half_up, to_currency
    return out(cube(spark, d).select("product_id", "seller_state_encoded", "Date",
                                     round_half_up(P_, 2).alias("price_brl"),
                                     round_half_up(to_currency(P_), 2).alias("price_thb"),
                                     round_half_up(P_, 1).alias("price_1dp")))


@q("x6_x9_units_log", _win_sql(f"""
  greatest(0.0, round_even(avg({Q_}) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0)) AS units_from_roll,
  round(ln(1 + {Q_}), 6) AS log_units, round(exp(ln(1 + {Q_})) - 1, 6) AS units_back"""))
def x6_x9_units_log(spark, d):
    from margincast.functions.scalars import as_units, from_log_target, log_target
    from margincast.operators.windows import rolling
    return _win(spark, d, {"units_from_roll": as_units(rolling(Q_, 4, "mean", False)),
                           "log_units": log_target(Q_), "units_back": from_log_target(log_target(Q_))},
                ("log_units", "units_back"))


@q("x7_x8_change_revenue", with_(*CUBE_CTES) + f"""
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date,
       round({Q_} * {P_}, 6) AS revenue,
       round(({P_} / (Weight_g_Mean + 1e-6) - 1) * 100, 6) AS pct_vs_weight FROM cube""")
def x7_x8_change_revenue(spark, d):
    from margincast.functions.scalars import pct_change, revenue
    res = cube(spark, d).select("product_id", "seller_state_encoded", "Date",
                                revenue(Q_, P_).alias("revenue"),
                                pct_change(P_, "Weight_g_Mean").alias("pct_vs_weight"))
    return out(res.withColumns(r6("revenue", "pct_vs_weight")))


@q("x10_linspace", _PRICE_SQL + """
SELECT product_id, CAST(count(*) AS BIGINT) AS n, round(min(price), 6) AS first_price, round(max(price), 6) AS last_price
FROM cand GROUP BY 1""")
def x10_linspace(spark, d):
    c = _Price(spark, d).candidates()
    return c.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("price"), 6).alias("first_price"),
                                       F.round(F.max("price"), 6).alias("last_price"))


@q("x11_short_id", with_(*CUBE_CTES) + """
SELECT DISTINCT substr(CAST(product_id AS VARCHAR), 1, 3) || '...' AS short_id,
       starts_with(lower(product_category_name_english), 'fashion_') AS family FROM cube""")
def x11_short_id(spark, d):
    from margincast.functions.scalars import has_prefix, short_id
    return cube(spark, d).select(short_id("product_id", 3).alias("short_id"),
                                 has_prefix(CAT, "fashion_").alias("family")).distinct()


@q("x12_recommendation", _report_sql().replace(
    "SELECT product_id, substr(CAST(product_id AS VARCHAR), 1, 30) || '...' AS product_id_short,",
    "SELECT recommendation, CAST(count(*) AS BIGINT) AS products FROM (SELECT product_id, "
    "substr(CAST(product_id AS VARCHAR), 1, 30) || '...' AS product_id_short,") + ") GROUP BY 1")
def x12_recommendation(spark, d):
    return p8_optimization_report(spark, d).groupBy("recommendation").agg(F.count(F.lit(1)).alias("products"))


@q("x13_verdicts", _PRED_SQL + f""",
m AS (SELECT {_R2_SQL} AS r2,
             avg(CASE WHEN y <> 0 THEN abs(y - yhat) / abs(y) END) * 100 AS mape FROM pred)
SELECT CASE WHEN r2 > 0.8 THEN 'excellent' WHEN r2 > 0.7 THEN 'good' WHEN r2 > 0.6 THEN 'fair' ELSE 'poor' END AS r2_verdict,
       CASE WHEN mape IS NULL THEN NULL WHEN mape < 20 THEN 'good' ELSE 'improve' END AS mape_verdict FROM m""")
def x13_verdicts(spark, d):
    from margincast.functions.scalars import mape_verdict, r2_verdict
    from margincast.operators.models import mape, metrics
    p = _pred(spark, d)
    m = metrics(p, "y", "yhat").withColumn("_k", F.lit(1)).join(mape(p, "y", "yhat").withColumn("_k", F.lit(1)), "_k")
    return m.select(r2_verdict("r2").alias("r2_verdict"), mape_verdict("mape").alias("mape_verdict"))


@q("e6_standard_scale", _PRICE_SQL + f""",
st AS (SELECT avg({P_}) AS m1, stddev_pop({P_}) AS s1, avg(Weight_g_Mean) AS m2, stddev_pop(Weight_g_Mean) AS s2 FROM train)
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date,
       round(({P_} - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END, 6) AS price_scaled,
       round((Weight_g_Mean - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END, 6) AS weight_scaled
FROM pos, st WHERE p >= CAST(floor(n * 0.8) AS BIGINT)""")
def e6_standard_scale(spark, d):
    from margincast.operators.splits import row_split, scale, scale_stats
    feats = row_split(batch_frame(spark, d), 0.8)
    train, test = feats.where("is_train"), feats.where(~F.col("is_train"))
    st = scale_stats(train, [P_, "Weight_g_Mean"])
    sc = scale(test, st, "_s").select("product_id", "seller_state_encoded", "Date",
                                      F.col(f"{P_}_s").alias("price_scaled"),
                                      F.col("Weight_g_Mean_s").alias("weight_scaled"))
    return out(sc.withColumns(r6("price_scaled", "weight_scaled")))


# =========================================================== M: model fits (rows-only checks)
# Fits run at the full settings of demand_model().  Only the swarm queries, which score
# every particle in every iteration, use the smaller trees below (README: figures).

_SMALL = {"gbt_a": dict(maxIter=10, maxDepth=4), "gbt_b": dict(maxIter=10, maxDepth=4),
          "rf": dict(numTrees=10, maxDepth=6), "linear": {}}


# rows a task of a boosted fit: its hundreds of passes cost a job each, whose every task sends
# the bins of all nodes, while a row keeps its binned features only.  Forests keep a count
# and a node per tree and row, so theirs stay at ``spread``'s default.
_BOOSTED_ROWS = 1_000_000


class _Fit:
    """The split frame for model fits.  ``feats``: the frame, where a query has it already.
    The test side is dealt out only when a query reads it."""

    def __init__(self, spark, d, feats=None, rows_per_partition=200_000):
        self._rows = rows_per_partition
        from margincast.operators.features import SAFE_BATCH_FEATURES
        from margincast.operators.splits import row_split
        self._feats = row_split(batch_frame(spark, d), 0.8).checkpoint(eager=True) if feats is None else feats
        self.cols = SAFE_BATCH_FEATURES
        self.train = self._side(F.col("is_train"))

    def _side(self, rows):
        from margincast.session import spread
        return spread(self._feats.where(rows).drop("is_train"), ["product_id", "Date", "seller_state_encoded"],
                      rows_per_partition=self._rows)

    @cached_property
    def test(self):
        return self._side(~F.col("is_train"))

    def pipeline(self, kind, small=False):
        from margincast.operators.models import demand_model
        return demand_model(kind, self.cols, **(_SMALL[kind] if small else {}))


def _fit_query(kind):
    def run(spark, d):
        from margincast.operators.models import metrics, predict
        f = _Fit(spark, d, rows_per_partition=_BOOSTED_ROWS) if kind.startswith("gbt") else _Fit(spark, d)
        m = f.pipeline(kind).fit(f.train)
        return metrics(predict(m, f.test)).withColumn("model", F.lit(kind))
    return run


for _k, _id in (("gbt_a", "m1_gbt_leafwise"), ("gbt_b", "m2_gbt_subsampled"), ("rf", "m3_random_forest"),
                ("linear", "m4_linear_regression")):
    REGISTRY[_id] = (_fit_query(_k), None)


def _search(spark, d, kind, space, n, folds, fixed=None):
    import uuid
    from margincast.operators.models import resumable_search
    from margincast.session import ensure_checkpoint_dir
    f = _Fit(spark, d)
    path = f"{ensure_checkpoint_dir(spark)}/search/{uuid.uuid4().hex}"
    found = resumable_search(f.pipeline(kind), space, f.train, path, n=n, folds=folds, seed=42, parallelism=4,
                             key_cols=["product_id", "Date", "seller_state_encoded"], fixed=fixed)
    return found.select("draw", F.col("folds").cast("int").alias("folds"), F.col("r2_mean").isNotNull().alias("scored"),
                        F.col("r2_std").isNotNull().alias("spread_known"))


def _search_sql(n, folds):
    return (f"SELECT CAST(range AS INTEGER) AS draw, {folds}::INTEGER AS folds, true AS scored, true AS spread_known FROM range({n})")


@q("m5_random_search", _search_sql(20, 3))
def m5_random_search(spark, d):
    """The whole search: 20 draws from the forest space, 3 folds each."""
    from margincast.operators.models import RF_SPACE
    return _search(spark, d, "rf", RF_SPACE, 20, 3)


@q("m6_log_target_model")
def m6_log_target_model(spark, d):
    from margincast.operators.models import LogTargetModel, metrics
    f = _Fit(spark, d, rows_per_partition=_BOOSTED_ROWS)
    m = LogTargetModel(f.pipeline("gbt_a")).fit(f.train)
    return metrics(m.transform(f.test))


@q("m7_predict")
def m7_predict(spark, d):
    from margincast.operators.models import predict
    f = _Fit(spark, d)
    m = f.pipeline("linear").fit(f.train)
    return predict(m, f.test).select("product_id", "Date", Q_, "prediction").transform(out)


@q("m10_model_leaderboard")
def m10_model_leaderboard(spark, d):
    from margincast.operators.models import compare
    f = _Fit(spark, d)
    board, _ = compare({k: f.pipeline(k) for k in ("gbt_a", "rf", "linear")}, f.train, f.test)
    return board.drop("train_time_sec")


@q("m11_cross_validate")
def m11_cross_validate(spark, d):
    from margincast.operators.models import cross_validate
    f = _Fit(spark, d)
    return cross_validate(f.pipeline("linear"), f.train.select(*f.cols, Q_, "product_id"), k=3, n=10000, seed=42)


@q("m12_sample_n")
def m12_sample_n(spark, d):
    from margincast.operators.splits import sample_n
    return out(sample_n(cube(spark, d), 5000, seed=42, key_cols=["product_id", "Date", "seller_state_encoded"]))


@q("m13_feature_importance")
def m13_feature_importance(spark, d):
    from margincast.operators.models import importance
    f = _Fit(spark, d)
    return importance(f.pipeline("rf").fit(f.train), f.cols, 10)


@q("e5_assemble", _PRICE_SQL + """
SELECT product_id, CAST(20 AS INTEGER) AS width, CAST(QuantitySold AS DOUBLE) AS label FROM train""")
def e5_assemble(spark, d):
    from margincast.operators.splits import assemble
    f = _Fit(spark, d)
    a = assemble(f.train, f.cols)
    from pyspark.ml.functions import vector_to_array
    return a.select("product_id", F.size(vector_to_array("features")).alias("width"), "label")


@q("s3_model_store")
def s3_model_store(spark, d):
    import uuid
    from margincast.session import ensure_checkpoint_dir
    from margincast.sources.model_store import load_model, save_model
    f = _Fit(spark, d)
    m = f.pipeline("linear").fit(f.train)
    path = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    save_model(m, path, spark, f.cols)
    loaded, feats = load_model(path, spark)
    n_feats = feats.count()
    return (loaded.transform(f.test).select("product_id", "prediction")
            .withColumn("n_features", F.lit(n_feats)))


_STORE_COLS = {"product_id": "product_encoded", CAT: "category_encoded"}


@q("s3e_stored_encoders", with_(*CUBE_CTES) + """,
dates AS (SELECT Date, row_number() OVER (ORDER BY Date) AS rn, count(*) OVER () AS n
          FROM (SELECT DISTINCT Date FROM cube)),
split AS (SELECT Date AS split_date FROM dates WHERE rn = CAST(floor(n * 0.8) AS BIGINT) + 1),
prods AS (SELECT product_id, CAST(dense_rank() OVER (ORDER BY product_id) - 1 AS INTEGER) AS product_encoded
          FROM (SELECT DISTINCT product_id FROM cube, split WHERE Date < split_date)),
cats AS (SELECT c AS product_category_name_english, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS category_encoded
         FROM (SELECT DISTINCT product_category_name_english AS c FROM cube, split WHERE Date < split_date))
SELECT cube.product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date,
       coalesce(product_encoded, -1) AS product_encoded, coalesce(category_encoded, -1) AS category_encoded,
       true AS same_prediction
FROM cube JOIN split ON Date >= split_date LEFT JOIN prods ON prods.product_id = cube.product_id
LEFT JOIN cats ON cats.product_category_name_english = cube.product_category_name_english""")
def s3e_stored_encoders(spark, d):
    """Encoders and model fitted on the train weeks, stored, loaded, and used on
    the later weeks, which hold products that the dictionary has not seen."""
    import uuid
    from margincast.operators.models import demand_model
    from margincast.operators.splits import date_split
    from margincast.session import ensure_checkpoint_dir
    from margincast.sources.model_store import encode, fit_encoders, load_encoders, load_model, save_model
    frame = date_split(cube(spark, d), 0.8)
    train, new = frame.where("is_train"), frame.where("not is_train")
    fitted = fit_encoders(train, _STORE_COLS, unseen="code")
    cols = [*_STORE_COLS.values(), "seller_state_encoded", P_]
    model = demand_model("linear", cols).fit(encode(train, fitted))
    path = f"{ensure_checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    save_model(model, path, spark, cols, fitted)
    loaded, _ = load_model(path, spark)
    keys = ["product_id", "seller_state_encoded", "Date"]
    again = loaded.transform(encode(new, load_encoders(path, spark)))
    first = model.transform(encode(new, fitted)).select(*keys, F.col("prediction").alias("_first"))
    return out(again.join(first, keys).select(*keys, *_STORE_COLS.values(),
                                              (F.col("prediction") == F.col("_first")).alias("same_prediction")))


@q("p10m_profit_by_model")
def p10m_profit_by_model(spark, d):
    """A23 / P10 per model: grid search with each fitted demand model, all of ``MODEL_SETTINGS``."""
    from functools import reduce
    from margincast.operators.dashboard import profit_total
    from margincast.operators.models import MODEL_SETTINGS
    from margincast.operators.pricing import ModelDemand, grid_search, price_candidates, score_candidates
    from margincast.session import spread
    pr = _Price(spark, d)
    f = _Fit(spark, d, pr.feats)
    # every product is scored at 20 prices: dealt out by what the candidates cost, not by the size of the base rows
    base = spread(pr.base.join(pr.costs, "product_id").join(pr.bounds(), "product_id").checkpoint(eager=True), ["product_id"], 100, 20_000)
    parts = []
    for kind in MODEL_SETTINGS:
        scorer = ModelDemand(f.pipeline(kind).fit(f.train), drop=("features_raw", "features"))
        g = grid_search(score_candidates(price_candidates(base, 20), scorer, "b"))
        parts.append(g.select("product_id", F.col("grid_profit").alias("max_profit"), F.lit(kind).alias("model")))
    return profit_total(reduce(DataFrame.unionByName, parts))


def _swarm_facts(base, scorer, swarm, variant):
    """Per product: the found price lies within its bounds, its profit is what
    the demand model gives at that price, and it is no worse than both ends."""
    from margincast.operators.pricing import score_candidates
    found = base.join(swarm, "product_id")
    at = lambda c: score_candidates(found.withColumn("price", F.col(c)), scorer, variant).select(
        "product_id", F.col("profit").alias(f"at_{c}"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 1e-6 * (1 + F.abs(F.col(b)))
    j = found.join(at("swarm_price"), "product_id").join(at("lower"), "product_id").join(at("upper"), "product_id")
    return j.select("product_id", F.col("swarm_price").between(F.col("lower"), F.col("upper")).alias("within_bounds"),
                    near("swarm_profit", "at_swarm_price").alias("profit_at_price"),
                    (F.col("swarm_profit") >= F.least("at_lower", "at_upper") - 1e-6).alias("no_worse_than_ends"))


_SWARM_FACTS_SQL = "\nSELECT product_id, true AS within_bounds, true AS profit_at_price, true AS no_worse_than_ends FROM "


@q("p6m_swarm_tree_model", _PRICE_SQL + _SWARM_FACTS_SQL + "stats")
def p6m_swarm_tree_model(spark, d):
    """The batch run's swarm (10 x 30) for every product over a boosted-tree model."""
    from margincast.operators.pricing import ModelDemand, swarm_search
    pr = _Price(spark, d)
    f = _Fit(spark, d, pr.feats)
    scorer = ModelDemand(f.pipeline("gbt_a", small=True).fit(f.train), drop=("features_raw", "features"))
    base = pr.base.join(pr.costs, "product_id").join(pr.bounds(), "product_id").checkpoint(eager=True)
    swarm = swarm_search(base, scorer, particles=10, iters=30, seed=42, variant="b").checkpoint(eager=True)
    return _swarm_facts(base, scorer, swarm, "b")


@q("p6w_swarm_service_model", _SERVICE_SQL + _SWARM_FACTS_SQL + "(SELECT DISTINCT product_id FROM service)")
def p6w_swarm_service_model(spark, d):
    """The service's swarm (30 x 50, bounds of 30 % around the current price)
    over a boosted-tree model of the service features."""
    from margincast.operators.features import SERVICE_FEATURES
    from margincast.operators.models import demand_model
    from margincast.operators.pricing import ModelDemand, base_rows, price_bounds, swarm_search
    from margincast.session import spread
    frame = spread(service_frame(spark, d).checkpoint(eager=True), ["product_id", "Date", "seller_state_encoded"],
                   rows_per_partition=_BOOSTED_ROWS)
    scorer = ModelDemand(demand_model("gbt_b", SERVICE_FEATURES, **_SMALL["gbt_b"]).fit(frame), drop=("features_raw", "features"))
    base = price_bounds(base_rows(frame).withColumn("cost", F.lit(10.0)), "current", price_range=0.3).checkpoint(eager=True)
    swarm = swarm_search(base, scorer, particles=30, iters=50, seed=42, variant="a").checkpoint(eager=True)
    return _swarm_facts(base, scorer, swarm, "a")


@q("p10s_prices_by_model", _PRICE_SQL + """
SELECT m.model, product_id, true AS best_of_both, true AS within_bounds
FROM stats, (VALUES ('linear'), ('gbt_a')) m(model)""")
def p10s_prices_by_model(spark, d):
    """Optimal price and profit of every product under every fitted model, grid
    against swarm; the facts are checked per row, ``max_profit`` and
    ``optimal_price`` are in ``prices_by_model``."""
    r = _prices_by_model(spark, d)
    return r.select("model", "product_id",
                    (F.col("max_profit") == F.greatest("grid_profit", "swarm_profit")).alias("best_of_both"),
                    F.col("optimal_price").between(F.col("lower") - 1e-9, F.col("upper") + 1e-9).alias("within_bounds"))


def _prices_by_model(spark, d):
    from margincast.operators.pricing import ModelDemand, prices_by_model
    from margincast.session import spread
    pr = _Price(spark, d)
    f = _Fit(spark, d, pr.feats)
    scorers = {k: ModelDemand(f.pipeline(k, small=True).fit(f.train), drop=("features_raw", "features")) for k in ("linear", "gbt_a")}
    base = spread(pr.base.join(pr.costs, "product_id").join(pr.bounds(), "product_id").checkpoint(eager=True), ["product_id"], 100, 20_000)
    return prices_by_model(base, scorers, particles=10, iters=30, seed=42, variant="b")


# =========================================================== E4 / J9: dense frame

_DW = "PARTITION BY product_id ORDER BY Date, seller_state_encoded"
_DENSE_REQUIRED = ["Qty_Lag_1", "Price_Lag_1", "Qty_Roll_Mean_4", "Price_Roll_Mean_4", "Qty_Lag_2", "Qty_Lag_52",
                   "Qty_Roll_Std_4", "Qty_Roll_Mean_12", "Qty_Lag_3", "Qty_Lag_4", "Qty_Lag_8", "Price_Lag_2",
                   "Qty_Roll_Mean_8", "Qty_Roll_Std_8", "Qty_Roll_Max_8", "Price_Roll_Mean_8", "Qty_Roll_Max_4",
                   "Qty_Roll_Max_12", "Discount_Pct_Approx", "Cat_x_Weekend", "PriceLag1_x_MonthSin",
                   "QtyLag1_x_SellerState"]
_DENSE_ROUND = ["Month_Sin", "Month_Cos", "Week_Sin", "Week_Cos", "Qty_Roll_Mean_4", "Price_Roll_Mean_4",
                "Qty_Roll_Std_4", "Qty_Roll_Mean_12", "Qty_Roll_Mean_8", "Qty_Roll_Std_8", "Price_Roll_Mean_8",
                "Discount_Pct_Approx", "PriceLag1_x_MonthSin"]


def _prev(fn: str, c: str, n: int) -> str:
    return f"{fn}({c}) OVER ({_DW} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _dfill(c: str, default: str | None = None) -> str:
    tail = f", {default}" if default else ""
    return (f"coalesce(last_value({c} IGNORE NULLS) OVER ({_DW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) OVER ({_DW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING){tail})")


_DENSE_FEATURES_SQL = with_(*ALL_CUBE_CTES) + _DENSE_SQL + f""",
dfill0 AS (SELECT product_id, product_category_name_english, seller_state_encoded, Date, QuantitySold,
                  {_dfill(P_)} AS {P_}, {", ".join(f"{_dfill(c, '0.0')} AS {c}" for c in _DIMS)} FROM dense),
dfill AS (SELECT * REPLACE (coalesce({P_}, (SELECT avg({P_}) FROM dfill0)) AS {P_}) FROM dfill0),
dcats AS (SELECT c AS product_category_name_english,
                 CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS category_encoded
          FROM (SELECT DISTINCT product_category_name_english AS c FROM cube_all)),
{holidays_sql('cube_all', 'dhol').strip()},
dhw AS (SELECT DISTINCT CAST(year(holiday_date) AS INTEGER) AS hy, CAST(weekofyear(holiday_date) AS INTEGER) AS hw
        FROM dhol),
dcal AS (SELECT f.*, category_encoded, CAST(year(Date) AS INTEGER) AS Year, CAST(month(Date) AS INTEGER) AS Month,
                CAST(weekofyear(Date) AS INTEGER) AS Week, CAST(quarter(Date) AS INTEGER) AS Quarter,
                CAST(isodow(Date) - 1 AS INTEGER) AS DayOfWeek,
                CAST(CASE WHEN isodow(Date) - 1 IN (5, 6) THEN 1 ELSE 0 END AS INTEGER) AS IsWeekend
         FROM dfill f JOIN dcats USING (product_category_name_english)),
dhf AS (SELECT c.*, CAST(CASE WHEN h.hy IS NULL THEN 0 ELSE 1 END AS INTEGER) AS IsHolidayWeek
        FROM dcal c LEFT JOIN dhw h ON c.Year = h.hy AND c.Week = h.hw),
dfe AS (SELECT * REPLACE (CAST(Week AS DOUBLE) AS Week),
               sin(2 * pi() * Month / 12) AS Month_Sin, cos(2 * pi() * Month / 12) AS Month_Cos,
               sin(2 * pi() * CAST(Week AS DOUBLE) / 52) AS Week_Sin, cos(2 * pi() * CAST(Week AS DOUBLE) / 52) AS Week_Cos,
               {", ".join(f"lag({Q_}, {k}) OVER ({_DW}) AS Qty_Lag_{k}" for k in (1, 2, 3, 4, 8, 52))},
               lag({P_}, 1) OVER ({_DW}) AS Price_Lag_1, lag({P_}, 2) OVER ({_DW}) AS Price_Lag_2,
               {_prev('avg', Q_, 4)} AS Qty_Roll_Mean_4, {_prev('avg', P_, 4)} AS Price_Roll_Mean_4,
               {_prev('stddev_samp', Q_, 4)} AS Qty_Roll_Std_4, {_prev('avg', Q_, 12)} AS Qty_Roll_Mean_12,
               {_prev('avg', Q_, 8)} AS Qty_Roll_Mean_8, {_prev('stddev_samp', Q_, 8)} AS Qty_Roll_Std_8,
               {_prev('max', Q_, 8)} AS Qty_Roll_Max_8, {_prev('avg', P_, 8)} AS Price_Roll_Mean_8,
               {_prev('max', Q_, 4)} AS Qty_Roll_Max_4, {_prev('max', Q_, 12)} AS Qty_Roll_Max_12
        FROM dhf),
dfe2 AS (SELECT *, {P_} - Price_Lag_1 AS Price_Diff_Lag_1,
                (Price_Roll_Mean_4 - {P_}) / (Price_Roll_Mean_4 + 1e-6) AS Discount_Pct_Approx FROM dfe),
dfe3 AS (SELECT *, CAST(CASE WHEN Discount_Pct_Approx > 0.05 THEN 1 ELSE 0 END AS INTEGER) AS Is_Discounted_Approx,
                category_encoded * IsWeekend AS Cat_x_Weekend,
                coalesce(Price_Lag_1, 0.0) * Month_Sin AS PriceLag1_x_MonthSin,
                coalesce(Qty_Lag_1, 0) * seller_state_encoded AS QtyLag1_x_SellerState FROM dfe2),
dreq AS (SELECT * FROM dfe3 WHERE {" AND ".join(f"{c} IS NOT NULL" for c in _DENSE_REQUIRED)}),
dense_final AS (SELECT * FROM (SELECT *, sum({Q_}) OVER (PARTITION BY product_id) AS _tot FROM dreq) WHERE _tot > 5)"""


@q("e4_dense_features", _DENSE_FEATURES_SQL + f"""
SELECT * EXCLUDE (_tot) REPLACE (strftime(Date, '%Y-%m-%d') AS Date,
       {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _DENSE_ROUND)}) FROM dense_final""")
def e4_dense_features(spark, d):
    from margincast.operators.features import dense_features
    return out(dense_features(cube(spark, d, family=False), rounded=dict.fromkeys(_DENSE_ROUND, 6)))


@q("f9_dense_required", _DENSE_FEATURES_SQL + """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT product_id) AS BIGINT) AS products,
       CAST(sum(CASE WHEN seller_state_encoded = -1 THEN 1 ELSE 0 END) AS BIGINT) AS zero_weeks FROM dense_final""")
def f9_dense_required(spark, d):
    from margincast.operators.features import dense_features
    df = dense_features(cube(spark, d, family=False))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("product_id").alias("products"),
                  F.sum((F.col("seller_state_encoded") == -1).cast("long")).alias("zero_weeks"))


@q("j9_holiday_weeks", with_(*CUBE_CTES, holidays_sql("cube")) + """,
hw AS (SELECT DISTINCT CAST(year(holiday_date) AS INTEGER) AS Year, CAST(weekofyear(holiday_date) AS INTEGER) AS Week FROM hol),
cal AS (SELECT DISTINCT Date, CAST(year(Date) AS INTEGER) AS Year, CAST(weekofyear(Date) AS INTEGER) AS Week FROM cube)
SELECT strftime(Date, '%Y-%m-%d') AS Date, Year, Week,
       CAST(CASE WHEN hw.Year IS NULL THEN 0 ELSE 1 END AS INTEGER) AS IsHolidayWeek
FROM cal LEFT JOIN hw USING (Year, Week)""")
def j9_holiday_weeks(spark, d):
    from margincast.operators.features import holiday_week_flag
    cal = cube(spark, d).select("Date", F.year("Date").alias("Year"), F.weekofyear("Date").alias("Week")).distinct()
    return out(holiday_week_flag(cal).select("Date", "Year", "Week", "IsHolidayWeek"))


@q("w8g_global_bfill", with_(*CUBE_CTES) + f""",
ff AS (SELECT *, last_value(Height_cm_Mean IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h
       FROM cube)
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date,
       first_value(h IGNORE NULLS) OVER (ORDER BY product_id, Date, seller_state_encoded
                                         ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS height_global
FROM ff""")
def w8g_global_bfill(spark, d):
    from margincast.operators.windows import fill_within_product
    cb = cube(spark, d)
    f = fill_within_product(cb, ["Height_cm_Mean"], scope="global")
    return out(f.select("product_id", "seller_state_encoded", "Date",
                        F.col("Height_cm_Mean").alias("height_global")))


# =========================================================== T1 / F12 / service-style price report

@q("t1_total_order", with_(*CUBE_CTES) + """
SELECT product_id, strftime(Date, '%Y-%m-%d') AS Date, seller_state_encoded,
       CAST(row_number() OVER (PARTITION BY product_id ORDER BY Date, seller_state_encoded) AS INTEGER) AS seq
FROM cube""")
def t1_total_order(spark, d):
    from margincast.operators.windows import by_product
    cb = cube(spark, d)
    return out(cb.select("product_id", "Date", "seller_state_encoded",
                         F.row_number().over(by_product()).alias("seq")))


@q("f12_last_train_week", with_(*CUBE_CTES) + """,
dates AS (SELECT Date, row_number() OVER (ORDER BY Date) AS rn, count(*) OVER () AS n
          FROM (SELECT DISTINCT Date FROM cube)),
split AS (SELECT Date AS split_date FROM dates WHERE rn = CAST(floor(n * 0.8) AS BIGINT) + 1),
train AS (SELECT * FROM cube WHERE Date < (SELECT split_date FROM split))
SELECT product_id, seller_state_encoded, strftime(Date, '%Y-%m-%d') AS Date, QuantitySold
FROM train WHERE Date = (SELECT max(Date) FROM train)""")
def f12_last_train_week(spark, d):
    from margincast.operators.splits import date_split
    train = date_split(cube(spark, d), 0.8).where("is_train").drop("is_train")
    last = train.agg(F.max("Date").alias("m")).first()["m"]
    return out(train.where(F.col("Date") == F.lit(last))
               .select("product_id", "seller_state_encoded", "Date", "QuantitySold"))


_SERVICE_PRICE_SQL = _SERVICE_SQL + f""",
spos AS (SELECT *, row_number() OVER (ORDER BY product_id, Date, seller_state_encoded) - 1 AS p,
                count(*) OVER () AS n FROM service),
strain AS (SELECT * FROM spos WHERE p < CAST(floor(n * 0.8) AS BIGINT)),
slatest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id
                           ORDER BY Date DESC, seller_state_encoded DESC) AS rn FROM service) WHERE rn = 1),
scoef AS (SELECT product_id, regr_slope(CAST({Q_} AS DOUBLE), {P_}) AS b,
                 regr_intercept(CAST({Q_} AS DOUBLE), {P_}) AS a, avg(CAST({Q_} AS DOUBLE)) AS mu
          FROM strain GROUP BY 1),
spooled AS (SELECT regr_slope(CAST({Q_} AS DOUBLE), {P_}) AS pb, regr_intercept(CAST({Q_} AS DOUBLE), {P_}) AS pa,
                   avg(CAST({Q_} AS DOUBLE)) AS pmu FROM strain),
smodel AS (SELECT product_id, CASE WHEN mu IS NULL THEN coalesce(pb, 0.0) ELSE coalesce(b, 0.0) END AS sl,
                  CASE WHEN mu IS NOT NULL THEN CASE WHEN b IS NULL THEN mu ELSE a END
                       WHEN pb IS NULL THEN pmu ELSE pa END AS ic
           FROM slatest LEFT JOIN scoef USING (product_id), spooled),
scand AS (SELECT product_id, CAST(k AS INTEGER) AS k, {P_} AS cur, {Q_} AS cur_units,
                 CASE WHEN k = 19 THEN {P_} * 1.3
                      ELSE CAST(k AS DOUBLE) * (({P_} * 1.3 - {P_} * (1 - 0.3)) / 19.0) + {P_} * (1 - 0.3) END AS price
          FROM slatest, range(20) t(k)),
sprof AS (SELECT c.*, greatest(0.0, round_even(ic + sl * price, 0)) AS demand FROM scand c
          JOIN smodel USING (product_id)),
sbest AS (SELECT * FROM (SELECT *, (price - 10.0) * demand AS profit,
                 row_number() OVER (PARTITION BY product_id ORDER BY (price - 10.0) * demand DESC, price) AS r
                 FROM sprof) WHERE r = 1)"""


@q("p1s_service_price_search", _SERVICE_PRICE_SQL + f"""
SELECT product_id, {rm('cur')} AS current_price_brl, {rm('price')} AS optimal_price_brl,
       CAST(demand AS BIGINT) AS expected_demand, {rm('profit')} AS expected_profit_brl,
       {rm('(price / (cur + 1e-6) - 1) * 100', 1)} AS price_change_pct FROM sbest""")
def p1s_service_price_search(spark, d):
    """The service flow for every product at once: latest row of the
    service frame, bounds = current price × [0.7, 1.3], default unit cost,
    linear demand fitted on the positional train split (products it lacks: the
    line of all its rows), grid argmax."""
    from margincast.functions.scalars import pct_change, round_half_up
    from margincast.operators.pricing import (DEFAULT_COST, LinearDemand, grid_search, price_bounds,
                                              price_candidates, score_candidates)
    from margincast.operators.splits import row_split
    from margincast.operators.windows import latest_rows
    from margincast.session import reuse
    sf = reuse(service_frame(spark, d))
    train = row_split(sf, 0.8).where("is_train")
    base = latest_rows(sf).withColumns({"current_price": F.col(P_), "current_units": F.col(Q_),
                                        "cost": F.lit(DEFAULT_COST)})
    cand = price_candidates(price_bounds(base, "current", price_range=0.3), 20)
    best = grid_search(score_candidates(cand, LinearDemand(train), "a"))
    j = base.select("product_id", "current_price").join(best, "product_id")
    return j.select("product_id", round_half_up("current_price").alias("current_price_brl"),
                    round_half_up("grid_price").alias("optimal_price_brl"),
                    F.col("grid_demand").cast("long").alias("expected_demand"),
                    round_half_up("grid_profit").alias("expected_profit_brl"),
                    round_half_up(pct_change("grid_price", "current_price"), 1).alias("price_change_pct"))


@q("j7c_densify_collapsed", with_(*ALL_CUBE_CTES) + """,
coll AS (SELECT product_id, product_category_name_english, Date, CAST(sum(QuantitySold) AS BIGINT) AS q,
                sum(AverageSellingPrice * QuantitySold) / sum(QuantitySold) AS p FROM cube_all GROUP BY 1, 2, 3),
span AS (SELECT min(Date) AS lo, max(Date) AS hi FROM coll),
prods AS (SELECT DISTINCT product_id FROM coll),
grid AS (SELECT p.product_id, CAST(w.wk AS DATE) AS Date
         FROM prods p, span, LATERAL (SELECT unnest(generate_series(span.lo, span.hi, INTERVAL 7 DAY)) AS wk) w)
SELECT g.product_id, strftime(g.Date, '%Y-%m-%d') AS Date, CAST(coalesce(c.q, 0) AS BIGINT) AS QuantitySold,
       round(c.p, 6) AS AverageSellingPrice
FROM grid g LEFT JOIN coll c ON g.product_id = c.product_id AND g.Date = c.Date""")
def j7c_densify_collapsed(spark, d):
    dn = C.densify(C.collapse_regions(cube(spark, d, family=False)))
    return out(dn.select("product_id", "Date", "QuantitySold", F.round("AverageSellingPrice", 6)
                         .alias("AverageSellingPrice")))


@q("m5b_random_search_gbt", _search_sql(3, 2))
def m5b_random_search_gbt(spark, d):
    """M5 over the boosted-tree space, rows a leaf and row share held at their
    fixed values; fewer draws, folds, iterations and depth than the whole search (README)."""
    from margincast.operators.models import GBT_FIXED, GBT_SPACE
    space = GBT_SPACE | {"maxIter": ("int", 5, 10), "maxDepth": ("choice", [3, 4, 5])}
    return _search(spark, d, "gbt_a", space, 3, 2, GBT_FIXED)


# =========================================================== the same operators where demand varies

def _over_demand(name: str) -> None:
    """The query once more over products that sell several units a week at prices
    that move them: units, metrics, optima and monotone demand are not constant."""
    fn, sql = REGISTRY[name]

    def run(spark, d):
        with demand_sources():
            return fn(spark, d)
    head, rest = name.split("_", 1)
    REGISTRY[f"{head}v_{rest}"] = (run, sql.replace(SRC, DEMAND_SRC) if sql else None)


for _name in ("a1_weekly_cube", "w4_rolling_std", "w5_rolling_max", "x6_x9_units_log", "m8_metrics", "m9_mape",
              "m15_residual_hist", "x13_verdicts", "p4_profit", "p5_grid_search", "p8_optimization_report",
              "p9_profit_curve", "p10_optimization_summary", "p11_monotone_demand", "m10_model_leaderboard"):
    _over_demand(_name)


@q("p5o_optima_inside", (with_(DEMAND_SRC) + _PRICE_SQL.split(SRC, 1)[1]) + """
SELECT CAST(count(*) AS BIGINT) AS products,
       CAST(sum(CASE WHEN grid_price > lower * 1.0001 AND grid_price < upper * 0.9999 THEN 1 ELSE 0 END) AS BIGINT) AS inside,
       CAST(count(DISTINCT grid_demand) AS BIGINT) AS demands
FROM grid JOIN bounds USING (product_id)""")
def p5o_optima_inside(spark, d):
    """How many products' best price lies inside their bounds."""
    with demand_sources():
        pr = _Price(spark, d)
        g = pr.grid().join(pr.bounds(), "product_id")
    inside = (F.col("grid_price") > F.col("lower") * 1.0001) & (F.col("grid_price") < F.col("upper") * 0.9999)
    return g.agg(F.count(F.lit(1)).alias("products"), F.sum(inside.cast("long")).alias("inside"),
                 F.countDistinct("grid_demand").alias("demands"))


# =========================================================== streaming: the cube from arriving files

@q("st1_stream_weekly_cube", with_(SRC, lines_sql()) + f""",
st AS (
  SELECT product_id, product_category_name_english, seller_state, {WEEK_SQL.format(c='order_purchase_timestamp')} AS Date,
         CAST(count(*) AS BIGINT) AS QuantitySold,
         CAST(sum(CAST(price AS DECIMAL(30,2))) AS DOUBLE) / count(*) AS AverageSellingPrice,
         CAST(sum(CAST(product_height_cm AS DECIMAL(30,4))) AS DOUBLE) / nullif(count(product_height_cm), 0)
           AS Height_cm_Mean
  FROM lines GROUP BY 1, 2, 3, 4)
SELECT product_id, product_category_name_english, seller_state, strftime(Date, '%Y-%m-%d') AS Date,
       QuantitySold, round(AverageSellingPrice, 6) AS AverageSellingPrice, Height_cm_Mean FROM st""")
def st1_stream_weekly_cube(spark, d):
    """A1 maintained by Structured Streaming: delivered order lines land as
    files; the streaming cube (stream-static joins, Monday-labelled event-time
    window, watermark) is written as a change log and read back as the latest
    version per key."""
    import uuid
    from margincast.session import ensure_checkpoint_dir
    from margincast.streaming import latest_version, run_available, weekly_cube_stream
    src = sources(spark, d)
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    o = S.delivered(src["orders"], DELIVERED).select("order_id", "order_purchase_timestamp")
    arriving = src["order_items"].join(o, "order_id").select("order_purchase_timestamp", "product_id",
                                                               "seller_id", "price")
    arriving.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(arriving.schema).parquet(f"{base}/in")
    cb = weekly_cube_stream(stream, src["products"], src["translation"], src["sellers"])
    from margincast.session import partitions_for
    run_available(cb, f"{base}/out", f"{base}/ckpt",
                  state_partitions=partitions_for(spark, spark.read.parquet(f"{base}/in").count(), 200_000))
    cur = latest_version(spark, f"{base}/out", ["product_id", CAT, "seller_state", "Date"])
    return out(cur.select("product_id", CAT, "seller_state", "Date", "QuantitySold",
                          F.round("AverageSellingPrice", 6).alias("AverageSellingPrice"), "Height_cm_Mean"))


@q("f13_casts", with_(*CUBE_CTES) + """
SELECT DISTINCT strftime(Date, '%Y-%m-%d') AS Date, CAST(weekofyear(Date) AS DOUBLE) AS week_double,
       CAST(isodow(Date) - 1 >= 5 AS INTEGER) AS weekend_int, CAST(QuantitySold AS DOUBLE) AS units_double
FROM cube""")
def f13_casts(spark, d):
    """bool → int, week → double, units → double."""
    cb = cube(spark, d)
    return out(cb.select("Date", F.weekofyear("Date").cast("double").alias("week_double"),
                         (F.weekday("Date") >= 5).cast("int").alias("weekend_int"),
                         F.col("QuantitySold").cast("double").alias("units_double")).distinct())
