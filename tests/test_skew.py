"""A hot product holding a third of all order lines: shuffle joins with AQE
skew splitting forced on must give the same cube as the default plan."""

from pyspark.sql import functions as F

from conftest import SF0001
from margincast.operators.cube import weekly_cube, weekly_cube_from_sources
from margincast.operators.sales import sales_lines
from margincast.sources import load_driver_sources
from margincast.sources.driver_tables import DELIVERED


def skewed_sources(spark):
    src = load_driver_sources(spark, SF0001)
    items = src["order_items"]
    n = items.count()
    hot = items.where(F.col("product_id") == 0).first()
    # copies of one line of product 0, spread over the existing orders so the
    # hot product ends up with about a third of all lines
    extra = src["orders"].select("order_id").limit(n // 2).select(
        "order_id", F.lit(hot.product_id).alias("product_id"), F.lit(hot.seller_id).alias("seller_id"),
        F.lit(hot.price).cast(items.schema["price"].dataType).alias("price"))
    src = dict(src)
    src["order_items"] = items.unionByName(extra.select(*items.columns))
    return src


def test_hot_product_cube_same_with_skew_split(spark):
    src = skewed_sources(spark)
    base = sorted(weekly_cube(sales_lines(src, DELIVERED)).collect())
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.enabled": "true",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        skew = sorted(weekly_cube(sales_lines(src, DELIVERED)).collect())
        pre = sorted(weekly_cube_from_sources(src, DELIVERED).collect())
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert skew == base == pre
    hot_units = sum(r.QuantitySold for r in base if r.product_id == 0)
    assert hot_units >= sum(r.QuantitySold for r in base) / 4
