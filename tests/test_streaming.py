from pyspark.sql import functions as F

from conftest import SF0001
from margincast.operators.sales import delivered, sales_lines
from margincast.operators.cube import weekly_cube
from margincast.sources import load_driver_sources
from margincast.sources.driver_tables import DELIVERED
from margincast.streaming import weekly_cube_stream


def test_stream_cube_equals_batch_cube(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    src = load_driver_sources(spark, SF0001)
    o = delivered(src["orders"], DELIVERED).select("order_id", "order_purchase_timestamp")
    lines = src["order_items"].join(o, "order_id").select("order_purchase_timestamp", "product_id",
                                                          "seller_id", "price")
    lines.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    cube = weekly_cube_stream(stream, src["products"], src["translation"], src["sellers"])
    q = (cube.writeStream.outputMode("complete").format("memory").queryName("cube_stream")
         .option("checkpointLocation", str(tmp_path / "ckpt")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("cube_stream").select("product_id", "seller_state", F.col("Date").cast("string"),
                                            "QuantitySold", F.round("AverageSellingPrice", 6))
    want = (weekly_cube(sales_lines(src, DELIVERED))
            .join(sales_lines(src, DELIVERED).select("seller_state").distinct()
                  .withColumn("seller_state_encoded",
                              F.dense_rank().over(__import__("pyspark.sql.window", fromlist=["Window"])
                                                  .Window.orderBy("seller_state")) - 1),
                  "seller_state_encoded")
            .select("product_id", "seller_state", F.col("Date").cast("string"), "QuantitySold",
                    F.round("AverageSellingPrice", 6)))
    assert sorted(got.collect()) == sorted(want.collect())
