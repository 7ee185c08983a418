"""The weekly cube (A1) maintained incrementally with Structured Streaming.

The reference re-reads complete files on every upload; here newly arriving
order lines (files in a folder) update the same (product, category, region,
week) measures.  Dimensions join as static tables; the week bucket is an
event-time window of 7 days starting on Tuesday 00:00 and labelled by its
closing Monday (the same bins as ``week_label``); a watermark bounds the
state kept for late lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from margincast.operators.sales import CATEGORY, DIM_COLS, products_with_category

# 1970-01-01 was a Thursday: windows start 5 days later, on Tuesday 00:00.
_TUESDAY_OFFSET = "5 days"


def week_window(ts: str) -> Column:
    return F.window(ts, "7 days", "7 days", _TUESDAY_OFFSET)


def weekly_cube_stream(lines: DataFrame, products: DataFrame, translation: DataFrame,
                       sellers: DataFrame, prefix: str = "fashion_",
                       watermark: str = "14 days") -> DataFrame:
    """Streaming cube from a stream of delivered order lines
    (``order_purchase_timestamp, product_id, seller_id, price``).

    Output columns match the batch cube except that the region is the raw
    ``seller_state`` (codes depend on the whole region set and are applied
    when the cube is read)."""
    prods = products_with_category(products, translation, prefix).select("product_id", CATEGORY, *DIM_COLS)
    # The watermark needs a zone-aware instant.  It is built from the
    # wall-clock parts with an explicit UTC zone, and the week label is taken
    # from epoch days of the window end, so week boundaries never depend on
    # the session time zone.
    t = F.col("order_purchase_timestamp")
    ev = lines.withColumn("_ts", F.make_timestamp(F.year(t), F.month(t), F.dayofmonth(t), F.hour(t),
                                                  F.minute(t), F.second(t), F.lit("UTC")))
    joined = (ev.withWatermark("_ts", watermark)
              .join(prods, "product_id", "inner")
              .join(sellers.select("seller_id", "seller_state"), "seller_id", "left")
              .withColumn("seller_state", F.coalesce("seller_state", F.lit("Unknown"))))
    agg = joined.groupBy("product_id", CATEGORY, "seller_state", week_window("_ts").alias("w")).agg(
        F.count(F.lit(1)).alias("QuantitySold"),
        F.sum(F.col("price").cast("decimal(30,2)")).alias("_price_sum"),
        *[F.sum(F.col(c).cast("decimal(30,4)")).alias(f"_{c}_sum") for c in DIM_COLS],
        *[F.count(c).alias(f"_{c}_n") for c in DIM_COLS])
    names = ["Weight_g_Mean", "Length_cm_Mean", "Height_cm_Mean", "Width_cm_Mean"]
    return agg.select(
        "product_id", CATEGORY, "seller_state",
        F.date_from_unix_date((F.unix_seconds(F.col("w.end")) / 86400).cast("int") - 1).alias("Date"),
        "QuantitySold",
        (F.col("_price_sum").cast("double") / F.col("QuantitySold")).alias("AverageSellingPrice"),
        *[(F.col(f"_{c}_sum").cast("double") / F.nullif(F.col(f"_{c}_n"), F.lit(0))).alias(n)
          for c, n in zip(DIM_COLS, names)])


def run_available(stream_df: DataFrame, out_path: str, checkpoint_path: str,
                  state_partitions: int | None = None) -> None:
    """Process every available input file and stop (``availableNow``).

    Update mode: each micro-batch emits only the cube rows it changed; they
    are appended to ``out_path`` with the batch id (a distributed write per
    batch), so the sink is an append-only change log that survives restarts
    through the query checkpoint."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out_path)

    spark = stream_df.sparkSession
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if state_partitions:
        # the state store keeps this partition count for the life of the
        # checkpoint (AQE does not resize streaming shuffles), so it is chosen
        # deliberately at the first start
        spark.conf.set(key, str(state_partitions))
    try:
        q = (stream_df.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start())
    finally:
        spark.conf.set(key, before)
    q.awaitTermination()


def latest_version(spark, path: str, keys: list[str]) -> DataFrame:
    """The current cube from the change log: the last written version of each
    key (a grouped ``max_by`` over the batch id — partial aggregation)."""
    log = spark.read.parquet(path)
    others = [c for c in log.columns if c not in keys and c != "_batch"]
    return (log.groupBy(*keys).agg(F.max_by(F.struct(*others), "_batch").alias("_r"))
            .select(*keys, "_r.*"))
