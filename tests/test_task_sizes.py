"""Tasks of the weekly cube and the dense grid hold a bounded part of the rows."""

import datetime as dt

from pyspark.sql import functions as F

from margincast import session
from margincast.operators.cube import densify, weekly_cube, weekly_cube_from_sources
from margincast.operators.sales import sales_lines


def made_sources(spark, n):
    key = F.col("id")
    orders = spark.range(n // 2).select(key.alias("order_id"), F.lit("delivered").alias("order_status"),
                                        F.expr("timestamp_ntz'2018-01-01 10:00:00' + make_dt_interval(cast(id % 300 as int))")
                                        .alias("order_purchase_timestamp"))
    items = spark.range(n).select((key % (n // 2)).alias("order_id"), F.pmod(F.xxhash64(key), F.lit(500)).alias("product_id"),
                                  (key % 7).alias("seller_id"), (key % 90 + 1).cast("decimal(12,2)").alias("price"))
    products = spark.range(500).select(key.alias("product_id"), F.lit("a").alias("product_category_name"),
                                       *[key.cast("double").alias(c) for c in ("product_weight_g", "product_length_cm",
                                                                              "product_height_cm", "product_width_cm")])
    return {"orders": orders, "order_items": items, "products": products,
            "translation": spark.createDataFrame([("a", "fashion_a")], "product_category_name string, product_category_name_english string"),
            "sellers": spark.range(7).select(key.alias("seller_id"), F.concat(F.lit("s"), key % 3).alias("seller_state"))}


def test_cube_tasks_are_sized_below_the_sessions_advisory_size(spark, monkeypatch):
    monkeypatch.setattr(session, "SHUFFLE_BYTES", 8 << 10, raising=False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        src = made_sources(spark, 60_000)
        line, pre = weekly_cube(sales_lines(src)), weekly_cube_from_sources(src)
        for cube in (line, pre):
            # 64 MB would take all of them into one task (AQE keeps about 1 MB together)
            assert cube.rdd.getNumPartitions() >= 2
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "67108864b"
        assert spark.conf.get(first, None) is None
        assert sorted(line.collect()) == sorted(pre.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.parallelismFirst")


def test_sizes_as_settings_write_them():
    assert [session._bytes(x) for x in ("67108864b", "16k", "8MB", "1g", "512")] == [64 << 20, 16 << 10, 8 << 20, 1 << 30, 512]


def test_small_shuffles_keep_finer_settings(spark):
    size, first = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.set(size, "1m")
    spark.conf.set(first, "5000")
    try:
        with session.small_shuffles(spark):
            assert (spark.conf.get(size), spark.conf.get(first)) == (str(1 << 20), "5000")
        assert (spark.conf.get(size), spark.conf.get(first)) == ("1m", "5000")
    finally:
        spark.conf.unset(size)
        spark.conf.unset(first)


def test_dense_grid_tasks_grow_with_the_cube_not_with_the_session(spark):
    week = F.lit(dt.date(2018, 1, 1))
    cube = spark.range(1_100_000).select(
        (F.col("id") % 1000).alias("product_id"), F.lit("c").alias("product_category_name_english"),
        (F.col("id") / 1000).cast("int").alias("seller_state_encoded"), week.alias("Date"), F.lit(1).cast("long").alias("QuantitySold"),
        *[F.lit(1.0).alias(m) for m in ("AverageSellingPrice", "Weight_g_Mean", "Length_cm_Mean", "Height_cm_Mean", "Width_cm_Mean")])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        grid = densify(cube)
        assert grid.rdd.getNumPartitions() == 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_boosted_fits_get_few_large_partitions_and_forests_do_not(spark, monkeypatch):
    from margincast.plans import catalog
    seen = []
    frame = spark.range(10).select(F.col("id").alias("product_id"), F.lit(1).alias("Date"), F.lit(0).alias("seller_state_encoded"),
                                   (F.col("id") < 8).alias("is_train"))

    class Stop(Exception):
        pass

    def spread(df, keys, rows_per_task=1_000, rows_per_partition=200_000):
        seen.append(rows_per_partition)
        raise Stop

    monkeypatch.setattr(session, "spread", spread)
    monkeypatch.setattr(catalog, "batch_frame", lambda spark, d: frame)
    monkeypatch.setattr("margincast.operators.splits.row_split", lambda df, frac: df)
    for name in ("m1_gbt_leafwise", "m2_gbt_subsampled", "m6_log_target_model", "m3_random_forest"):
        try:
            catalog.REGISTRY[name][0](spark, "")
        except Stop:
            pass
    assert seen == [1_000_000, 1_000_000, 1_000_000, 200_000]
