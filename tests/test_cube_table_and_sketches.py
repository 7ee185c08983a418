"""The stored cube's pruned reads, and distinct counts from merged sketches."""

import datetime as dt
import re

from pyspark.sql import functions as F

from margincast.operators.cube import distinct_sketches, merged_distinct
from margincast.sources.cube_table import between_weeks, product_rows, store_cube, week_rows

MON = dt.date(2017, 1, 2)


def stored(spark, tmp_path, name):
    rows = [(p, MON + dt.timedelta(weeks=w), p * 1000 + w) for p in range(40) for w in range(0, 150, 3)]
    df = spark.createDataFrame(rows, "product_id long, Date date, QuantitySold long")
    store_cube(df, name, str(tmp_path / name), buckets=4)
    return df


def plan(df):
    spark = df.sparkSession
    return spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_product_lookup_reads_one_bucket(spark, tmp_path):
    df = stored(spark, tmp_path, "cube_lookup")
    # a scan that nothing joins is not planned by bucket, and shows its pruning only without that rule
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 4" in plan(product_rows(spark, "cube_lookup", 7))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    got = product_rows(spark, "cube_lookup", 7)
    assert sorted(got.collect()) == sorted(df.where("product_id = 7").collect())
    assert product_rows(spark, "cube_lookup", 999).count() == 0


def test_week_filters_read_their_years(spark, tmp_path):
    df = stored(spark, tmp_path, "cube_weeks")
    week = MON + dt.timedelta(weeks=60)
    one = week_rows(spark, "cube_weeks", week)
    assert re.search(r"PartitionFilters: \[[^\]]*year", plan(one))
    assert sorted(one.collect()) == sorted(df.where(F.col("Date") == F.lit(week)).collect()) and one.count() == 40
    files = {f.split("year=")[1][:4] for f in one.inputFiles()}
    assert files == {str(week.year)} or len(one.inputFiles()) <= len(spark.table("cube_weeks").inputFiles())
    last = between_weeks(spark, "cube_weeks", dt.date(2018, 12, 1), None)
    assert sorted(last.collect()) == sorted(df.where("Date >= '2018-12-01'").collect())


def test_windows_by_product_need_no_shuffle(spark, tmp_path):
    stored(spark, tmp_path, "cube_window")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        total = spark.table("cube_window").groupBy("product_id").agg(F.sum("QuantitySold"))
        assert "Exchange" not in total._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_sketches_merge_in_any_grouping(spark):
    df = spark.range(60_000).select((F.col("id") % 20_011).alias("v"), (F.col("id") % 9).alias("week"))
    weekly = distinct_sketches(df, ["v"], by="week")
    once = merged_distinct(weekly, ["v"]).first()[0]
    parts = [weekly.where(F.col("week") % 3 == i).agg(F.hll_union_agg("s_v").alias("s_v")) for i in range(3)]
    later = merged_distinct(parts[0].union(parts[1]).union(parts[2]), ["v"]).first()[0]
    assert abs(later - once) <= 0.01 * once
    assert abs(once - 20_011) < 3 * 1.04 / 64 * 20_011
    new = distinct_sketches(spark.range(30_000, 31_000).select(F.col("id").alias("v"), F.lit(99).alias("week")), ["v"], by="week")
    assert 20_400 < merged_distinct(weekly.union(new), ["v"]).first()[0] < 21_700
