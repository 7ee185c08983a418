"""The weekly cube kept as a table that reads prune.

Partitioned by year (a week or date filter opens one year's folder) and bucketed
by product inside it (a product lookup opens one bucket; per-product windows
and joins on the product start without a shuffle)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def store_cube(cube: DataFrame, table: str, path: str | None = None, buckets: int = 8, key: str = "product_id") -> None:
    """Write ``cube`` as ``table`` (its files at ``path``, else in the warehouse).
    Rows are dealt by (year, bucket) first, so a folder gets one file a bucket."""
    year = cube.withColumn("year", F.year("Date"))
    w = (year.repartition(buckets, key).write.mode("overwrite").format("parquet")
         .partitionBy("year").bucketBy(buckets, key).sortBy(key, "Date"))
    (w.option("path", path) if path else w).saveAsTable(table)


def product_rows(spark: SparkSession, table: str, product_id, key: str = "product_id") -> DataFrame:
    """one product's rows; reads one bucket of every year."""
    return spark.table(table).where(F.col(key) == F.lit(product_id)).drop("year")


def week_rows(spark: SparkSession, table: str, week: dt.date) -> DataFrame:
    """one week's rows; reads one year."""
    return between_weeks(spark, table, week, week)


def between_weeks(spark: SparkSession, table: str, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """Rows of the weeks ``first`` to ``last`` (inclusive, null: open); reads their years."""
    df = spark.table(table)
    for bound, op in ((first, "__ge__"), (last, "__le__")):
        if bound is not None:
            df = df.where(getattr(F.col("year"), op)(F.lit(bound.year)) & getattr(F.col("Date"), op)(F.lit(bound)))
    return df.drop("year")
