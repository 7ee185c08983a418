"""Global order without a single-task window.

``Window.orderBy(...)`` with no partition moves every row into one task.  The
helpers here give the same answers (0-based rank, running sums over a total
order) in three distributed steps:

1. range-partition the rows on the order keys and sort inside partitions;
2. number rows inside each partition and cut lineage with a reliable
   checkpoint, so partition ids and numbers are fixed from then on;
3. per-partition totals (one row per partition — bounded by the partition
   count) become offsets, broadcast back and added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from margincast.session import ensure_checkpoint_dir


def ordered_index(df: DataFrame, order_cols: list[str], out: str = "_rank",
                  weight: str | None = None, partitions: int | None = None) -> DataFrame:
    """Add ``out`` = number of rows (or sum of ``weight``) strictly before each
    row in the total order ``order_cols`` (which must be unique per row)."""
    ensure_checkpoint_dir(df.sparkSession)
    # Without an explicit count AQE may coalesce the range partitions; it only
    # merges adjacent ones, so partition order still follows key order.
    ranged = df.repartitionByRange(partitions, *order_cols) if partitions else \
        df.repartitionByRange(*order_cols)
    ranged = (ranged.sortWithinPartitions(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id()
                          - F.shiftleft(F.col("_pid").cast("long"), 33)))
    if weight is not None:
        # running sum inside the partition, exclusive of the row itself
        w = Window.partitionBy("_pid").orderBy("_local").rowsBetween(Window.unboundedPreceding, -1)
        ranged = ranged.withColumn("_local", F.coalesce(F.sum(weight).over(w), F.lit(0)))
        size = F.sum(weight)
    else:
        size = F.count(F.lit(1))
    ranged = ranged.checkpoint(eager=True)
    # at most `p` rows: one per partition
    per_part = ranged.groupBy("_pid").agg(size.alias("_size"))
    offsets = per_part.select(
        "_pid",
        F.coalesce(F.sum("_size").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_offset"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(out, F.col("_offset") + F.col("_local"))
            .drop("_pid", "_local", "_offset"))


def dense_codes(values: DataFrame, col: str, out: str, partitions: int | None = None) -> DataFrame:
    """E1 dictionary for a possibly large dimension: sorted distinct → 0..n-1."""
    distinct = values.select(col).where(F.col(col).isNotNull()).distinct()
    return ordered_index(distinct, [col], out="_code", partitions=partitions).select(
        col, F.col("_code").cast("int").alias(out))


def next_non_null(df: DataFrame, key: str, value: str, out: str,
                  block_rows: int = 100_000, partitions: int | None = None) -> DataFrame:
    """For a table with one row per ``key``: ``out`` = the first non-null
    ``value`` at or after the row in key order (a global backward fill).

    Rows are ranked (``ordered_index``), cut into blocks of ``block_rows``
    consecutive ranks; inside a block a window finds the next non-null; a
    block whose tail is still null takes the first non-null of the following
    blocks from a per-block table (one row per block)."""
    ranked = ordered_index(df, [key], out="_r", partitions=partitions)
    ranked = ranked.withColumn("_blk", F.floor(F.col("_r") / F.lit(block_rows)).cast("long"))
    # next non-null = running last non-null over the reversed order (an
    # incremental frame; a current..unbounded-following frame is quadratic)
    w_in = Window.partitionBy("_blk").orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inner = ranked.withColumn("_in", F.last(value, ignorenulls=True).over(w_in))
    per_block = ranked.groupBy("_blk").agg(
        F.min_by(value, F.when(F.col(value).isNotNull(), F.col("_r"))).alias("_first"))
    # one row per block: the first non-null of the blocks after each block
    carry = per_block.select(
        "_blk",
        F.last("_first", ignorenulls=True).over(
            Window.orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    return (inner.join(F.broadcast(carry), "_blk", "left")
            .withColumn(out, F.coalesce("_in", "_carry"))
            .drop("_r", "_blk", "_in", "_carry"))


def global_backfill(df: DataFrame, order_cols: list[str], cols: list[str], partitions: int | None = None) -> DataFrame:
    """Every null of ``cols`` takes the first non-null value after it in the total
    order ``order_cols`` (any columns, unique per row), across all keys.

    Rows are range-partitioned and sorted; a window fills inside each partition, and
    what its tail leaves null takes the first value of the following
    partitions from a table of one row per partition."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = (df.repartitionByRange(partitions, *order_cols) if partitions else df.repartitionByRange(*order_cols))
    ranged = (ranged.sortWithinPartitions(*order_cols).withColumn("_pid", F.spark_partition_id())
              .withColumn("_local", F.monotonically_increasing_id()).checkpoint(eager=True))
    back = Window.partitionBy("_pid").orderBy(F.col("_local").desc()).rowsBetween(Window.unboundedPreceding, 0)
    inner = ranged.withColumns({c: F.last(c, ignorenulls=True).over(back) for c in cols})
    firsts = ranged.groupBy("_pid").agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_local"))).alias(f"_first_{c}") for c in cols])
    later = Window.orderBy(F.col("_pid").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = firsts.select("_pid", *[F.last(f"_first_{c}", ignorenulls=True).over(later).alias(f"_carry_{c}") for c in cols])
    return (inner.join(F.broadcast(carry), "_pid", "left")
            .withColumns({c: F.coalesce(c, f"_carry_{c}") for c in cols}).select(*df.columns))
