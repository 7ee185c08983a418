"""train/test splits, sampling, assembling, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from margincast.operators.ordering import ordered_index
from margincast.operators.windows import ORDER


def row_positions(df: DataFrame, key: str = "product_id", order: list[str] | None = None,
                  partitions: int | None = None) -> DataFrame:
    """0-based position of every row in the global order (key, *order).

    Per-product row counts get a distributed running sum over the product
    order (``ordered_index``), which is joined back and added to the row
    number inside the product — no window ever spans more than one product.
    """
    order = order or ORDER
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    starts = ordered_index(counts, [key], out="_start", weight="_n", partitions=partitions)
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return (df.join(starts.select(key, "_start"), key)
            .withColumn("_pos", F.col("_start") + rn).drop("_start"))


def row_split(df: DataFrame, frac: float = 0.8, key: str = "product_id",
              order: list[str] | None = None) -> DataFrame:
    """First floor(frac·n) rows of the (product, Date, region) order are
    train (``is_train`` true), the rest test.  Because rows are ordered by
    product first, this splits by product, not by time."""
    pos = row_positions(df, key, order)
    n = df.count()
    cut = int(n * frac)
    return pos.withColumn("is_train", F.col("_pos") < F.lit(cut)).drop("_pos")


def date_split(df: DataFrame, frac: float = 0.8, col: str = "Date") -> DataFrame:
    """Split date = the distinct date at position int(frac · #dates);
    train is strictly before it.  Distinct dates are weeks, a small table."""
    dates = df.select(col).distinct()
    n = dates.count()
    k = int(n * frac)
    if k >= n:
        raise ValueError("date split leaves the test side empty")
    split = (dates.select(col, F.row_number().over(Window.orderBy(col)).alias("_rn"))
             .where(F.col("_rn") == k + 1).first()[col])
    return df.withColumn("is_train", F.col(col) < F.lit(split))


def sample_n(df: DataFrame, n: int, seed: int = 42, key_cols: list[str] | None = None) -> DataFrame:
    """Up to n rows without replacement, seeded: the n smallest values of
    a seeded hash of the row key (a distributed top-k)."""
    key_cols = key_cols or df.columns
    h = F.xxhash64(F.lit(seed), *[F.col(c) for c in key_cols])
    return df.withColumn("_h", h).orderBy("_h", *key_cols).limit(n).drop("_h")


def assemble(df: DataFrame, cols: list[str], label: str = "QuantitySold",
             out: str = "features") -> DataFrame:
    """E5: numeric feature vector + double label."""
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="error")
    return va.transform(df.withColumns({c: F.col(c).cast("double") for c in cols})).withColumn(
        "label", F.col(label).cast("double"))


def scale_stats(train: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """E6 fit: mean and population std per column, from the train side only
    (one row of 2·len(cols) numbers returned to the driver)."""
    row = train.agg(*[x for c in cols for x in (F.avg(c).alias(f"m_{c}"),
                                                 F.stddev_pop(c).alias(f"s_{c}"))]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}


def scale(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """E6 apply: (x − mean) / std, a zero std dividing by 1."""
    exprs = {}
    for c, (m, s) in stats.items():
        s = s if s else 1.0
        exprs[c + suffix] = (F.col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(exprs)
