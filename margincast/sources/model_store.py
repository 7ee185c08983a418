"""S3: persist / load a fitted pipeline (scaler + model), its feature list and
the label encoders its features were made with.

Layout below one path: ``pipeline`` (MLlib), ``features`` (pos, feature),
``encoders`` (column, output, unseen: one row per encoder) and
``dictionaries/<column>`` (value, code: one table per encoder, of any size).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margincast.operators.ordering import dense_codes

#: What becomes of a value that the dictionary does not hold.
UNSEEN = ("error", "code", "drop")
UNSEEN_CODE = -1


@dataclass(frozen=True)
class Encoder:
    """Sorted distinct values of ``column`` as 0-based codes in ``output``.
    ``unseen``: ``error`` fails the job that meets a new value, ``code`` gives it
    -1, ``drop`` leaves its row out.  A null value counts as unseen."""

    column: str
    output: str
    codes: DataFrame            # value, code
    unseen: str = "error"

    def transform(self, df: DataFrame) -> DataFrame:
        # joined by key: whether the dictionary is broadcast is decided from its size
        known = self.codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        j = df.join(known, F.col(self.column) == F.col("_value"), "inner" if self.unseen == "drop" else "left")
        if self.unseen == "code":
            code = F.coalesce("_code", F.lit(UNSEEN_CODE))
        elif self.unseen == "error":
            said = F.concat(F.lit(f"value of {self.column} not in the dictionary: "),
                            F.coalesce(F.col(self.column).cast("string"), F.lit("null")))
            code = F.when(F.col("_code").isNull(), F.raise_error(said).cast("int")).otherwise(F.col("_code"))
        else:
            code = F.col("_code")
        return j.withColumn(self.output, code).drop("_value", "_code")


def fit_encoders(df: DataFrame, columns: dict[str, str], unseen: str = "error") -> list[Encoder]:
    """E1 as objects that outlive the fit: one encoder per column -> output."""
    if unseen not in UNSEEN:
        raise ValueError(unseen)
    return [Encoder(c, o, dense_codes(df, c, "code").select(F.col(c).alias("value"), "code"), unseen)
            for c, o in columns.items()]


def encode(df: DataFrame, encoders: list[Encoder]) -> DataFrame:
    for e in encoders:
        df = e.transform(df)
    return df


def save_model(model: PipelineModel, path: str, spark: SparkSession | None = None,
               feature_cols: list[str] | None = None, encoders: list[Encoder] | None = None) -> None:
    model.write().overwrite().save(f"{path}/pipeline")
    if spark is not None and feature_cols is not None:
        (spark.createDataFrame([(i, c) for i, c in enumerate(feature_cols)], "pos int, feature string")
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/features"))
    if encoders:
        spark = spark or encoders[0].codes.sparkSession
        (spark.createDataFrame([(e.column, e.output, e.unseen) for e in encoders], "column string, output string, unseen string")
         .coalesce(1).write.mode("overwrite").parquet(f"{path}/encoders"))
        for e in encoders:
            e.codes.write.mode("overwrite").parquet(f"{path}/dictionaries/{e.column}")


def load_model(path: str, spark: SparkSession | None = None):
    model = PipelineModel.load(f"{path}/pipeline")
    if spark is None:
        return model
    feats = spark.read.parquet(f"{path}/features").orderBy("pos")
    return model, feats


def load_encoders(path: str, spark: SparkSession) -> list[Encoder]:
    """The stored encoders, to encode new rows in any session."""
    rows = spark.read.parquet(f"{path}/encoders").collect()          # one row per encoded column
    return [Encoder(r["column"], r["output"], spark.read.parquet(f"{path}/dictionaries/{r['column']}"), r["unseen"])
            for r in rows]
