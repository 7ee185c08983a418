"""The five marketplace source tables, presence check, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# Default names of the five required input files, in the order the service lists them.
SOURCE_FILES = {
    "orders": "orders.csv",
    "order_items": "order_items.csv",
    "products": "products.csv",
    "translation": "category_translation.csv",
    "sellers": "sellers.csv",
}

_S, _D = T.StringType(), T.DoubleType()

# Only the columns the engine touches are typed; CSV readers get the full
# header order of each file so FAILFAST catches malformed rows.
SOURCE_SCHEMAS = {
    "orders": T.StructType([
        T.StructField("order_id", _S), T.StructField("customer_id", _S),
        T.StructField("order_status", _S), T.StructField("order_purchase_timestamp", _S),
        T.StructField("order_approved_at", _S), T.StructField("order_delivered_carrier_date", _S),
        T.StructField("order_delivered_customer_date", _S),
        T.StructField("order_estimated_delivery_date", _S)]),
    "order_items": T.StructType([
        T.StructField("order_id", _S), T.StructField("order_item_id", T.IntegerType()),
        T.StructField("product_id", _S), T.StructField("seller_id", _S),
        T.StructField("shipping_limit_date", _S), T.StructField("price", _D),
        T.StructField("freight_value", _D)]),
    "products": T.StructType([
        T.StructField("product_id", _S), T.StructField("product_category_name", _S),
        T.StructField("product_name_lenght", T.IntegerType()),
        T.StructField("product_description_lenght", T.IntegerType()),
        T.StructField("product_photos_qty", T.IntegerType()),
        T.StructField("product_weight_g", _D), T.StructField("product_length_cm", _D),
        T.StructField("product_height_cm", _D), T.StructField("product_width_cm", _D)]),
    "translation": T.StructType([
        T.StructField("product_category_name", _S),
        T.StructField("product_category_name_english", _S)]),
    "sellers": T.StructType([
        T.StructField("seller_id", _S), T.StructField("seller_zip_code_prefix", _S),
        T.StructField("seller_city", _S), T.StructField("seller_state", _S)]),
}


def read_sources(spark: SparkSession, directory: str, fmt: str = "csv",
                 files: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Read the five tables (``files`` renames single inputs).  CSV uses explicit schemas and FAILFAST;
    parquet uses the file schema (same names).  Nothing is read eagerly."""
    out = {}
    for name, fname in {**SOURCE_FILES, **(files or {})}.items():
        if fmt == "csv":
            out[name] = (spark.read.schema(SOURCE_SCHEMAS[name])
                         .option("header", True).option("mode", "FAILFAST")
                         .option("multiLine", True).option("escape", '"')
                         .csv(f"{directory}/{fname}"))
        else:
            stem = fname.rsplit(".", 1)[0]
            out[name] = spark.read.format(fmt).load(f"{directory}/{stem}.{fmt}")
    return out


CORRUPT = "_corrupt_record"


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """One CSV source as (rows that fit the schema, the raw text of those that
    don't).  A record is bad when a value has not its column's type or the
    number of values differs; the rest of the file is still read.  Every record
    is parsed in full, whatever columns a query asks for, so the same rows
    are bad in every query."""
    raw = (spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, _S)]))
           .option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
           .option("multiLine", True).option("escape", '"').csv(path))
    # the parser skips columns that a query does not read; a test that names all of
    # them (and never holds: there are no fewer than zero values) keeps it from that
    filled = sum(F.col(c).isNotNull().cast("int") for c in schema.names)
    bad = F.col(CORRUPT).isNotNull() | (filled < 0)
    return (raw.where(~bad).select(*schema.names),
            raw.where(bad).select(F.col(CORRUPT).alias("record")))


def read_sources_checked(spark: SparkSession, directory: str,
                         files: dict[str, str] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """S1 for files that may hold malformed rows: the five tables without them,
    and the bad records of all files (source, record) for a quarantine."""
    out, bad = {}, None
    for name, fname in {**SOURCE_FILES, **(files or {})}.items():
        out[name], rest = read_csv_checked(spark, f"{directory}/{fname}", SOURCE_SCHEMAS[name])
        rest = rest.select(F.lit(name).alias("source"), "record")
        bad = rest if bad is None else bad.unionByName(rest)
    return out, bad


def write_sources_csv(src: dict[str, DataFrame], directory: str, bom: bool = False) -> None:
    """The five tables as CSV folders in their files' column order; columns
    that a table lacks stay empty.  ``bom`` starts every file with a byte-order mark."""
    for name, df in src.items():
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast("string").alias(f.name)
                for f in SOURCE_SCHEMAS[name].fields]
        if bom:
            cols[0] = cols[0].alias("\ufeff" + SOURCE_SCHEMAS[name].names[0])
        (df.select(*cols).write.option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "")
         .csv(f"{directory}/{SOURCE_FILES[name]}"))


def check_sources(spark: SparkSession, directory: str,
                  required: list[str] | None = None) -> DataFrame:
    """(source, file, present) for every required input file.

    The listing is a ``binaryFile`` scan with the content column pruned, so
    only file metadata is read; zero-byte files are not listed and therefore
    count as missing.  ``all_ready`` is the AND over the rows.
    """
    required = required or list(SOURCE_FILES.values())
    names = spark.createDataFrame([(i, f) for i, f in enumerate(required)], "pos int, file string")
    try:
        listed = (spark.read.format("binaryFile").load(directory)
                  .select(F.element_at(F.split("path", "/"), -1).alias("file"),
                          F.col("length")))
    except Exception:  # directory itself missing: nothing is present
        listed = spark.createDataFrame([], "file string, length long")
    present = (names.join(listed.select("file").distinct(), "file", "left_semi")
               .select("file", F.lit(True).alias("hit")))
    res = (names.join(present, "file", "left")
           .select("pos", "file", F.coalesce("hit", F.lit(False)).alias("present")))
    # the required list is a handful of names, so one window over it is bounded
    everything = Window.partitionBy(F.lit(1))
    return (res.withColumn("all_ready", F.min(F.col("present").cast("int")).over(everything) == 1)
            .orderBy("pos").drop("pos"))


def write_result(df: DataFrame, path: str, fmt: str = "parquet",
                 partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """S4 sink: results are DataFrames; persisting is one writer call."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
