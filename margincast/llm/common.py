"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from margincast.session import ensure_checkpoint_dir

#: A word is a run of anything but these characters (space, tab .. carriage return).
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs neither
    recompute it nor depend on the executors that made it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a ``written`` table that nothing will read again."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows up to which a table may be broadcast (some 10 MB as a hash table).
BROADCAST_ROWS = 100_000


def counted(df: DataFrame) -> DataFrame:
    """``df``, joined by a sort and merge unless it is proven to hold few rows.
    Spark goes by the size of the compressed files, of which a driver
    has to hold many times as much when it broadcasts them."""
    return df if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")


def packed(df: DataFrame) -> Column:
    """The whole row as one struct, so columns an operator adds can't clash
    with columns the caller's table happens to have."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Total size of the texts, to size blocks and shards from."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def pack_ints(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes, low byte first; planes of zeros cost
    next to nothing, so narrow values need no type of their own."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def unpack_ints(blob: bytes, dtype, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype)
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(blob, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(n)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of a batch of texts (A-Z lower-cased), and each word's row."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, rows = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), rows[full.to_numpy(zero_copy_only=False)].astype(np.int64)


def word_codes(words_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words' 64-bit hashes, and each word's index among them."""
    coded = words_.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], dtype=np.uint64)
    return hashes, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal ranges of the hash space; ascending in the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
