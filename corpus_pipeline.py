"""Corpus pipeline: quality rules, line dedup, near-duplicate join, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows its predecessor
kept and returns a DataFrame; all but the last return the columns of
``documents``.  Stages:

1. quality rules: documents the rules reject go;
2. line dedup: repeated lines go, ``n_chars`` follows the text;
3. n-gram Jaccard join: of each group of near copies the smallest ``doc_id``
   stays (a null id is its own group);
4. mixing: all rows, in the order of the Pfair schedule (files follow it);
5. packing: one row per packed piece; shards are runs of the mixed order, and
   ``sequence_id`` ascends along it.

``run`` writes every stage's rows as Parquet in the shared folder and reads
them back for the next.  SQL can't express the tokenizer, so there is no
``ORACLE_SQL``; tests hold the stages against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from margincast.llm import line_dedup, mixing, ngram_join, packing, quality
from margincast.llm.common import read, written

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    features = written(quality.text_features(docs), "quality-counts")
    return quality.judge(features).where("kept").select("_row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs)
    new = {"text": F.col("_text").alias("text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType).alias("n_chars")}
    return out.select(*[new.get(c, F.col(f"_row.`{c}`")) for c in docs.columns])


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = (ngram_join.near_duplicates(docs).where(F.col("component_id") != F.col("doc_id"))
              .select(F.col("doc_id").alias("_copy")).distinct().alias("gone"))
    return docs.alias("docs").join(copies, F.col("docs.doc_id") == F.col("gone._copy"), "left_anti")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, in_order=True)


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", jaccard_stage),
    ("mixing to target weights", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
