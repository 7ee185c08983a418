"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margincast.llm.common import counted, discard, written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``v, c``: every vertex of ``edges`` (a, b: long) and the smallest vertex
    it reaches.  Each round takes the smallest label among neighbours and
    then the label's own label, so labels jump along paths; rounds end when
    none changes.  Labels are written each round: short lineage, and nothing is
    lost with an executor."""
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .where("a <> b").distinct(), f"{name}-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c")),
                     f"{name}-labels")
    large = counted(labels) is not labels      # as many rows in every round
    while True:
        now = labels.hint("merge") if large else labels
        near = (both.join(now.select(F.col("v").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("m"))
                .select(F.col("a").alias("v"), "m"))
        hooked = now.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = now.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        step = written(hooked.join(up, "c").select("v", "old", F.least("c", "cc").alias("c")), f"{name}-labels")
        discard(spark, labels)
        labels = step.select("v", "c")
        if not step.where(F.col("c") != F.col("old")).limit(1).count():
            discard(spark, both)
            return labels
