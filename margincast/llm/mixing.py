"""Mixing sources to target weights by Pfair scheduling.

A source's rows are dealt into blocks.  A source of weight w must have run its
k-th block (from 0) inside the window [floor(k/w), ceil((k+1)/w)): release and
deadline.  One block runs per slot; among the released ones the earliest
deadline runs first (ties: the larger weight, then the name).  With weights
that sum to one this keeps every source within less than one block of its
share at every slot.  Windows are worked out in whole numbers from the exact
values of the weights given, so nothing adds up however many slots run.

When a source has no blocks left, a new phase starts: the remaining sources
are scheduled anew by their weights among themselves, so all rows are kept.

Only DataFrame functions on rows.  A row's place inside its source needs no
single-task order: rows fall into hash buckets of bounded size inside the
source; bucket counts give offsets and a window numbers each bucket, so a
source with a third of all rows is spread over many tasks.

Defined results: a null source is a source of its own; repeated rows are kept
(their mutual order is open); an empty table gives an empty result; columns
that clash with the added ones are safe because the row travels as a struct.
The driver holds a count per source and one number per block, never rows; it
takes some microseconds a block, and a pass over the live sources per phase.
``block_rows`` sets how many blocks there are.  The schedule is broadcast up to
``broadcast_blocks`` blocks (8 bytes each) and meets the rows by a shuffle
join, cut into pieces of ``piece_blocks`` of one source, beyond that.
"""

from __future__ import annotations

import heapq
import math
from array import array
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from margincast.llm.common import packed


@dataclass(frozen=True)
class MixRules:
    block_rows: int = 16
    temperature: float = 0.5         # default weights: row count ** temperature
    bucket_rows: int = 2_000
    piece_blocks: int = 4_096        # blocks of a source in one row of the schedule table
    broadcast_blocks: int = 4_000_000
    broadcast_sources: int = 200_000


def exact_weights(weights: dict) -> dict:
    """Whole numbers in exactly the ratio of the weights given."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*[w.denominator for w in parts.values()])
    return {s: int(w * unit) for s, w in parts.items()}


def schedule(blocks: dict, weights: dict) -> dict:
    """The slots of every source's blocks, in order."""
    slots: dict = {s: array("q") for s in blocks}
    whole = exact_weights({s: weights[s] for s, n in blocks.items() if n})
    # sources by rank: larger weight first, then the name, null last
    live = sorted(whole, key=lambda s: (-whole[s], s is None, str(s)))
    start = 0
    while live:
        total = sum(whole[s] for s in live)
        ready = [(-(-total // whole[s]), i, 0) for i, s in enumerate(live)]       # deadline, rank, block of the phase
        heapq.heapify(ready)
        waiting: list = []                                                       # release, rank, block
        ends = {i: blocks[s] - len(slots[s]) for i, s in enumerate(live)}
        slot = 0
        while True:
            while waiting and waiting[0][0] <= slot:
                _, i, k = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(k + 1) * total // whole[live[i]]), i, k))
            _, i, k = heapq.heappop(ready)
            slots[live[i]].append(start + slot)
            slot += 1
            if k + 1 == ends[i]:
                break
            heapq.heappush(waiting, ((k + 1) * total // whole[live[i]], i, k + 1))
        start += slot
        live = live[:i] + live[i + 1:]
    return slots


def mixed(docs: DataFrame, weights: dict | None = None, rules: MixRules = MixRules(),
          id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``_row`` (the packed input row), ``_source``, ``block`` (its number in
    the source), ``slot`` (of the block in the schedule) and ``place`` (row in
    block), for every row."""
    spark = docs.sparkSession
    base = docs.select(packed(docs), F.col(source_col).cast("string").alias("_source"),
                       F.xxhash64(F.col(id_col)).alias("_h"), F.col(id_col).alias("_id"))
    found = base.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["_source"]: r["n"] for r in found}
    if weights is None:
        weights = {s: n ** rules.temperature for s, n in counts.items()}
    missing = [s for s in counts if weights.get(s, 0) <= 0]
    if missing:
        raise ValueError(f"no positive weight for sources {missing[:5]}")
    size = rules.block_rows
    plan = schedule({s: -(-n // size) for s, n in counts.items()}, weights)

    # a row's number in its source: bucket offset + number inside the bucket
    sizes = spark.createDataFrame(list(counts.items()), "s string, _n long")
    if len(counts) <= rules.broadcast_sources:
        sizes = F.broadcast(sizes)
    rows = (base.join(sizes, F.col("_source").eqNullSafe(F.col("s")))
            .withColumn("_b", F.pmod(F.col("_h"), F.ceil(F.col("_n") / F.lit(rules.bucket_rows))))
            .withColumn("_key", F.concat_ws(":", F.col("_b"), F.when(F.col("_source").isNull(), "n").otherwise("s"),
                                            F.col("_source")))
            .drop("s", "_n"))
    before = Window.partitionBy("_source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("_source", "_b", "_key").agg(F.count(F.lit(1)).alias("_c"))
               .select("_key", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off")))
    number = F.row_number().over(Window.partitionBy("_key").orderBy("_h", "_id")) - 1
    placed = (rows.withColumn("_at", number).join(offsets, "_key")
              .withColumn("_at", F.col("_off") + F.col("_at"))
              .select("_row", "_source", F.floor(F.col("_at") / F.lit(size)).alias("block"),
                      (F.col("_at") % size).cast("int").alias("place")))

    # the block's slot, from the source's piece of the schedule
    step = rules.piece_blocks
    pieces = spark.createDataFrame([(s, i // step, at[i:i + step].tolist()) for s, at in plan.items() for i in range(0, len(at), step)],
                                   "s string, _piece long, _slots array<long>")
    if sum(map(len, plan.values())) <= rules.broadcast_blocks:
        pieces = F.broadcast(pieces)
    return (placed.join(pieces, F.col("_source").eqNullSafe(F.col("s"))
                        & (F.floor(F.col("block") / F.lit(step)) == F.col("_piece")))
            .select("_row", "_source", "block", F.get("_slots", (F.col("block") % step).cast("int")).alias("slot"), "place"))


def mix_order(docs: DataFrame, weights: dict | None = None, rules: MixRules = MixRules(),
              id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows of ``docs``, its columns only, in the order of the schedule:
    range-partitioned and sorted by slot, so files written from it follow one
    another in mixing order."""
    return (mixed(docs, weights, rules, id_col, source_col)
            .repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("_row.*"))
