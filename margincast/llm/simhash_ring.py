"""SimHash near-duplicates by pigeonring filtering.

1. Fingerprints.  The text (A-Z lower-cased) is read as shingles of ``n``
   words, repeats included; a fingerprint bit is 1 where more than half of the
   shingles' XXH64 values (UTF-8, seed 42) have it.
2. The ring.  The 64 bits lie on a ring of ``max_bits + 1`` segments.  If two
   fingerprints differ in at most ``max_bits`` bits, the differences per segment
   sum to less than the number of segments, so some segment starts a chain whose
   first l segments differ in at most l - 1 bits, for every l.  (Put the
   differences minus one around the ring: the sum is negative, so a start exists
   from which all partial sums stay negative.)
3. Candidates.  The chain's first two steps are the join key: segment i equal,
   segment i + 1 equal or one bit apart.  Every fingerprint gives its exact key
   per segment, and one key per set bit with that bit cleared: of two
   fingerprints one bit apart, one has the bit set.  Longer chains are then
   checked step by step, and the full distance last.
4. Groups.  Equal fingerprints are one vertex.  Each key first links its members
   to its smallest one, and what links merges into components; then only pairs
   of different components are left to join, so a group of near copies costs a
   few pairs a member.  No pair that could join two components is skipped.

Fingerprints, links and components are exact.

Defined results: a null or empty text has no shingle and fingerprint zero, which
links like any other; fewer words than ``n`` make one shingle; every row keeps
its row, also where ids repeat or are null (``component_id`` is the smallest id
that is not null among the rows reached, null if there is none); an empty table
gives no rows; long texts are hashed in runs of ``CHUNK`` shingles; only the id
and text columns are read, so names of others can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from margincast.llm.common import counted, discard, written
from margincast.llm.graph import components

#: Shingles hashed at a time.
CHUNK = 1 << 15


@dataclass(frozen=True)
class RingRules:
    n: int = 4
    max_bits: int = 4
    seed: int = 42


def fingerprint(text: str | None, rules: RingRules = RingRules()) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    line, n, seed = b" ".join(words), min(rules.n, len(words)), rules.seed
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = list(zip(starts[:len(words) - n + 1].tolist(), ends[n - 1:].tolist()))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), CHUNK):
        digests = b"".join([xxhash.xxh64_digest(line[a:b], seed) for a, b in spans[at:at + CHUNK]])
        bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, rules: RingRules = RingRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long), a row per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), rules) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
            .mapInArrow(run, "doc_id long, fp long"))


def segments(max_bits: int) -> list[int]:
    """The ring as bit masks, from the lowest bits up."""
    m = max_bits + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]


def _long(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _mask(masks: list[int], seg: Column) -> Column:
    return F.element_at(F.array(*[F.lit(_long(m)).cast("long") for m in masks]), seg + 1)


def chain_masks(max_bits: int, length: int) -> list[int]:
    """Per start segment, the bits of the ``length`` segments from there on."""
    ring = segments(max_bits)
    return [sum(ring[(i + j) % len(ring)] for j in range(length)) for i in range(len(ring))]


def _keys(vertices: DataFrame, rules: RingRules) -> tuple[DataFrame, DataFrame]:
    """Exact keys (seg, key, columns) and keys with one set bit of the second
    segment cleared (seg, key, columns), of vertices (fp, ...)."""
    ring, two = segments(rules.max_bits), chain_masks(rules.max_bits, 2)
    exact = (vertices.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(ring) - 1))).alias("seg"))
             .withColumn("key", F.col("fp").bitwiseAND(_mask(two, F.col("seg")))))
    start = [next(i for i, s in enumerate(ring) if ring[(i + 1) % len(ring)] >> b & 1) for b in range(64)]
    bits = F.array(*[F.struct(F.lit(_long(1 << b)).cast("long").alias("bit"), F.lit(start[b]).alias("seg")) for b in range(64)])
    cleared = (vertices.select("*", F.explode(F.filter(bits, lambda x: F.col("fp").bitwiseAND(x["bit"]) != 0)).alias("x"))
               .select(*vertices.columns, F.col("x.seg").alias("seg"),
                       (F.col("fp") - F.col("x.bit")).bitwiseAND(_mask(two, F.col("x.seg"))).alias("key")))
    return exact, cleared


def _near(x: Column, y: Column, seg: Column, rules: RingRules) -> Column:
    """Chains of 3, 4, .. segments within their budgets, then the whole distance."""
    differ = x.bitwiseXOR(y)
    steps = [F.bit_count(differ.bitwiseAND(_mask(chain_masks(rules.max_bits, k), seg))) < k
             for k in range(3, rules.max_bits + 1)]
    ok = F.bit_count(differ) <= rules.max_bits
    for step in reversed(steps):
        ok = step & ok
    return ok


def links(vertices: DataFrame, rules: RingRules = RingRules()) -> DataFrame:
    """``a, b``: links enough to join everything that is connected, among distinct
    fingerprints (fp).  Spark sizes the exploded keys by the files they come from, so
    their joins are told to merge: broadcast, they would not fit into the driver."""
    exact, cleared = _keys(vertices.select("fp"), rules)
    first = exact.groupBy("seg", "key").agg(F.min("fp").alias("b"))
    stars = (exact.union(cleared).join(first.hint("merge"), ["seg", "key"])
             .where((F.col("fp") != F.col("b")) & _near(F.col("fp"), F.col("b"), F.col("seg"), rules))
             .select(F.col("fp").alias("a"), "b").distinct())
    stars = written(stars, "ring-stars")
    labels = components(stars, "ring")
    named = written(vertices.select("fp").join(counted(labels), F.col("fp") == F.col("v"), "left")
                    .select("fp", F.coalesce("c", "fp").alias("c")), "ring-vertices")
    exact, cleared = _keys(named, rules)
    x = exact.withColumn("whole", F.lit(True)).union(cleared.withColumn("whole", F.lit(False))).alias("x")
    y = exact.hint("merge").alias("y")
    pairs = (x.join(y, (F.col("x.seg") == F.col("y.seg")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c"))
                    & (~F.col("x.whole") | (F.col("x.fp") < F.col("y.fp")))
                    & _near(F.col("x.fp"), F.col("y.fp"), F.col("x.seg"), rules))
             .select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct())
    rest = written(pairs, "ring-pairs")
    return stars.union(rest)


def near_duplicates(docs: DataFrame, rules: RingRules = RingRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 lowercase hex digits), ``component_id``."""
    spark = docs.sparkSession
    held = written(fingerprints(docs, rules, id_col, text_col), "ring-fingerprints")
    vertices = written(held.groupBy("fp").agg(F.min("doc_id").alias("first")), "ring-distinct")
    edges = links(vertices, rules)
    labels = components(edges, "ring-all")
    named = vertices.join(counted(labels), F.col("fp") == F.col("v"), "left").select("fp", "first", F.coalesce("c", "fp").alias("c"))
    named = written(named, "ring-named")
    least = named.groupBy("c").agg(F.min("first").alias("component_id"))
    names = written(named.join(least.hint("merge"), "c").select("fp", "component_id"), "ring-components")
    for t in (vertices, labels, named):
        discard(spark, t)
    return held.join(counted(names), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
