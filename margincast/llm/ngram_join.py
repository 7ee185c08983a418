"""Jaccard self-join on word n-grams by rare-first prefix filtering.

A document is the set of its distinct n-word shingles.  Two documents with
Jaccard similarity t or more share a shingle among their first
n - ceil(t n) + 1 in any order that all documents use; the order here is by
document frequency, rarest first.

1. Frequencies.  Documents fall into blocks by a hash of their id.  A block
   sends its distinct shingles with block counts to hash shards, which answer
   with corpus counts: a shingle that is everywhere is one entry per block.
2. Survivors.  A document whose shared shingles (frequency 2 or more) are too
   few for any partner is done.  The others keep their shared shingles, rarest
   first.  Equal sets become one class with one representative.
3. Candidates.  Prefix shingles of representatives are joined.  In rounds,
   every representative first proposes the partner it shares most prefix
   shingles with, among the smallest ones of each size band, and verified pairs
   merge into components.  Then all remaining pairs - sharing a prefix shingle,
   in different components - are proposed, after the length filter, the
   positional filter and a bit-signature bound on the sets' difference.  Nothing inside a component needs a link, so a large
   group of near copies costs a few pairs per member instead of all pairs.
4. A proposed pair is verified once: a suffix filter bounds the overlap from
   counts per hash range, then the sets are intersected.

The result is exact up to 64-bit hash collisions of shingles.

Defined results: texts without words have an empty set and link with nothing;
fewer words than n make one shingle of the whole sequence; rows that repeat an
id are one document with the union of their links and give a row each; a null
id has a null component and links with nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margincast.llm.common import discard, pack_ints, shard_of, split_words, text_bytes, unpack_ints, word_codes, written
from margincast.llm.graph import components

#: The frequency exchange uses the upper 48 bits: a shingle unique in them is unique.
CUT = np.uint64(16)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class JaccardRules:
    n: int = 5
    percent: int = 75                # 100 * intersection >= percent * union
    block_bytes: int = 5 << 20       # text per block
    shard_bytes: int = 12 << 20      # text per shard of the frequency exchange
    star_rounds: int = 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, shingle hash) pairs of a batch, sorted by row and hash."""
    found, rows = split_words(texts)
    names, code = word_codes(found)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = names[code]
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for i in range(n):
        total += _mix(h[i:len(h) - n + 1 + i] * np.uint64(2 * i + 3))
    whole = rows[:len(total)] == rows[n - 1:] if len(total) else np.zeros(0, bool)
    out_rows, out = [rows[:len(total)][whole]], [_mix(total[whole])]
    counts = np.bincount(rows)
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        lo = int(np.searchsorted(rows, r))
        short = h[lo:lo + counts[r]]
        out_rows.append(np.array([r]))
        out.append(_mix(np.array([sum(int(x) * (2 * i + 3) for i, x in enumerate(short)) + len(short)
                                  & 0xFFFFFFFFFFFFFFFF], dtype=object).astype(np.uint64)))
    r, s = np.concatenate(out_rows), np.concatenate(out)
    order = np.lexsort((s, r))
    r, s = r[order], s[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1])
    return r[first], s[first]


def _gaps(sorted_: np.ndarray) -> bytes:
    return pack_ints(np.diff(sorted_, prepend=np.uint64(0)))


def _ungaps(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack_ints(blob, np.uint64, n), dtype=np.uint64)


# ---- 1. frequencies ------------------------------------------------------

def _blocks(docs: DataFrame, n_blocks: int, id_col: str, text_col: str) -> DataFrame:
    d = F.col(id_col).cast("long")
    return docs.select(F.pmod(F.xxhash64(d), F.lit(n_blocks)).alias("block"), d.alias("doc_id"), F.col(text_col).alias("t"))


def frequencies(blocked: DataFrame, shards: int, n: int) -> DataFrame:
    """(block, shard, n, df): corpus frequencies of a block's distinct shingles
    in a shard, in ascending order of the shingles."""
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, s = shingles(table["t"].combine_chunks(), n)
        names, count = np.unique(s >> CUT, return_counts=True)
        cut = np.searchsorted(shard_of(names << CUT, shards), np.arange(shards + 1))
        full = [i for i in range(shards) if cut[i] < cut[i + 1]]
        return pa.table({"shard": pa.array(full, pa.int32()), "block": pa.array([key[0].as_py()] * len(full), pa.int64()),
                         "n": pa.array([int(cut[i + 1] - cut[i]) for i in full], pa.int64()),
                         "names": pa.array([_gaps(names[cut[i]:cut[i + 1]]) for i in full], pa.binary()),
                         "counts": pa.array([pack_ints(count[cut[i]:cut[i + 1]]) for i in full], pa.binary())})

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        names = np.concatenate([_ungaps(r["names"], r["n"]) for r in rows])
        counts = np.concatenate([unpack_ints(r["counts"], np.int64, r["n"]) for r in rows])
        known, inverse = np.unique(names, return_inverse=True)
        df = np.bincount(inverse, weights=counts, minlength=len(known)).astype(np.int64)[inverse]
        ends = np.cumsum([r["n"] for r in rows])
        return pa.table({"block": pa.array([r["block"] for r in rows], pa.int64()),
                         "shard": pa.array([r["shard"] for r in rows], pa.int32()),
                         "n": pa.array([r["n"] for r in rows], pa.int64()),
                         "df": pa.array([pack_ints(df[e - r["n"]:e]) for r, e in zip(rows, ends)], pa.binary())})

    # grouped with the columns that survivors() groups, so that both read one shuffle of the texts
    asked = blocked.groupBy("block").applyInArrow(ask, "shard int, block long, n long, names binary, counts binary")
    return asked.groupBy("shard").applyInArrow(answer, "block long, shard int, n long, df binary")


# ---- 2. survivors --------------------------------------------------------

def need(n: int, percent: int) -> int:
    """Shared shingles a set of ``n`` needs at least, whatever its partner."""
    return -(-percent * n // 100)


def survivors(blocked: DataFrame, freq: DataFrame, rules: JaccardRules) -> DataFrame:
    """(doc_id, n, r, elems, digest): ``r`` shared shingles, rarest first, of
    documents that can have a partner; others carry nulls."""
    schema = "doc_id long, n long, r long, elems binary, digest binary"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = left["t"].combine_chunks() if left.num_rows else pa.array([], pa.string())
        rows, s = shingles(texts, rules.n)
        parts = sorted(right.to_pylist(), key=lambda r: r["shard"])
        df = np.concatenate([unpack_ints(p["df"], np.int64, p["n"]) for p in parts]) if parts else np.zeros(0, np.int64)
        # the block's distinct shingles in the order they were asked for
        top = s >> CUT
        df = df[np.searchsorted(np.unique(top), top)] if len(top) else df
        size = np.bincount(rows, minlength=left.num_rows)
        shared = np.bincount(rows[df > 1], minlength=left.num_rows) if len(rows) else size
        ids = left["doc_id"].to_pylist()
        ends = np.cumsum(size)
        out_r, elems, digest = [], [], []
        for i in range(left.num_rows):
            n, r = int(size[i]), int(shared[i])
            if n == 0 or ids[i] is None or r < need(n, rules.percent):
                out_r.append(None)
                elems.append(None)
                digest.append(None)
                continue
            mine, f = s[ends[i] - n:ends[i]], df[ends[i] - n:ends[i]]
            keep = f > 1
            order = np.lexsort((mine[keep], f[keep]))
            out_r.append(r)
            elems.append(mine[keep][order].tobytes())
            # only sets without a unique shingle can have an equal
            digest.append(hashlib.blake2b(mine.tobytes() if r == n else b"doc %d" % ids[i], digest_size=16).digest())
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(out_r, pa.int64()),
                                     pa.array(elems, pa.binary()), pa.array(digest, pa.binary())],
                                    names=["doc_id", "n", "r", "elems", "digest"])

    return blocked.groupBy("block").cogroup(freq.groupBy("block")).applyInArrow(run, schema)


# ---- 3. candidates -------------------------------------------------------

def postings(reps: DataFrame, percent: int) -> DataFrame:
    """(h, doc, n, pos): prefix shingles of every representative and their
    positions in its whole order (unique shingles come first)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, n, r, elems in zip(*[c.to_pylist() for c in batch.columns]):
                first = n - r
                e = n - need(n, percent) + 1 - first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(elems, np.int64)[:e]), pa.array(np.full(e, d, np.int64)),
                     pa.array(np.full(e, n, np.int64)), pa.array(np.arange(first, first + e, dtype=np.int64))],
                    names=["h", "doc", "n", "pos"])
    return reps.select("doc", "n", "r", "elems").mapInArrow(run, "h long, doc long, n long, pos long")


WORDS = 8                            # longs of a signature


def signatures(reps: DataFrame) -> DataFrame:
    """(doc, r, s0 .. s7): every shared shingle flips one of 512 bits.  Two
    signatures differ in at most as many bits as the sets differ in shingles."""
    names = [f"s{i}" for i in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for elems in batch.column(2).to_pylist():
                bit = (np.frombuffer(elems, np.uint64) & np.uint64(64 * WORDS - 1)).astype(np.int64)
                odd = np.bincount(bit, minlength=64 * WORDS) & 1
                rows.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            cols = np.array(rows, np.int64).reshape(len(rows), WORDS).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c) for c in cols]],
                                             names=["doc", "r", *names])
    return reps.select("doc", "r", "elems").mapInArrow(run, "doc long, r long, " + ", ".join(f"{x} long" for x in names))


def verified(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, 16, dtype=np.uint64) << np.uint64(60))
        for batch in batches:
            keep = []
            for i, (na, ea, nb, eb) in enumerate(zip(*[c.to_pylist() for c in batch.columns[2:]])):
                x, y = np.sort(np.frombuffer(ea, np.uint64)), np.sort(np.frombuffer(eb, np.uint64))
                least = -(-percent * (na + nb) // (100 + percent))
                # suffix filter: shared shingles per hash range at most the smaller count
                cx, cy = np.searchsorted(x, edges), np.searchsorted(y, edges)
                bound = np.minimum(np.diff(cx, prepend=0, append=len(x)), np.diff(cy, prepend=0, append=len(y))).sum()
                if bound >= least and len(np.intersect1d(x, y, assume_unique=True)) >= least:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())),
                                              batch.column(1).take(pa.array(keep, pa.int64()))], names=["a", "b"])
    side = reps.select("doc", "n", "elems")
    full = (pairs.join(side.toDF("a", "na", "ea"), "a").join(side.toDF("b", "nb", "eb"), "b")
            .select("a", "b", "na", "ea", "nb", "eb"))
    return full.mapInArrow(run, "a long, b long")


def _fits(small, large, percent: int):
    """Length filter: the smaller set is large enough for the larger."""
    return small * 100 >= large * percent


def star_pairs(post: DataFrame, percent: int) -> DataFrame:
    """One partner per representative and round: of each shingle and size band
    the smallest member of the smallest component is proposed to members of
    other components; each takes the one it meets most often."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    p = post.withColumn("band", band)
    center = p.groupBy("h", "band").agg(F.min(F.struct("label", "n", "doc")).alias("c"), F.max("label").alias("top"))
    center = center.where(F.col("c.label") != F.col("top"))
    met = (p.join(center, ["h", "band"]).where((F.col("label") != F.col("c.label"))
                                                & _fits(F.least("n", "c.n"), F.greatest("n", "c.n"), percent))
           .groupBy("doc", F.col("c.doc").alias("center")).agg(F.count(F.lit(1)).alias("k")))
    best = met.groupBy("doc").agg(F.max(F.struct("k", (-F.col("center")).alias("c"))).alias("m"))
    return best.select(F.col("doc").alias("a"), (-F.col("m.c")).alias("b"))


def remaining_pairs(post: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """All pairs that share a prefix shingle, pass the filters and are not yet
    in one component.  Of a shingle's members the largest component stands on
    one side only, so its members never meet each other."""
    per = post.groupBy("h", "label").agg(F.count(F.lit(1)).alias("k"))
    major = per.groupBy("h").agg(F.max(F.struct("k", "label")).alias("m"), F.count(F.lit(1)).alias("labels"))
    mixed = major.where(F.col("labels") > 1).select("h", F.col("m.label").alias("major"))
    p = post.join(mixed, "h").join(sigs, "doc")
    sig = [c for c in sigs.columns if c not in ("doc", "r")]
    x = p.where(F.col("label") != F.col("major")).select(
        "h", *[F.col(c).alias(f"{c}_x") for c in ("doc", "n", "pos", "label", "r", *sig)])
    total = F.col("n") + F.col("n_x")
    # shingles the two sets can't share: unique ones, and at least the bits their signatures differ in
    apart = total - F.col("r") - F.col("r_x") + sum([F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_x"))) for c in sig], F.lit(0))
    both = x.join(p, "h").where(
        (F.col("label_x") != F.col("label")) & ((F.col("label") == F.col("major")) | (F.col("doc_x") < F.col("doc")))
        & _fits(F.least("n", "n_x"), F.greatest("n", "n_x"), percent)
        # positional filter: what is left after this shingle must do
        & ((F.least(F.col("n") - F.col("pos"), F.col("n_x") - F.col("pos_x"))) * (100 + percent) >= percent * total)
        & (apart * (100 + percent) <= total * (100 - percent)))
    return both.select(F.least("doc", "doc_x").alias("a"), F.greatest("doc", "doc_x").alias("b")).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (v, c) after more links (a, b).  A component's label stands for
    its members, so only distinct links between components are followed."""
    spark = labels.sparkSession
    ends = (links.join(labels.toDF("a", "_la"), "a", "left").join(labels.toDF("b", "_lb"), "b", "left")
            .select(F.coalesce("_la", "a").alias("a"), F.coalesce("_lb", "b").alias("b")).where("a <> b").distinct())
    joined = components(ends, "jaccard")
    moved = (labels.join(joined.toDF("c", "_new"), "c", "left").select("v", F.coalesce("_new", "c").alias("c")))
    fresh = joined.join(labels.select("v"), "v", "left_anti").select("v", "c")
    out = written(moved.union(fresh), "jaccard-labels")
    discard(spark, labels)
    discard(spark, joined)
    return out


def linked(reps: DataFrame, rules: JaccardRules) -> DataFrame:
    """``doc, label`` of representatives that link with another."""
    spark = reps.sparkSession
    raw = written(postings(reps, rules.percent), "jaccard-postings")
    # a prefix shingle that one representative holds proposes nothing
    shared = raw.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("h")
    post = written(raw.join(shared, "h"), "jaccard-postings")
    discard(spark, raw)
    sigs = written(signatures(reps), "jaccard-signatures")
    labels = None

    def relabelled():
        if labels is None:
            return post.withColumn("label", F.col("doc"))
        return (post.join(labels.select(F.col("v").alias("doc"), F.col("c").alias("_l")), "doc", "left")
                .select("h", "doc", "n", "pos", F.coalesce("_l", "doc").alias("label")))

    for step in range(rules.star_rounds + 1):
        last = step == rules.star_rounds
        pairs = remaining_pairs(relabelled(), sigs, rules.percent) if last else star_pairs(relabelled(), rules.percent)
        found = written(verified(pairs, reps, rules.percent), "jaccard-links")
        if not found.limit(1).count():
            continue
        labels = components(found, "jaccard") if labels is None else merged(labels, found)
        discard(spark, found)
    discard(spark, post)
    return (spark.createDataFrame([], "doc long, label long") if labels is None
            else labels.select(F.col("v").alias("doc"), F.col("c").alias("label")))


def near_duplicates(docs: DataFrame, rules: JaccardRules = JaccardRules(), id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    size = text_bytes(docs, text_col)
    n_blocks, shards = max(1, -(-size // rules.block_bytes)), max(1, -(-size // rules.shard_bytes))
    blocked = _blocks(docs, n_blocks, id_col, text_col)
    freq = frequencies(blocked, shards, rules.n)
    found = written(survivors(blocked, freq, rules), "jaccard-sets")
    alive = found.where(F.col("elems").isNotNull())
    classes = alive.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    member = alive.select("doc_id", "digest").distinct().join(classes, "digest")
    # a representative's set; rows that repeat its id add theirs
    reps = written(alive.select("digest", F.col("doc_id").alias("doc"), "n", "r", "elems")
                   .join(classes, "digest").where(F.col("doc") == F.col("rep")).select("doc", "digest", "n", "r", "elems")
                   .dropDuplicates(["doc", "digest"]), "jaccard-reps")
    labels = linked(reps.select("doc", "n", "r", "elems"), rules)
    # documents -> representative -> component of representatives
    # (the smallest document of a class stands for it, so labels are smallest documents too)
    ids = (member.join(labels.withColumnRenamed("doc", "rep"), "rep", "left")
           .groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("component")))
    return (found.select("doc_id", F.col("n").alias("n_shingles"))
            .join(ids, "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
