"""Line de-duplication with two Bloom filters.

Pass 1 sends the 64-bit hash of every line key to its hash range, once for a
run of documents; a range fills two Bloom filters, batch by batch: a hash's
first sighting sets its bits in the once-filter, any later sighting sets them
in the twice-filter.  Pass 2 shuffles only lines the twice-filters suspect;
grouping them by a 128-bit digest confirms real repeats exactly and picks the
document that keeps the line.  Pass 3 drops the confirmed lines.

Filters are sized by the counted keys and split by hash range, so a task's
filters stay small and the share of false suspects stays the same on any
amount of data.  The twice-filters are broadcast up to ``broadcast_bytes``;
beyond that their hashes meet the keys' in a shuffle join, with equal results.
False suspects shuffle more and never change the result: grouping is exact.

Defined results: null or empty text is one empty line; lines repeated inside
one document count once for it; a document given twice (same id) is one
document and both rows lose the same lines; of equal lines the largest id
keeps its own, and all of them where one document repeats it; rows with a
null id take no part and keep their lines; an empty table gives an empty
result; a text of any length is read whole; other columns travel with the row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from margincast.llm.common import packed, shard_of, written

_STRIP = b" \t\n\x0b\x0c\r"
PLACES = 4                           # bits a key sets in a filter


@dataclass(frozen=True)
class LineRules:
    min_chars: int = 40
    min_docs: int = 5
    bits_per_key: int = 16           # of each filter
    range_keys: int = 1 << 18        # counted keys a hash range holds
    run_keys: int = 1 << 20          # keys a task holds at a time
    broadcast_bytes: int = 64 << 20  # of the twice-filters of all ranges


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A line's key, or None below ``min_chars`` code points."""
    key = line.strip(_STRIP).lower()
    n = len(key)
    if n < min_chars or (n < 4 * min_chars and not key.isascii() and len(key.decode("utf-8")) < min_chars):
        return None
    return key


def doc_keys(text: bytes, min_chars: int) -> set[bytes]:
    """Distinct keys of one text."""
    return {k for line in text.split(b"\n") if (k := line_key(line, min_chars)) is not None}


def _places(hashes: np.ndarray, mask: np.ndarray | np.uint64) -> list[np.ndarray]:
    """Bit positions of every key in a filter of ``mask`` + 1 bits."""
    a, b = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return [(a + np.uint64(i) * b) & mask for i in range(PLACES)]


def _set(filt: np.ndarray, at: list[np.ndarray]) -> None:
    for x in at:
        filt[x] = True


def _has(filt: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
    out = filt[at[0]]
    for x in at[1:]:
        out = out & filt[x]
    return out


def filter_bits(keys: int, bits_per_key: int) -> int:
    """Size of a filter for ``keys`` keys: a power of two, at least one byte."""
    return 1 << max(3, (keys * bits_per_key - 1).bit_length())


def _binary(col: pa.ChunkedArray | pa.Array) -> list:
    return col.cast(pa.binary()).to_pylist()


def key_hashes(docs: DataFrame, rules: LineRules, id_col: str, text_col: str) -> DataFrame:
    """``h`` (64-bit hash of a line key, signed) and ``again`` (a document seen
    before in the same run of documents has it too), once a run and key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.array(held, dtype=np.uint64), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n > 1)], names=["h", "again"])

        for batch in batches:
            for t in _binary(batch.column(0)):
                held.extend(xxhash.xxh3_64_intdigest(k) for k in doc_keys(t, rules.min_chars))
                if len(held) >= rules.run_keys:
                    yield out()
        if held:
            yield out()

    return (docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))
            .mapInArrow(run, "h long, again boolean"))


def twice_seen(keys: DataFrame, rules: LineRules) -> tuple[DataFrame, int]:
    """Per hash range the filter of the keys seen twice (``filter``) and their
    hashes (``hashes``); and the number of ranges.  A range's two filters are
    sized by the counted keys, so they are as selective on any amount of data."""
    n = keys.count()
    ranges = max(1, -(-n // rules.range_keys))
    size = filter_bits(-(-n // ranges), rules.bits_per_key)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice, found = np.zeros(size, bool), np.zeros(size, bool), []
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            again = batch.column("again").to_numpy(zero_copy_only=False)
            h, at, n = np.unique(h, return_inverse=True, return_counts=True)
            again = (n > 1) | (np.bincount(at, weights=again) > 0)
            places = _places(h, np.uint64(size - 1))
            new = (again | _has(once, places)) & ~_has(twice, places)
            _set(once, places)
            _set(twice, [x[new] for x in places])
            found.append(h[new])
        h = np.concatenate(found)
        # what travels on is sized by the keys it holds
        small = np.zeros(filter_bits(len(h), rules.bits_per_key), bool)
        _set(small, _places(h, np.uint64(len(small) - 1)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(small, bitorder="little").tobytes()], pa.binary()),
             pa.array([h.view(np.int64)], pa.list_(pa.int64()))], names=["range", "filter", "hashes"])

    at = F.shiftright(F.shiftrightunsigned("h", 32) * F.lit(ranges).cast("long"), 32)
    out = keys.groupBy(at.alias("range")).applyInArrow(run, "range long, filter binary, hashes array<long>")
    return out, ranges


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


class TwiceFilter:
    """The filters of all ranges as one array of bytes."""

    def __init__(self, parts: dict[int, bytes], ranges: int):
        self.ranges = ranges
        filters = [np.frombuffer(parts.get(i, b"\0"), np.uint8) for i in range(ranges)]
        sizes = np.array([len(x) for x in filters], np.uint64)
        self.mask = sizes * np.uint64(8) - np.uint64(1)
        self.first = np.cumsum(sizes) - sizes
        self.bytes = np.concatenate(filters)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = shard_of(hashes, self.ranges)
        out = np.ones(len(hashes), bool)
        for x in _places(hashes, self.mask[at]):
            out &= (self.bytes[self.first[at] + (x >> np.uint64(3))] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def doc_digests(docs: DataFrame, rules: LineRules, id_col: str, text_col: str, twice: TwiceFilter | None) -> DataFrame:
    """(doc_id, digest, h) of the distinct keys of every document, or of those
    the filter suspects."""
    sent = docs.sparkSession.sparkContext.broadcast(twice)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filt = sent.value
        for batch in batches:
            ids, keys = [], []
            for d, t in zip(batch.column(0).to_pylist(), _binary(batch.column(1))):
                for k in doc_keys(t, rules.min_chars):
                    ids.append(d)
                    keys.append(k)
            h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
            at = np.flatnonzero(filt.has(h)) if filt is not None else np.arange(len(h))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[i] for i in at], pa.int64()), pa.array([_digest(keys[i]) for i in at], pa.binary()),
                 pa.array(h[at].view(np.int64))], names=["doc_id", "digest", "h"])

    return (docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
            .mapInArrow(pick, "doc_id long, digest binary, h long"))


def suspects(docs: DataFrame, rules: LineRules, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest) of the keys the twice-filter holds."""
    parts, ranges = twice_seen(written(key_hashes(docs, rules, id_col, text_col), "line-keys"), rules)
    parts = written(parts, "line-filters")
    size = parts.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size <= rules.broadcast_bytes:
        held = TwiceFilter({r["range"]: bytes(r["filter"]) for r in parts.select("range", "filter").collect()}, ranges)
        return doc_digests(docs, rules, id_col, text_col, held).select("doc_id", "digest")
    # too large to send to every task: the suspected hashes meet the keys' hashes in a shuffle join
    return (doc_digests(docs, rules, id_col, text_col, None)
            .join(parts.select(F.explode("hashes").alias("h")), "h", "left_semi").select("doc_id", "digest"))


def drop_lists(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document that loses lines: the digests of the keys it loses."""
    held = written(suspects(docs, rules, id_col, text_col), "line-suspects")
    # repeated rows of one id count once; both sides of the join are then plain tables,
    # so a line that is everywhere can be split over tasks
    repeats = written(held.distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
                      .where(F.col("n") >= rules.min_docs).select("digest", "keeper"), "line-repeats")
    return (held.join(repeats, "digest").where(F.col("doc_id") != F.col("keeper"))
            .groupBy("doc_id").agg(F.collect_set("digest").alias("digests")))


def kept_lines(text: str | None, drop: set[bytes], min_chars: int) -> tuple[int, int, str]:
    """Lines before dropping, lines dropped, and the text without them."""
    if not drop:
        return (text or "").count("\n") + 1, 0, text or ""
    lines = text.split("\n")
    kept = []
    for line in lines:
        key = line_key(line.encode("utf-8"), min_chars)
        if key is None or _digest(key) not in drop:
            kept.append(line)
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedup_lines(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_row`` (the packed input row without its text), ``doc_id``,
    ``n_lines``, ``n_dropped`` and ``_text`` (the remaining text)."""
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    drops = drop_lists(docs, rules, id_col, text_col).withColumnRenamed("doc_id", "_id")
    both = (docs.select(packed(rest), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_t"))
            .join(drops, F.col("doc_id") == F.col("_id"), "left")
            .select("_row", "doc_id", "_t", "digests"))
    min_chars = rules.min_chars

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [kept_lines(t, set(d or ()), min_chars)
                    for t, d in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in done], pa.int64()),
                 pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.string())],
                names=["_row", "doc_id", "n_lines", "n_dropped", "_text"])

    schema = T.StructType([both.schema["_row"], both.schema["doc_id"], T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType()), T.StructField("_text", T.StringType())])
    return both.mapInArrow(apply, schema)
