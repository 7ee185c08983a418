"""Phrase collocations by SON partitioning.

Documents are dealt into a fixed number of shards by a hash of their id; a shard
is mined by as many tasks as its size asks for.

1. Words.  Exact counts per language; words below the support can't be part of
   a phrase.  Every (language, shard) gets its share of the words, and with it
   its local support: ``ceil(min_count * share)``.  A phrase that reaches
   ``min_count`` overall reaches the local support in some shard, because the
   shares sum to one.
2. Mining.  Every shard is mined completely at its local support, level by level:
   pairs of frequent words first, then phrases of 3 to ``max_words`` words all of
   whose pairs were frequent somewhere.  Tasks send counted hashes by hash range,
   so a phrase that is everywhere is one entry per task and shard, and a range
   is bounded whatever the shard's size.
3. The union of the locally frequent phrases is counted over all documents, with
   the phrases' texts.

Between the passes, frequent hashes travel as a bit filter: sized from their count,
at most ``max_filter_bits``.  A filter can only let too much through, and
what it lets through is counted and then held against the support, so results are
exact up to 64-bit hash collisions (which could only lose a phrase in pass 2 if
two phrases of one shard shared a hash; counts in pass 3 are of texts).

Words and pieces: A-Z lower-cased, pieces end at ``.,;:!?`` and line breaks, words
are runs of anything but space and tab.  The score of a phrase is the lowest over
its cuts in two of ``floor(1000 * a * n / (l * r))``, in exact decimals.

Defined results: a null text is empty; a null language is ``und``; a null id is
dealt like any other; repeated rows count again; ties go to the shortest first
part (cuts) and the smaller phrase in byte order (ranks); long texts are taken in
runs of about ``RUN`` tokens, cut where a piece ends; an empty table gives no
rows; only the id, language and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from margincast.llm.common import pack_ints, shard_of, text_bytes, unpack_ints, written

#: Characters that end a piece, all read as a comma (which no word can hold).
ENDS = bytes.maketrans(b".;:!?\n\x0b\x0c\r", b",,,,,,,,,")
#: Tokens counted at a time, and distinct words counted before they are sent.
RUN, KNOWN = 1 << 19, 1 << 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class PhraseRules:
    min_count: int = 100
    max_words: int = 5
    top: int = 2000
    #: A phrase goes if a longer one around it is found at least this often, in percent.
    percent: int = 100
    shards: int = 16
    #: Text bytes per hash range.
    range_bytes: int = 1 << 23
    #: Bound of a filter: 2^29 bits are 64 MB.
    max_filter_bits: int = 1 << 29


def tokens(text: str) -> list[bytes]:
    """Words, and a comma for every end of a piece."""
    return text.encode("utf-8").lower().translate(ENDS).replace(b",", b" , ").split()


def coded(lang: str, toks: list[bytes], frequent: BitFilter) -> np.ndarray:
    """Every token's 64-bit code within its language; 0 for what can't be in a phrase."""
    seed, index = lang.encode("utf-8") + b"\0", {}
    for i, w in enumerate(dict.fromkeys(toks)):
        index[w] = i
    codes = np.fromiter((word_code(seed, w) for w in index), np.uint64, len(index))
    codes[~frequent.holds(codes)] = 0
    if b"," in index:
        codes[index[b","]] = 0
    return codes[np.fromiter(map(index.__getitem__, toks), np.int64, len(toks))]


def word_code(seed: bytes, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(seed + word) or 1


class BitFilter:
    """Two bits per hash."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        ok = np.ones(len(hashes), bool)
        for at in places(hashes, self.mask):
            ok &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def places(hashes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return hashes & mask, ((hashes * _MIX) >> np.uint64(32)) & mask


def bit_filter(hashes: DataFrame, rules: PhraseRules) -> BitFilter:
    """The filter of a table of distinct hashes (h): its chunks are built by
    tasks, and the driver holds no more than the filter's bounded size."""
    n = hashes.count()
    size = 1 << 16
    while size < 16 * n and size < rules.max_filter_bits:
        size *= 2
    chunk, mask = min(size, 1 << 20), np.uint64(size - 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.unique(np.concatenate(places(h, mask)))
            yield pa.RecordBatch.from_arrays([pa.array((at // np.uint64(chunk)).astype(np.int32)),
                                              pa.array((at % np.uint64(chunk)).astype(np.int32))], names=["chunk", "at"])

    def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bits = np.zeros(chunk, np.uint8)
        bits[table["at"].to_numpy()] = 1
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros(size // 8, np.uint8)
    rows = (hashes.select("h").mapInArrow(deal, "chunk int, at int").groupBy("chunk").applyInArrow(build, "chunk int, bits binary"))
    for r in rows.collect():
        out[r["chunk"] * chunk // 8:(r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return BitFilter(out)


def _texts(docs: DataFrame, rules: PhraseRules, id_col: str, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
                       F.pmod(F.xxhash64(F.col(id_col)), F.lit(rules.shards)).cast("int").alias("shard"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("t"))


def count_words(texts: DataFrame) -> DataFrame:
    """``lang, word, shard, n``: per word its count (shard null), and per shard
    its number of words (word null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        totals: Counter = Counter()
        kept = 0

        def flush() -> pa.RecordBatch:
            rows = [(lang, w, None, n) for lang, c in found.items() for w, n in c.items() if w != b","]
            rows += [(lang, None, shard, n) for (lang, shard), n in totals.items()]
            found.clear()
            totals.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string()),
                 pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int64())],
                names=["lang", "word", "shard", "n"])

        for batch in batches:
            for lang, shard, t in zip(*(batch.column(i).to_pylist() for i in range(3))):
                toks = tokens(t)
                counts = found.setdefault(lang, Counter())
                before, ends = len(counts), counts[b","]
                counts.update(toks)
                totals[lang, shard] += len(toks) - (counts[b","] - ends)
                kept += len(counts) - before
                if kept >= KNOWN:
                    yield flush()
                    kept = 0
        yield flush()

    return (texts.mapInArrow(run, "lang string, word string, shard int, n long")
            .groupBy("lang", "word", "shard").agg(F.sum("n").alias("n")))


def _grams(codes: np.ndarray, ks: range, pair: BitFilter | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length, the starts and hashes of the phrases of that many words; no
    code 0 inside, and only pairs that the filter holds."""
    linked = (codes[:-1] != 0) & (codes[1:] != 0)
    if pair is not None:
        at = np.flatnonzero(linked)
        linked[at] = pair.holds(_hash(codes, at, 2))
    ok = linked
    for k in range(2, ks.stop):
        if k > 2:
            ok = ok[:-1] & linked[k - 2:]
        if k in ks:
            at = np.flatnonzero(ok)
            yield k, at, _hash(codes, at, k)


def _hash(codes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    h = codes[at]
    for i in range(1, k):
        h = h * _MIX + codes[at + i]
        h ^= h >> np.uint64(29)
    return h


def runs_of(toks: list[bytes]) -> Iterator[list[bytes]]:
    """A text's tokens in runs that end with a piece."""
    start = 0
    while len(toks) - start > RUN:
        cut = next((i for i in range(start + RUN, len(toks)) if toks[i] == b","), len(toks))
        yield toks[start:cut]
        start = cut
    if start < len(toks):
        yield toks[start:]


class _Runs:
    """Token runs of one language (and shard), counted when long enough."""

    def __init__(self):
        self.held: dict[tuple, list] = {}
        self.size = 0

    def add(self, key: tuple, toks: list[bytes]) -> None:
        run = self.held.setdefault(key, [])
        run.extend(toks)
        run.append(b",")
        self.size += len(toks) + 1

    def take(self) -> dict[tuple, list]:
        held, self.held, self.size = self.held, {}, 0
        return held


def mine(texts: DataFrame, supports: DataFrame, ks: range, words: BitFilter, pairs: BitFilter | None, ranges: int) -> DataFrame:
    """``h``: hashes of the phrases of ``ks`` words that reach the local support
    (lang, shard, need) of some shard."""
    sc = texts.sparkSession.sparkContext
    held_words, held_pairs = sc.broadcast(words), sc.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs()

        def flush() -> pa.RecordBatch:
            rows = []
            for (lang, shard, need), toks in runs.take().items():
                c = coded(lang, toks, held_words.value)
                found = [h for _, _, h in _grams(c, ks, held_pairs.value)]
                h, n = np.unique(np.concatenate(found), return_counts=True)
                part = shard_of(h, ranges)
                for r in np.unique(part):
                    a, b = np.searchsorted(part, [r, r + 1])
                    rows.append((shard, int(r), need, int(b - a), pack_ints(h[a:b]), pack_ints(n[a:b].astype(np.int32))))
            names = ["shard", "part", "need", "size", "h", "n"]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for lang, shard, need, t in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for toks in runs_of(tokens(t)):
                    runs.add((lang, shard, need), toks)
                    if runs.size >= RUN:
                        yield flush()
        if runs.size:
            yield flush()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sizes = table["size"].to_pylist()
        h = np.concatenate([unpack_ints(b, np.uint64, s) for b, s in zip(table["h"].to_pylist(), sizes)])
        n = np.concatenate([unpack_ints(b, np.int32, s) for b, s in zip(table["n"].to_pylist(), sizes)])
        need = np.repeat(table["need"].to_numpy(), sizes)
        order = np.argsort(h)
        h = h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        total = np.add.reduceat(n[order].astype(np.int64), first)
        return pa.table({"h": pa.array(h[first[total >= need[order][first]]].view(np.int64))})

    cols = [F.col(c) for c in ("lang", "shard", "need", "t")]
    counted = texts.join(supports, ["lang", "shard"]).select(*cols).mapInArrow(
        count, "shard int, part int, need long, size int, h binary, n binary")
    return counted.groupBy("shard", "part").applyInArrow(merge, "h long").distinct()


def count_phrases(texts: DataFrame, rules: PhraseRules, words: BitFilter, phrases: BitFilter) -> DataFrame:
    """``lang, phrase, size, n`` of all phrases that the filter holds, counted over all texts."""
    sc = texts.sparkSession.sparkContext
    held_words, held_phrases, ks = sc.broadcast(words), sc.broadcast(phrases), range(2, rules.max_words + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs()

        def flush() -> pa.RecordBatch:
            langs, found, sizes, counts = [], [], [], []
            for (lang,), toks in runs.take().items():
                c = coded(lang, toks, held_words.value)
                for k, at, h in _grams(c, ks, held_phrases.value):
                    keep = held_phrases.value.holds(h)
                    at, h = at[keep], h[keep]
                    _, first, n = np.unique(h, return_index=True, return_counts=True)
                    found += [b" ".join(toks[i:i + k]) for i in at[first].tolist()]
                    counts.append(n)
                    sizes.append(np.full(len(n), k, np.int32))
                    langs += [lang] * len(n)
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(found, pa.binary()).cast(pa.string()),
                 pa.array(np.concatenate(sizes)), pa.array(np.concatenate(counts).astype(np.int64))], names=["lang", "phrase", "size", "n"])

        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                for toks in runs_of(tokens(t)):
                    runs.add((lang,), toks)
                    if runs.size >= RUN:
                        yield flush()
        if runs.size:
            yield flush()

    return (texts.mapInArrow(count, "lang string, phrase string, size int, n long")
            .groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")))


def frequent_phrases(docs: DataFrame, rules: PhraseRules = PhraseRules(), id_col: str = "doc_id", lang_col: str = "lang",
                     text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Words and phrases that reach the support (lang, phrase, size, f), and the
    number of words per language (lang, n)."""
    texts = _texts(docs, rules, id_col, lang_col, text_col)
    counted = written(count_words(texts), "phrase-words")
    shards = counted.where("word is null").select("lang", "shard", F.col("n").alias("part"))
    totals = shards.groupBy("lang").agg(F.sum("part").alias("n"))
    # an integer division that rounds up
    supports = written(shards.join(totals.where(F.col("n") >= rules.min_count), "lang").select(
        "lang", "shard", F.expr(f"greatest(1, ({rules.min_count} * part + n - 1) div n)").alias("need")), "phrase-supports")
    words = written(counted.where(F.col("word").isNotNull() & (F.col("n") >= rules.min_count))
                    .select("lang", "word", F.col("n").alias("f")), "phrase-frequent-words")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [word_code(lang.encode("utf-8") + b"\0", w.encode("utf-8"))
                 for lang, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(h, np.uint64).view(np.int64))], names=["h"])

    frequent = bit_filter(words.select("lang", "word").mapInArrow(code, "h long"), rules)
    ranges = max(1, -(-text_bytes(docs, text_col) // (rules.shards * rules.range_bytes)))
    pairs = written(mine(texts, supports, range(2, 3), frequent, None, ranges), "phrase-pairs")
    longer = written(mine(texts, supports, range(3, rules.max_words + 1), frequent, bit_filter(pairs, rules), ranges),
                     "phrase-longer")
    candidates = bit_filter(pairs.union(longer), rules)
    found = (count_phrases(texts, rules, frequent, candidates).where(F.col("n") >= rules.min_count)
             .select("lang", "phrase", "size", F.col("n").alias("f")))
    both = words.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "f").union(found)
    return written(both, "phrase-counts"), totals


def collocations(docs: DataFrame, rules: PhraseRules = PhraseRules(), id_col: str = "doc_id", lang_col: str = "lang",
                 text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's best phrases."""
    found, totals = frequent_phrases(docs, rules, id_col, lang_col, text_col)
    cand = found.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"))
    w = F.split("phrase", " ")
    joined = lambda start, length: F.concat_ws(" ", F.slice("w", start, length))
    part = lambda name: found.select("lang", F.col("phrase").alias(f"{name}_phrase"), F.col("f").alias(name))
    cuts = (cand.withColumn("w", w).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
            .select("lang", "phrase", "size", "a", "k", joined(F.lit(1), F.col("k")).alias("l_phrase"),
                    joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("r_phrase")))
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    # products in 38 digits; the quotient is at most 1000 n
    score = F.expr(f"cast({wide('1000 * a')} * {wide('n')} as decimal(38, 0)) div cast({wide('l')} * {wide('r')} as decimal(38, 0))")
    scored = (cuts.join(part("l"), ["lang", "l_phrase"]).join(part("r"), ["lang", "r_phrase"]).join(totals, "lang")
              .withColumn("score", score).groupBy("lang", "phrase")
              .agg(F.min(F.struct("score", "k", "l", "r", "a", "n", "size")).alias("c")).select("lang", "phrase", "c.*"))
    inner = (cand.where("size > 2").withColumn("w", w).withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
             .withColumn("s", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
             .select("lang", joined(F.col("s"), F.col("m")).alias("phrase"), F.col("a").alias("around"))
             .groupBy("lang", "phrase").agg(F.max("around").alias("around")))
    kept = (scored.join(inner, ["lang", "phrase"], "left")
            .where(F.col("around").isNull() | (100 * F.col("around") < rules.percent * F.col("a"))))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # the first of every bucket, then of every language: no task ranks all phrases of a language
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(256))
    best = (kept.withColumn("b", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "b").orderBy(*order)))
            .where(F.col("rank") <= rules.top))
    return (best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= rules.top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
