"""Class-based bigram language model after Brown.

Words are assigned to classes by exchange clustering; a text's probability is
the product of class transitions P(class | previous class) and word emissions
P(word | class).

1. Tasks turn their documents into blocks of token indices with the block's
   distinct words as hashes; blocks are written once.
2. Distinct words with their training counts go to hash shards, which add the
   counts of all blocks and answer every block with the corpus counts of its
   words.  Traffic is a block's distinct words, not its tokens, and a word
   that is everywhere is one entry per block.
3. Joined with its answers, a block gives its bigrams of items.  An item is
   one of the ``clustered`` most frequent words, or the count band of a rarer
   one (unseen words are band 0).  Item bigrams are counted over all training
   documents, a word's own sighting left out when its band is chosen, so that
   bands 0, 1, .. get the weight that new words really have.
4. The exchange algorithm runs on the item bigram table, whose size is bounded
   by ``clustered``, whatever the corpus; bands and the text end are classes of
   their own.
5. Every other word seen ``placed_from`` times or more in training documents
   then gets a class too: blocks send the counts of the classes beside it to
   its hash shard, which adds them up, picks the class under which these
   neighbours are likeliest and answers every block.  Their number grows with
   the corpus; only words seen less often stay in bands.
6. Class bigrams are counted anew with all words in their classes; the class
   model is sent to tasks and scores every document.

All counts cover all training documents and grow with them.

Defined results: null and empty texts are the text end alone; without training
documents every token is unknown; repeated rows count and score each; a null
id belongs to the training side; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margincast.llm.common import discard, pack_ints, shard_of, split_words, text_bytes, unpack_ints, word_codes, written

BANDS = 50
#: The text end as a token; no word contains a line break.
END = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))


@dataclass(frozen=True)
class BrownRules:
    clustered: int = 1000            # most frequent words, clustered by exchange
    placed_from: int = 2             # training sightings from which any other word is given a class
    classes: int = 40
    sweeps: int = 6
    folds: int = 7
    held_fold: int = 2
    block_words: int = 1_000_000
    shard_bytes: int = 16 << 20      # input text per shard


def band(counts: np.ndarray) -> np.ndarray:
    """0 for unseen words, else 1 + floor(log2(count))."""
    return np.where(counts > 0, np.frexp(counts.astype(np.float64))[1], 0).astype(np.int64)


# ---- 1. blocks -----------------------------------------------------------

def blocks(docs: DataFrame, rules: BrownRules, id_col: str, text_col: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % rules.folds == rules.held_fold, F.lit(False))
    size = rules.block_words

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(rows, ids, held_, texts):
            found, at = split_words(texts)
            hashes, code = word_codes(found)
            n = len(texts)
            # the text end follows each document's words
            ends = np.cumsum(np.bincount(at, minlength=n))
            tokens = np.insert(code, ends, len(hashes))
            hashes = np.append(hashes, END)
            lengths = np.bincount(at, minlength=n) + 1
            order = np.argsort(hashes)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            tokens = rank[tokens].astype(np.uint32)
            tf = np.bincount(tokens[np.repeat(~held_, lengths)], minlength=len(hashes)).astype(np.uint32)
            key = xxhash.xxh3_64_intdigest(b"%d" % len(rows) + np.array(rows, dtype=np.int64).tobytes()) >> 1
            return [key, n, len(tokens), len(hashes), np.ascontiguousarray(ids).tobytes(), held_.astype(np.uint8).tobytes(),
                    lengths.astype(np.uint32).tobytes(), pack_ints(tokens), pack_ints(hashes[order]), pack_ints(tf)]

        def out(row):
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, TYPES)], names=NAMES)

        for batch in batches:
            lengths = pa.compute.binary_length(pa.compute.fill_null(batch.column(2), "")).to_numpy(zero_copy_only=False)
            # about block_words words, at some six bytes each; a single long text is a block of its own
            group = (np.cumsum(lengths) // (size * 6)).astype(np.int64)
            for g in np.unique(group):
                lo, hi = np.searchsorted(group, [g, g + 1])
                part = batch.slice(int(lo), int(hi - lo))
                ids = part.column(0)
                null = np.array(ids.is_null(), dtype=np.uint8)
                row = block(part.column(3).to_pylist(), pa.compute.fill_null(ids, 0).to_numpy(), np.array(part.column(1), dtype=bool),
                            part.column(2))
                yield out([*row, null.tobytes()])

    TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
    NAMES = ["block", "n_docs", "n_tokens", "n_types", "ids", "held", "lengths", "tokens", "types", "tf", "null_id"]
    schema = ("block long, n_docs int, n_tokens long, n_types long, ids binary, held binary, lengths binary, tokens binary, "
              "types binary, tf binary, null_id binary")
    return docs.select(F.col(id_col).cast("long").alias("d"), held.alias("h"), F.col(text_col).alias("t"),
                       F.monotonically_increasing_id().alias("r")).mapInArrow(make, schema)


# ---- 2. corpus counts ----------------------------------------------------

def corpus_counts(table: DataFrame, shards: int, rules: BrownRules) -> DataFrame:
    """Rows of two kinds: answers (block, shard, n, counts) in the order of the
    block's hashes in that shard, and per shard (block null) its count bands
    and its most frequent words."""
    top = rules.clustered

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                types = unpack_ints(r["types"], np.uint64, r["n_types"])
                tf = unpack_ints(r["tf"], np.uint32, r["n_types"])
                cut = np.searchsorted(shard_of(types, shards), np.arange(shards + 1))
                full = [s for s in range(shards) if cut[s] < cut[s + 1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([r["block"]] * len(full), pa.int64()),
                     pa.array([int(cut[s + 1] - cut[s]) for s in full], pa.int64()),
                     pa.array([pack_ints(types[cut[s]:cut[s + 1]]) for s in full], pa.binary()),
                     pa.array([pack_ints(tf[cut[s]:cut[s + 1]]) for s in full], pa.binary())],
                    names=["shard", "block", "n", "types", "tf"])

    def answer(key: tuple[pa.Scalar, ...], table_: pa.Table) -> pa.Table:
        rows = table_.select(["block", "n", "types", "tf"]).to_pylist()
        types = np.concatenate([unpack_ints(r["types"], np.uint64, r["n"]) for r in rows])
        tf = np.concatenate([unpack_ints(r["tf"], np.uint32, r["n"]) for r in rows]).astype(np.int64)
        names, inverse = np.unique(types, return_inverse=True)
        total = np.bincount(inverse, weights=tf, minlength=len(names)).astype(np.int64)
        mine, out, at = key[0].as_py(), [], 0
        for r in rows:
            out.append((r["block"], mine, r["n"], pack_ints(total[inverse[at:at + r["n"]]]), None, None, None))
            at += r["n"]
        kinds = band(total)
        best = np.lexsort((names, -total))[:top]
        best = best[total[best] > 0]
        out.append((None, mine, len(best), pack_ints(total[best]), names[best].tobytes(),
                    np.bincount(kinds, minlength=BANDS).astype(np.int64).tolist(),
                    np.bincount(kinds, weights=total, minlength=BANDS).astype(np.int64).tolist()))
        cols = list(zip(*out))
        kinds_ = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_)],
                                    names=["block", "shard", "n", "counts", "names", "n_types", "n_tokens"])

    asked = table.select("block", "n_types", "types", "tf").mapInArrow(ask, "shard int, block long, n long, types binary, tf binary")
    return asked.groupBy("shard").applyInArrow(
        answer, "block long, shard int, n long, counts binary, names binary, n_types array<long>, n_tokens array<long>")


@dataclass
class Vocabulary:
    """Sums over the corpus and the words that are items of their own."""
    tokens: int                      # N
    types: int                       # V
    names: np.ndarray                # hashes of item words, ascending
    counts: np.ndarray
    band_tokens: np.ndarray          # of the words that are not items

    @property
    def n_items(self) -> int:
        return BANDS + len(self.names)


def vocabulary(counted: DataFrame, rules: BrownRules) -> Vocabulary:
    heads = counted.where(F.col("block").isNull())
    sums = heads.select(F.posexplode(F.arrays_zip("n_types", "n_tokens")).alias("band", "x")).groupBy("band").agg(
        F.sum("x.n_types").alias("v"), F.sum("x.n_tokens").alias("n")).collect()
    tokens, types = np.zeros(BANDS, np.int64), np.zeros(BANDS, np.int64)
    for r in sums:
        tokens[r["band"]], types[r["band"]] = r["n"], r["v"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(r["names"], np.int64)), pa.array(unpack_ints(r["counts"], np.int64, r["n"]))],
                    names=["name", "count"])
    top = (heads.select("n", "names", "counts").mapInArrow(rows, "name long, count long")
           .orderBy(F.col("count").desc(), "name").limit(rules.clustered).collect())
    names = np.array([r["name"] for r in top], np.int64).view(np.uint64)
    counts = np.array([r["count"] for r in top], np.int64)
    order = np.argsort(names)
    rest = tokens.copy()
    np.subtract.at(rest, band(counts), counts)
    return Vocabulary(int(tokens.sum()), int(types[1:].sum()), names[order], counts[order], rest)


# ---- 3. items and their bigrams ------------------------------------------

def items_of(types: np.ndarray, counts: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    out = band(counts)
    if len(vocab.names):
        at = np.minimum(np.searchsorted(vocab.names, types), len(vocab.names) - 1)
        own = vocab.names[at] == types
        out[own] = BANDS + at[own]
    return out


def _previous(now: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What stands before each token; the text end before each first word."""
    ends = np.cumsum(lengths)
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[ends - lengths] = now[ends - 1]
    return before


def itemised(table: DataFrame, counted: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Blocks with the corpus counts of their words and the item bigrams of
    their training documents."""
    answers = (counted.where(F.col("block").isNotNull()).groupBy("block")
               .agg(F.sort_array(F.collect_list(F.struct("shard", "n", "counts"))).alias("answers")))
    size = vocab.n_items
    held_vocab = table.sparkSession.sparkContext.broadcast(vocab)      # bounded by ``clustered``
    kept = ["block", "n_docs", "n_tokens", "n_types", "ids", "held", "lengths", "tokens", "types", "null_id"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held_vocab.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                r = row.to_pylist()[0]
                types = unpack_ints(r["types"], np.uint64, r["n_types"])
                counts = np.concatenate([unpack_ints(a["counts"], np.int64, a["n"]) for a in r["answers"]])
                tokens = unpack_ints(r["tokens"], np.uint32, r["n_tokens"])
                lengths = np.frombuffer(r["lengths"], np.uint32).astype(np.int64)
                held = np.frombuffer(r["held"], np.uint8).astype(bool)
                items = items_of(types, counts, v)
                # the sighting itself left out
                now = np.where(items >= BANDS, items, band(np.maximum(counts - 1, 0)))[tokens]
                train = np.repeat(~held, lengths)
                pairs, n = np.unique(_previous(now, lengths)[train] * size + now[train], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns[:len(kept)], pa.array([pack_ints(counts)], pa.binary()), pa.array([len(pairs)], pa.int64()),
                     pa.array([pack_ints(pairs)], pa.binary()), pa.array([pack_ints(n.astype(np.int64))], pa.binary())],
                    names=[*kept, "counts", "n_pairs", "pairs", "pair_counts"])

    return (table.join(answers, "block").select(*kept, "answers")
            .mapInArrow(make, "block long, n_docs int, n_tokens long, n_types long, ids binary, held binary, lengths binary, "
                        "tokens binary, types binary, null_id binary, counts binary, n_pairs long, pairs binary, pair_counts binary"))


def bigram_table(parts: DataFrame, size: int, pieces: int = 32) -> np.ndarray:
    """Bigrams of the whole corpus, ``size`` x ``size`` items (bounded by
    ``clustered``) or classes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        seen = False
        for batch in batches:
            for r in batch.to_pylist():
                seen = True
                total[unpack_ints(r["pairs"], np.int64, r["n_pairs"])] += unpack_ints(r["pair_counts"], np.int64, r["n_pairs"])
        if seen:
            edges = np.linspace(0, size * size, pieces + 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(pieces), pa.int32()),
                 pa.array([pack_ints(total[a:b]) for a, b in zip(edges, edges[1:])], pa.binary())], names=["piece", "counts"])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        edges = np.linspace(0, size * size, pieces + 1).astype(np.int64)
        k = key[0].as_py()
        n = int(edges[k + 1] - edges[k])
        total = sum(unpack_ints(b, np.int64, n) for b in table["counts"].to_pylist())
        return pa.table({"piece": pa.array([k], pa.int32()), "counts": pa.array([pack_ints(total)], pa.binary())})

    rows = (parts.where(F.col("pairs").isNotNull()).select("n_pairs", "pairs", "pair_counts").mapInArrow(cut, "piece int, counts binary")
            .groupBy("piece").applyInArrow(add, "piece int, counts binary").collect())
    edges = np.linspace(0, size * size, pieces + 1).astype(np.int64)
    out = np.zeros(size * size, np.int64)
    for r in rows:
        a, b = edges[r["piece"]], edges[r["piece"] + 1]
        out[a:b] = unpack_ints(bytes(r["counts"]), np.int64, int(b - a))
    return out.reshape(size, size)


# ---- 4. exchange clustering ----------------------------------------------

def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(bigrams: np.ndarray, vocab: Vocabulary, rules: BrownRules) -> np.ndarray:
    """Class of every item.  Bands and the text end keep classes of their own;
    each other word in turn moves to the class that raises the likelihood of
    the bigrams most, until a sweep moves none."""
    size = bigrams.shape[0]
    cls = np.arange(size)
    own = np.zeros(size, bool)
    own[BANDS:] = vocab.names != END
    movable = np.flatnonzero(own)
    fixed = np.flatnonzero(~own)
    cls[fixed] = np.arange(len(fixed))
    n_words = min(rules.classes, max(1, len(movable)))
    counts = np.zeros(size)
    counts[BANDS:] = vocab.counts
    order = movable[np.argsort(-counts[movable], kind="stable")]
    cls[order] = len(fixed) + np.arange(len(order)) % n_words
    total = len(fixed) + n_words
    m = bigrams.astype(np.float64)
    hot = np.zeros((size, total))
    hot[np.arange(size), cls] = 1.0
    g = hot.T @ m @ hot
    for _ in range(rules.sweeps):
        moved = 0
        for w in order:
            old = cls[w]
            right, left = m[w] @ hot, hot.T @ m[:, w]      # to and from classes
            loop = m[w, w]
            right[old] -= loop
            left[old] -= loop
            # take the word out of its class
            g[old] -= right
            g[:, old] -= left
            g[old, old] -= loop
            # what each class would gain: its row, its column and their crossing
            rows, cols = g[len(fixed):], g[:, len(fixed):].T
            k = np.arange(n_words)
            diag = g[len(fixed) + k, len(fixed) + k]
            r2, l2 = right[len(fixed) + k], left[len(fixed) + k]
            gain = (_xlogx(rows + right) - _xlogx(rows)).sum(1) + (_xlogx(cols + left) - _xlogx(cols)).sum(1)
            gain -= _xlogx(diag + r2) + _xlogx(diag + l2) - 2 * _xlogx(diag)
            gain += _xlogx(diag + r2 + l2 + loop) - _xlogx(diag)
            out, in_ = rows.sum(1), cols.sum(1)
            gain -= _xlogx(out + right.sum() + loop) - _xlogx(out) + _xlogx(in_ + left.sum() + loop) - _xlogx(in_)
            new = len(fixed) + int(np.argmax(gain))
            if gain[new - len(fixed)] <= gain[old - len(fixed)] + 1e-9:
                new = old
            moved += new != old
            cls[w] = new
            hot[w, old], hot[w, new] = 0.0, 1.0
            g[new] += right
            g[:, new] += left
            g[new, new] += loop
        if not moved:
            break
    return cls


@dataclass
class ClassModel:
    cls: np.ndarray                  # item -> class
    step: np.ndarray                 # log10 P(class | previous class)
    mass: np.ndarray                 # log10 of a class's training tokens, 0 for the unseen band
    first: int                       # item of the text end


def transitions(g: np.ndarray) -> np.ndarray:
    """log10 P(class | previous class) from class bigrams."""
    n = len(g)
    prior = (g.sum(axis=0) + 1.0) / (g.sum() + n)
    return np.log10((g + n * prior) / (g.sum(axis=1, keepdims=True) + n))


def fit_classes(bigrams: np.ndarray, vocab: Vocabulary, rules: BrownRules) -> ClassModel:
    cls = exchange(bigrams, vocab, rules)
    n = int(cls.max()) + 1
    hot = np.zeros((len(cls), n))
    hot[np.arange(len(cls)), cls] = 1.0
    step = transitions(hot.T @ bigrams @ hot)
    tokens = np.concatenate([vocab.band_tokens, vocab.counts]).astype(np.float64)
    mass = np.log10(np.maximum(hot.T @ tokens, 1.0))
    mass[cls[0]] = 0.0
    at = np.flatnonzero(vocab.names == END)
    first = BANDS + int(at[0]) if len(at) else 0
    return ClassModel(cls, step, mass, first)


# ---- 5. classes of the other words ---------------------------------------

def to_place(types: np.ndarray, counts: np.ndarray, items: np.ndarray, rules: BrownRules) -> np.ndarray:
    """Words that are no items of their own and frequent enough for a class."""
    return (items < BANDS) & (counts >= rules.placed_from) & (types != END)


def best_classes(word: np.ndarray, code: np.ndarray, seen: np.ndarray, counts: np.ndarray, model: ClassModel,
                 fixed: int) -> np.ndarray:
    """Class (``fixed`` or higher) of every word under which its neighbours and
    itself are likeliest, the other classes as they are.  ``seen`` sightings
    of ``word`` beside class ``code``: those before it first, those behind it
    with ``n`` added."""
    n = len(model.step)
    best, out = np.full(len(counts), -np.inf), np.full(len(counts), fixed, np.int64)
    for c in range(fixed, n):
        weight = np.concatenate([model.step[:, c], model.step[c]])
        score = (np.bincount(word, seen * weight[code], len(counts))
                 - counts * np.log10(10.0 ** model.mass[c] + counts))
        out[score > best] = c
        best = np.maximum(best, score)
    return out


def placed_classes(parts: DataFrame, shards: int, vocab: Vocabulary, model: ClassModel, rules: BrownRules) -> DataFrame:
    """Rows of two kinds, as in ``corpus_counts``: answers (block, shard, n,
    classes) for the words of a block that are placed, and per shard (block
    null) the tokens that classes gain and bands lose."""
    n, fixed = len(model.step), _fixed_classes(vocab)
    held_state = parts.sparkSession.sparkContext.broadcast((vocab, model))     # bounded by ``clustered``

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = held_state.value
        for batch in batches:
            for r in batch.to_pylist():
                types = unpack_ints(r["types"], np.uint64, r["n_types"])
                counts = unpack_ints(r["counts"], np.int64, r["n_types"])
                tokens = unpack_ints(r["tokens"], np.uint32, r["n_tokens"])
                lengths = np.frombuffer(r["lengths"], np.uint32).astype(np.int64)
                train = np.repeat(~np.frombuffer(r["held"], np.uint8).astype(bool), lengths)
                items = items_of(types, counts, v)
                open_ = to_place(types, counts, items, rules)
                mine = np.cumsum(open_) - 1
                now = m.cls[np.where(items >= BANDS, items, band(np.maximum(counts - 1, 0)))][tokens]
                # an open word is never the text end, so the token behind it is of the same text
                at = np.flatnonzero(train & open_[tokens])
                word = mine[tokens[at]]
                key = np.concatenate([word * 2 * n + _previous(now, lengths)[at], word * 2 * n + n + now[at + 1]])
                key, seen = np.unique(key, return_counts=True)
                asked, n_seen = types[open_], counts[open_]
                cut = np.searchsorted(shard_of(asked, shards), np.arange(shards + 1))
                full = [s for s in range(shards) if cut[s] < cut[s + 1]]
                edge = np.searchsorted(key, cut * 2 * n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int32()), pa.array([r["block"]] * len(full), pa.int64()),
                     pa.array([int(cut[s + 1] - cut[s]) for s in full], pa.int64()),
                     pa.array([pack_ints(asked[cut[s]:cut[s + 1]]) for s in full], pa.binary()),
                     pa.array([pack_ints(n_seen[cut[s]:cut[s + 1]]) for s in full], pa.binary()),
                     pa.array([int(edge[s + 1] - edge[s]) for s in full], pa.int64()),
                     pa.array([pack_ints(key[edge[s]:edge[s + 1]] - cut[s] * 2 * n) for s in full], pa.binary()),
                     pa.array([pack_ints(seen[edge[s]:edge[s + 1]].astype(np.int64)) for s in full], pa.binary())],
                    names=["shard", "block", "n", "types", "counts", "n_keys", "keys", "seen"])

    def answer(key_: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.select(["block", "n", "types", "counts", "n_keys", "keys", "seen"]).to_pylist()
        types = np.concatenate([unpack_ints(r["types"], np.uint64, r["n"]) for r in rows])
        names, first, inverse = np.unique(types, return_index=True, return_inverse=True)
        counts = np.concatenate([unpack_ints(r["counts"], np.int64, r["n"]) for r in rows])[first]
        at, keys = 0, []
        for r in rows:
            k = unpack_ints(r["keys"], np.int64, r["n_keys"])
            keys.append(inverse[at + k // (2 * n)] * 2 * n + k % (2 * n))
            at += r["n"]
        # whole counts are added before any logarithm: the order of blocks can't matter
        key, where = np.unique(np.concatenate(keys), return_inverse=True)
        seen = np.bincount(where, np.concatenate([unpack_ints(r["seen"], np.int64, r["n_keys"]) for r in rows]), len(key))
        cls = best_classes(key // (2 * n), key % (2 * n), seen, counts, held_state.value[1], fixed)
        mine, out, at = key_[0].as_py(), [], 0
        for r in rows:
            out.append((r["block"], mine, r["n"], pack_ints(cls[inverse[at:at + r["n"]]].astype(np.uint32)), None))
            at += r["n"]
        moved = np.bincount(cls, counts, n) - np.bincount(band(counts), counts, n)
        out.append((None, mine, len(names), None, moved.astype(np.int64).tolist()))
        cols = list(zip(*out))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["block", "shard", "n", "classes", "moved"])

    asked = (parts.select("block", "n_types", "n_tokens", "types", "counts", "tokens", "lengths", "held")
             .mapInArrow(ask, "shard int, block long, n long, types binary, counts binary, n_keys long, keys binary, seen binary"))
    return asked.groupBy("shard").applyInArrow(answer, "block long, shard int, n long, classes binary, moved array<long>")


def _fixed_classes(vocab: Vocabulary) -> int:
    """Bands and the text end, the classes before those of words."""
    return BANDS + int(np.isin(END, vocab.names))


# ---- 6. scores -----------------------------------------------------------

def classed(parts: DataFrame, placed: DataFrame, vocab: Vocabulary, model: ClassModel, rules: BrownRules) -> DataFrame:
    """Per document its base sums and class sequence; per block (``id`` and
    ``held`` null) the class bigrams of its training documents."""
    answers = (placed.where(F.col("block").isNotNull()).groupBy("block")
               .agg(F.sort_array(F.collect_list(F.struct("shard", "n", "classes"))).alias("answers")))
    n_all, v_all, n_cls = vocab.tokens, vocab.types, len(model.step)
    held_state = parts.sparkSession.sparkContext.broadcast((vocab, model))     # bounded by ``clustered``

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = held_state.value
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                types = unpack_ints(r["types"], np.uint64, r["n_types"])
                counts = unpack_ints(r["counts"], np.int64, r["n_types"])
                tokens = unpack_ints(r["tokens"], np.uint32, r["n_tokens"])
                lengths = np.frombuffer(r["lengths"], np.uint32).astype(np.int64)
                held = np.frombuffer(r["held"], np.uint8).astype(bool)
                ids, null = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["null_id"], np.uint8).astype(bool)
                items = items_of(types, counts, v)
                cls = m.cls[items]
                open_ = to_place(types, counts, items, rules)
                if open_.any():
                    cls[open_] = np.concatenate([unpack_ints(a["classes"], np.uint32, a["n"]) for a in r["answers"]])
                # the sighting itself left out
                less = np.where((items >= BANDS) | (open_ & (counts > rules.placed_from)), cls,
                                m.cls[band(np.maximum(counts - 1, 0))])
                doc = np.repeat(np.arange(len(ids)), lengths)
                base = np.bincount(doc, np.log10((counts + 1.0) / (n_all + 1.0 * (v_all + 1)))[tokens], len(ids))
                known = np.bincount(doc, (counts > 0)[tokens], len(ids))
                emit = np.bincount(doc, np.where(counts > 0, np.log10(np.maximum(counts, 1)), 0.0)[tokens], len(ids))
                ends = np.cumsum(lengths)
                train = ~held[doc]
                now = less[tokens]
                pairs, n = np.unique(_previous(now, lengths)[train] * n_cls + now[train], return_counts=True)
                small = cls[tokens].astype("<u1" if n_cls <= 1 << 8 else "<u4")
                cut = [small[a:b].tobytes() for a, b in zip(ends - lengths, ends)]
                none = [None] * len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if z else int(x) for x, z in zip(ids, null)] + [None], pa.int64()),
                     pa.array([*held.tolist(), None], pa.bool_()), pa.array([*lengths.tolist(), None], pa.int64()),
                     pa.array([*known.astype(np.int64).tolist(), None], pa.int64()), pa.array([*base.tolist(), None], pa.float64()),
                     pa.array([*emit.tolist(), None], pa.float64()), pa.array([*cut, None], pa.binary()),
                     pa.array([*none, len(pairs)], pa.int64()), pa.array([*none, pack_ints(pairs)], pa.binary()),
                     pa.array([*none, pack_ints(n.astype(np.int64))], pa.binary())],
                    names=["id", "held", "n", "known", "base", "emit", "classes", "n_pairs", "pairs", "pair_counts"])

    return (parts.drop("n_pairs", "pairs", "pair_counts").join(answers, "block", "left")
            .mapInArrow(make, "id long, held boolean, n long, known long, base double, emit double, classes binary, "
                        "n_pairs long, pairs binary, pair_counts binary"))


def score_lm(docs: DataFrame, rules: BrownRules = BrownRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score`` and ``perplexity`` of every document."""
    spark = docs.sparkSession
    shards = max(1, -(-text_bytes(docs, text_col) // rules.shard_bytes))
    table = written(blocks(docs, rules, id_col, text_col), "lm-blocks")
    counted = written(corpus_counts(table, shards, rules), "lm-counts")
    vocab = vocabulary(counted, rules)
    parts = written(itemised(table, counted, vocab), "lm-items")
    discard(spark, table)
    discard(spark, counted)
    model = fit_classes(bigram_table(parts, vocab.n_items), vocab, rules)
    placed = written(placed_classes(parts, shards, vocab, model, rules), "lm-placed")
    sequences = written(classed(parts, placed, vocab, model, rules), "lm-classes")
    moved = np.zeros(len(model.step))
    for r in (placed.where(F.col("block").isNull()).select(F.posexplode("moved").alias("c", "x")).groupBy("c")
              .agg(F.sum("x").alias("x")).collect()):
        moved[r["c"]] = r["x"]
    discard(spark, parts)
    discard(spark, placed)
    step = transitions(bigram_table(sequences, len(model.step)).astype(np.float64))
    tokens = np.bincount(model.cls, np.concatenate([vocab.band_tokens, vocab.counts]), len(step)) + moved
    mass = np.log10(np.maximum(tokens, 1.0))
    mass[model.cls[0]] = 0.0
    start, kind = int(model.cls[model.first]), "<u1" if len(step) <= 1 << 8 else "<u4"
    held = spark.sparkContext.broadcast((step, mass))                  # classes x classes

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, mass = held.value
        for batch in batches:
            out = []
            for seq, emit in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                c = np.frombuffer(seq, kind).astype(np.int64)
                prev = np.empty_like(c)
                prev[0], prev[1:] = start, c[:-1]
                out.append(float(emit + (step[prev, c] - mass[c]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], batch.column(4), batch.column(5), batch.column(6), pa.array(out, pa.float64())],
                                             names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    scored = (sequences.where(F.col("held").isNotNull()).select("id", "held", "classes", "emit", "n", "known", "base")
              .mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocab.tokens).cast("long").alias("train_tokens"),
                         "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
