"""Lexical retrieval packing.

Documents are tokenised once and cut into windows; what is left of a document
after its full windows is a piece.  Documents are ordered by lexical keys (the
tokens that come first in a random order in which rare tokens tend to come
early: alike documents tend to agree on them) and cut into shards along that
order; or, to keep an order, into runs of the files' rows.  Each
shard holds a BM25 inverted index over its documents' tokens; a seed piece
opens a window, asks the index for its best unused neighbours and takes them
in order until the window is full.  The neighbour that does not fit is cut at
the window's end and its rest stays in the shard for later windows, so only a
shard's last window can be short.

Document frequencies, document count and mean length are taken over the whole
corpus (one number per vocabulary entry reaches the driver).  A token in more
than half of all documents has no BM25 weight, no postings and is no key; a
token of one document is no key.  A shard holds about ``shard_tokens`` tokens
and a task one shard at a time, so its memory does not grow with the data; a
key that many documents share is split by the next keys and the row.

Defined results: null text is empty, its only id is the end id; repeated rows
are packed each; a long text's full windows are sequences of their own; equal
scores go to the document that comes first in its shard; a null id stays null;
an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from margincast.llm.common import pack_ints, unpack_ints, written

OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _default_ranks() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _default_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


@dataclass(frozen=True)
class PackRules:
    window: int = 2048
    end_id: int = 1
    ranks_path: str | None = None    # vocabulary file, read by the driver and sent to tasks
    pattern: str | None = None
    shard_tokens: int = 1_000_000
    k1: float = 1.2
    b: float = 0.75
    neighbours: int = 16             # fetched at a time; more follow while the window has room
    long_windows: int = 4            # longer documents draw keys of their own
    key_power: float = 4.0           # how early rare tokens come in the order of keys
    task_tokens: int = 4_000_000
    max_tasks: int = 20_000          # beyond that a task packs more shards


#: A white-space character before a space: the only place where a piece of the
#: tokenizer's pattern may reach over a cut made before a space.
_AMBIGUOUS = re.compile(r"\s ")
_ENCODERS: dict = {}


class ChunkEncoder(dict):
    """Token ids of texts, remembered by chunk.

    A piece of the pattern holds a space only as its first character, so a
    text may be cut before every single space and each chunk encoded alone.
    Chunks repeat, so most are looked up.  Texts where a white-space character
    stands before a space are encoded whole."""

    def __init__(self, ranks: bytes, pattern: str, code: str, keep: int = 600_000):
        import tiktoken
        super().__init__()
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        self.encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.code, self.keep = code, keep

    def __missing__(self, chunk: str) -> bytes:
        """Ids of a space and ``chunk``."""
        out = array(self.code, self.encode(" " + chunk)).tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.keep:
                self.clear()
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        if _AMBIGUOUS.search(text):
            return array(self.code, self.encode(text)).tobytes()
        first, *rest = text.split(" ")
        return array(self.code, self.encode(first)).tobytes() + b"".join(map(self.__getitem__, rest))


def _encoder(ranks: bytes, pattern: str, code: str) -> ChunkEncoder:
    key = (zlib.crc32(ranks), pattern, code)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(ranks, pattern, code)
    return _ENCODERS[key]


def tokenised(docs: DataFrame, rules: PackRules, id_col: str, text_col: str, place: tuple[Column, Column]) -> tuple[DataFrame, str, int]:
    """(file, row, doc_id, n, ids) per document, the ids' type, and the
    vocabulary size.  ``place`` gives a row's file and its number there."""
    with open(rules.ranks_path or _default_ranks(), "rb") as f:
        ranks = f.read()
    size = max(max(int(line.split()[1]) for line in ranks.splitlines() if line), rules.end_id) + 1
    code = "H" if size <= 1 << 16 else "I"
    kind = np.dtype({"H": "<u2", "I": "<u4"}[code])
    sent = docs.sparkSession.sparkContext.broadcast(ranks)      # one vocabulary file
    pattern = rules.pattern or _default_pattern()
    end = np.array([rules.end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(sent.value, pattern, code)
        for batch in batches:
            ids = [enc.ids(t) + end if t else end for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(x) // kind.itemsize for x in ids], pa.int64()),
                 pa.array(ids, pa.binary())], names=["file", "row", "doc_id", "n", "ids"])

    out = docs.select(place[0].alias("file"), place[1].alias("row"), F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).alias("t")).mapInArrow(run, "file string, row long, doc_id long, n long, ids binary")
    return out, kind.str, size


def document_frequencies(tokens: DataFrame, kind: str, size: int) -> np.ndarray:
    """Documents that hold each vocabulary entry, over the whole corpus."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column(0).to_pylist():
                total[np.unique(np.frombuffer(ids, kind))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([pack_ints(total)], pa.binary())], names=["k", "df"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(unpack_ints(b, np.int64, size) for b in table["df"].to_pylist())
        return pa.table({"k": pa.array([0], pa.int32()), "df": pa.array([pack_ints(total)], pa.binary())})

    parts = tokens.select("ids").mapInArrow(count, "k int, df binary")
    # one small array per task, added in two steps
    mid = parts.withColumn("k", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("k").applyInArrow(add, "k int, df binary")
    rows = mid.groupBy("k").applyInArrow(add, "k int, df binary").collect()
    return unpack_ints(bytes(rows[0]["df"]), np.int64, size) if rows else np.zeros(size, np.int64)


class ShardIndex:
    """BM25 postings of one shard: per token the documents and their weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, rules: PackRules):
        terms, rows, tfs = [], [], []
        for i, ids in enumerate(docs):
            t, n = np.unique(ids, return_counts=True)
            use = idf[t] > 0
            terms.append(t[use])
            tfs.append(n[use])
            rows.append(np.full(int(use.sum()), i, np.int64))
        self.terms = terms
        t = np.concatenate(terms).astype(np.int64)
        d, tf = np.concatenate(rows), np.concatenate(tfs).astype(np.float64)
        norm = rules.k1 * (1 - rules.b + rules.b * np.array([len(x) for x in docs]) / mean)
        weight = idf[t] * tf * (rules.k1 + 1) / (tf + norm[d])
        order = np.argsort(t, kind="stable")
        t, self.docs, self.weights = t[order], d[order], weight[order]
        self.names, self.first = np.unique(t, return_index=True)
        self.last = np.append(self.first[1:], len(t))
        self.n = len(docs)

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document for the tokens of ``doc``."""
        at = np.searchsorted(self.names, self.terms[doc])
        if not len(at):
            return np.zeros(self.n)
        lo, hi = self.first[at], self.last[at]
        n = hi - lo
        pos = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
        return np.bincount(self.docs[pos], weights=self.weights[pos], minlength=self.n)


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, rules: PackRules) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard."""
    out, w, seq = [], rules.window, 0
    start, left = np.zeros(len(docs), np.int64), np.array([len(x) for x in docs], np.int64)
    for d in range(len(docs)):
        while left[d] >= w:
            out.append((d, int(start[d]), w, seq, 0))
            start[d] += w
            left[d] -= w
            seq += 1
    index = ShardIndex(docs, idf, mean, rules)
    seed = 0
    while True:
        while seed < len(docs) and left[seed] == 0:
            seed += 1
        if seed == len(docs):
            return out
        at = int(left[seed])
        out.append((seed, int(start[seed]), at, seq, 0))
        start[seed] += at
        left[seed] = 0
        score = index.scores(seed)
        score[left == 0] = -1.0
        fetch = rules.neighbours
        while at < w and (live := int((score >= 0).sum())):
            fetch = min(fetch, live)
            best = np.argpartition(-score, fetch - 1)[:fetch]
            for d in best[np.lexsort((best, -score[best]))]:
                n = min(int(left[d]), w - at)
                out.append((int(d), int(start[d]), n, seq, at))
                start[d] += n
                left[d] -= n
                at += n
                score[d] = -1.0
                if at == w:
                    break
            fetch *= 4
        seq += 1


KEYS = 3


def key_order(df: np.ndarray, idf: np.ndarray, power: float) -> np.ndarray:
    """Every token's place in one weighted random order; infinite for tokens
    that are no key.  Two documents agree on their first token with the
    probability of their weighted Jaccard similarity."""
    draw = -np.log1p(-np.random.default_rng(0).random(len(df)))
    use = (idf > 0) & (df > 1)
    out = np.full(len(df), np.inf)
    out[use] = draw[use] / idf[use] ** power
    return out


def lexical_keys(tokens: DataFrame, order: np.ndarray, kind: str, long: int) -> DataFrame:
    """``k0`` to ``k2`` of every document: its first tokens in ``order``, -1
    where it has fewer.  Documents of more than ``long`` tokens hold nearly all
    first tokens, so they would meet in one place; theirs are drawn by row."""
    sent = tokens.sparkSession.sparkContext.broadcast(order)     # one number per vocabulary entry

    def keys_of(row: int, ids: bytes) -> np.ndarray:
        t, out = np.frombuffer(ids, kind), np.full(KEYS, -1)
        at = sent.value[t]
        if len(t) > long:
            some = np.random.default_rng(row).permutation(np.unique(t[at < np.inf]))[:KEYS]
            out[:len(some)] = some
            return out
        for i in range(KEYS):
            first = at.argmin()
            if at[first] == np.inf:
                break
            out[i] = t[first]
            at[at == at[first]] = np.inf                          # the token's other places
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([keys_of(*x) for x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())], np.int32).reshape(-1, KEYS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(keys[:, i]) for i in range(KEYS)]],
                                             names=["row", "doc_id", "ids", *[f"k{i}" for i in range(KEYS)]])

    return tokens.select("row", "doc_id", "ids").mapInArrow(
        run, "row long, doc_id long, ids binary, " + ", ".join(f"k{i} int" for i in range(KEYS)))


def file_runs(tokens: DataFrame, shard_tokens: int, mean: float) -> DataFrame:
    """``shard``: every file's rows in runs of about equally many rows, about
    ``shard_tokens`` tokens each, numbered in the order of the file names."""
    files = tokens.groupBy("file").agg(F.max("row").alias("_last")).withColumn(
        "_runs", F.greatest(F.lit(1), F.round((F.col("_last") + 1) * F.lit(mean / shard_tokens))).cast("long"))
    # one row per file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_first", F.coalesce(F.sum("_runs").over(before), F.lit(0)))
    at = F.floor(F.col("row") * F.col("_runs") / (F.col("_last") + 1))
    return tokens.join(F.broadcast(files), "file").withColumn("shard", (F.col("_first") + at).cast("long"))


def pack(docs: DataFrame, rules: PackRules = PackRules(), id_col: str = "doc_id", text_col: str = "text",
         in_order: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``.  ``in_order`` (``docs`` must be read from files)
    makes the shards runs of the files' rows, in the order of the file names,
    and numbers sequences along them: an order of the documents is kept from
    shard to shard, while a shard's rows go where their neighbours are."""
    if in_order:
        meta = docs.metadataColumn("_metadata")            # also where a column has that name
        place = meta["file_path"], meta["row_index"]
    else:
        place = F.lit(""), F.monotonically_increasing_id()
    raw, kind, size = tokenised(docs, rules, id_col, text_col, place)
    tokens = written(raw, "pack-tokens")
    total = tokens.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).first()
    n_docs, n_tokens = int(total["docs"]), int(total["n"] or 0)
    df = document_frequencies(tokens, kind, size)
    idf = np.maximum(np.log((n_docs - df + 0.5) / (df + 0.5)), 0.0)
    mean = max(1.0, n_tokens / max(1, n_docs))
    sent = docs.sparkSession.sparkContext.broadcast(idf)         # one number per vocabulary entry

    def pieces(ids: list[np.ndarray], names: list, base: int) -> pa.RecordBatch:
        rows = pack_shard(ids, sent.value, mean, rules)
        crc = [zlib.crc32(ids[d][s:s + n].astype("<u4").tobytes()) for d, s, n, _, _ in rows]
        cols = [[names[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows], crc, [len(ids[r[0]]) for r in rows],
                [base + r[3] for r in rows], [r[4] for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in OUT.split(", ")])

    if in_order:
        def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by("row")
            ids = [np.frombuffer(b, kind) for b in table["ids"].to_pylist()]
            return pa.Table.from_batches([pieces(ids, table["doc_id"].to_pylist(), key[0].as_py() << 32)])

        return (file_runs(tokens, rules.shard_tokens, mean).select("shard", "row", "doc_id", "ids")
                .groupBy("shard").applyInArrow(run, OUT))

    def run_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, held, base = [], [], 0, None
        for batch in batches:
            for part, name, b in zip(*[c.to_pylist() for c in batch.columns]):
                base = part << 32 if base is None else base
                ids.append(np.frombuffer(b, kind))
                names.append(name)
                held += len(ids[-1])
                if held >= rules.shard_tokens:
                    out = pieces(ids, names, base)
                    yield out
                    base = max(out["sequence_id"].to_pylist()) + 1
                    ids, names, held = [], [], 0
        if ids:
            yield pieces(ids, names, base)

    keys = [f"k{i}" for i in range(KEYS)]
    tasks = max(1, min(-(-n_tokens // rules.task_tokens), rules.max_tasks))
    return (lexical_keys(tokens, key_order(df, idf, rules.key_power), kind, rules.long_windows * rules.window)
            .repartitionByRange(tasks, *keys, "row").sortWithinPartitions(*keys, "row")
            .select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "ids").mapInArrow(run_part, OUT))
