"""Toxicity scores from a factorization machine over hashed terms.

A document is the set of its hashed terms.  Beside a weight per term the model
learns a short factor vector per term; the dot product of two terms' factors
is the weight of the pair, so two words that are harmless alone can count
together.  Terms are picked by how well they separate the labels, since a
document's length must not dilute a few telling words.

Labels are fitted on about ``max_fit_rows`` labelled training documents at most
(an even share by a hash of the id: repeatable, without an order).  Features are a bounded table of ``buckets`` x (factors + 1)
numbers; the model is sent to tasks and every text is scored whole.

Defined results: empty and null texts get the score of a document without
terms; without both labels among the training rows every score is the
smoothed share of toxic rows; repeated rows score alike; labels of unknown
documents are ignored; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII marks and control characters become spaces, capitals small letters;
#: bytes of other scripts stay.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32) for b in range(256))


@dataclass(frozen=True)
class ToxicityRules:
    buckets: int = 1 << 18
    n_terms: int = 512               # buckets kept as features
    min_chi: float = 10.8            # chi-square of term against label (1 in 1000 by chance)
    min_docs: int = 5                # labelled documents a feature needs
    factors: int = 4
    epochs: int = 150
    rate: float = 0.05
    l2: float = 1e-3
    max_fit_rows: int = 20_000
    seed: int = 7


@dataclass
class Model:
    index: np.ndarray                # bucket -> feature, -1 where none
    bias: float
    linear: np.ndarray
    factors: np.ndarray


def hashed_terms(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a batch of texts, sorted by row."""
    folded = pa.array([(t or b"").translate(_FOLD) for t in texts.cast(pa.binary()).to_pylist()], pa.binary()).cast(pa.string())
    lists = pc.ascii_split_whitespace(folded)
    flat, rows = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    names = coded.dictionary.cast(pa.binary()).to_pylist()
    code = np.array([xxhash.xxh3_64_intdigest(w) % buckets if w else -1 for w in names], dtype=np.int64)
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cols = code[coded.indices.to_numpy(zero_copy_only=False)]
    rows, cols = rows[cols >= 0].astype(np.int64), cols[cols >= 0]
    key = np.unique(rows * buckets + cols)
    return key // buckets, key % buckets


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row."""
    if values.ndim == 1:
        return np.bincount(rows, weights=values, minlength=n)
    return np.stack([np.bincount(rows, weights=values[:, f], minlength=n) for f in range(values.shape[1])], axis=1)


def raw_scores(model: Model, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
    """bias + sum of weights + 1/2 (|sum of factors|^2 - sum of |factors|^2)."""
    feat = model.index[cols]
    rows, feat = rows[feat >= 0], feat[feat >= 0]
    v = model.factors[feat]
    s = _sums(rows, v, n)
    return (model.bias + _sums(rows, model.linear[feat], n)
            + 0.5 * ((s * s).sum(axis=1) - _sums(rows, (v * v).sum(axis=1), n)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, rules: ToxicityRules) -> Model:
    """Full-batch Adam on the log loss; ``rows``/``cols`` as from ``hashed_terms``."""
    n, pos = len(y), float(y.sum())
    index = np.full(rules.buckets, -1, np.int64)
    prior = (pos + 1.0) / (n + 2.0)
    model = Model(index, float(np.log(prior / (1 - prior))), np.zeros(1), np.zeros((1, rules.factors)))
    if not n or pos in (0.0, float(n)):
        return model
    in_pos = np.bincount(cols, weights=y[rows], minlength=rules.buckets)
    in_all = np.bincount(cols, minlength=rules.buckets).astype(float)
    # chi-square of "term present" against the label
    a, b = in_pos, in_all - in_pos
    c, d = pos - a, (n - pos) - b
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * pos * (n - pos), 1e-9)
    chi[(in_all < rules.min_docs) | (chi < rules.min_chi)] = 0
    best = np.argsort(-chi, kind="stable")[:rules.n_terms]
    best = best[chi[best] > 0]
    if not len(best):
        return model
    index[best] = np.arange(len(best))
    feat = index[cols]
    r, f = rows[feat >= 0], feat[feat >= 0]
    rng = np.random.default_rng(rules.seed)
    p = [np.array([model.bias]), np.zeros(len(best)), rng.normal(0, 0.05, (len(best), rules.factors))]
    m, s = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, rules.epochs + 1):
        model.bias, model.linear, model.factors = float(p[0][0]), p[1], p[2]
        v = p[2][f]
        total = _sums(r, v, n)
        z = model.bias + _sums(r, p[1][f], n) + 0.5 * ((total ** 2).sum(axis=1) - _sums(r, (v * v).sum(axis=1), n))
        err = (_sigmoid(z) - y) / n
        grad = [np.array([err.sum()]), np.bincount(f, weights=err[r], minlength=len(best)) + rules.l2 * p[1] / n,
                _sums(f, err[r][:, None] * (total[r] - v), len(best)) + rules.l2 * p[2] / n]
        for i, g in enumerate(grad):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            p[i] = p[i] - rules.rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(s[i] / (1 - 0.999 ** step)) + 1e-8)
    model.bias, model.linear, model.factors = float(p[0][0]), p[1], p[2]
    return model


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Rows never fitted on: crc32 of the id's text divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, rules: ToxicityRules = ToxicityRules(), id_col: str = "doc_id",
                 text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on the bounded training sample.  Features are hashed in tasks; only
    bucket numbers of at most ``max_fit_rows`` documents reach the driver."""
    lab = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("y")).where(
        F.col("_id").isNotNull() & F.col("y").isNotNull()).distinct()
    lab = lab.where(~held_out("_id"))
    n = lab.count()
    if n > rules.max_fit_rows:       # an even share by hash, about max_fit_rows of them
        share = int(rules.max_fit_rows / n * (1 << 32))
        lab = lab.where(F.pmod(F.xxhash64("_id", F.lit(rules.seed)), F.lit(1 << 32)) < share)
    # at most about max_fit_rows pairs of numbers: the texts stay where they are
    picked = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("t")).join(F.broadcast(lab), "_id")
              .select("t", "y"))
    buckets = rules.buckets

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = hashed_terms(batch.column(0), buckets)
            at = np.searchsorted(rows, np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array([cols[at[i]:at[i + 1]].astype("<u4").tobytes() for i in range(batch.num_rows)], pa.binary()),
                 batch.column(1)], names=["terms", "y"])
    got = picked.mapInArrow(features, "terms binary, y double").collect()
    got.sort(key=lambda g: (bytes(g["terms"]), g["y"]))
    terms = [np.frombuffer(g["terms"], "<u4").astype(np.int64) for g in got]
    rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    cols = np.concatenate(terms) if terms else np.zeros(0, np.int64)
    return fit(rows, cols, np.array([float(g["y"] > 0) for g in got]), rules)


def score_toxicity(docs: DataFrame, model: Model, rules: ToxicityRules = ToxicityRules(), id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)   # buckets + terms x (factors + 1) numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = hashed_terms(batch.column(2), rules.buckets)
            p = _sigmoid(raw_scores(held.value, rows, cols, batch.num_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"])
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
            .mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int"))
