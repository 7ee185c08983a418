"""Nearest neighbours by collision-counting hashing.

Every vector is projected on ``projections`` random lines.  A shard keeps each
line's projections as one sorted array.  A query's window on a line is centred
at the query's own projection; virtual rehashing widens all windows together,
level by level.  A vector inside the window of a line collides with the query
there; once its collisions pass the threshold it is verified by its exact
inner product.  A level counts only what its windows take in anew.  Search of
a shard stops when the last wanted one of the verified vectors lies within the
radius the present level answers for; wanted are the k / shards nearest that a
shard holds of the k nearest of all, with three standard deviations to spare.

Largest inner product becomes smallest distance by one more coordinate,
sqrt(M^2 - |x|^2) for rows (M: the largest norm) and 0 for queries.  Lengths
are taken in units of a power of two near M, so that no square overflows;
scores are of the vectors as given.

Rows are dealt to shards of bounded size at random and queries to
blocks; every (shard, block) pair is one group, so neither side is ever whole
in one place.  Shard results are at most k rows per query.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, nor do vectors of another length than most; components of
any finite size are searched, and a product beyond the doubles is infinite; an
empty table gives no rows; equal scores rank by smaller id; rows that repeat an id are candidates each, but
never for a query of that id; with fewer than k candidates all are returned;
other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OUT = "query_id long, vec_id long, score double, q long"


@dataclass(frozen=True)
class AnnRules:
    k: int = 20
    query_every: int = 20            # ids divisible by it are queries
    projections: int = 240
    window: float = 0.62             # half-width of a window per unit of radius
    threshold: float = 0.432         # share of lines a verified vector must collide on
    growth: float = 1.03             # radius ratio of one level to the next
    shard_rows: int = 16_384
    query_rows: int = 16_384
    batch: int = 128                 # queries of a block that go through the levels together
    seed: int = 11


def wanted(k: int, shards: int) -> int:
    """Neighbours that end the search of one shard.  Rows are dealt at random,
    so a shard holds k / shards of a query's k nearest, give or take a few."""
    share = k / shards
    return k if shards == 1 else min(k, math.ceil(share + 3 * math.sqrt(share)) + 1)


class ShardIndex:
    """Sorted projections of one shard."""

    def __init__(self, ids: np.ndarray, given: np.ndarray, top: float, rules: AnnRules, unit: int = 0, stop: int | None = None):
        self.ids, self.given, self.rules, self.unit, self.stop = ids, given, rules, unit, stop or rules.k
        self.x = x = np.ldexp(given, -unit) if unit else given
        rest = np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0.0))
        self.norms, n, m = top * top, len(ids), rules.projections
        self.lines = np.random.default_rng(rules.seed).standard_normal((x.shape[1] + 1, m))
        place = np.uint16 if n < 1 << 16 else np.uint32
        self.order, self.sorted, self.places = np.empty((m, n), np.int32), np.empty((m, n)), np.empty((m, n), place)
        for j in range(m):
            p = x @ self.lines[:-1, j] + rest * self.lines[-1, j]
            self.order[j] = np.argsort(p)
            self.sorted[j] = p[self.order[j]]
            self.places[j, self.order[j]] = np.arange(n)
        self.verified = 0

    def products(self, at: np.ndarray, given: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products with the query, as given and in units."""
        if abs(self.unit) < 500:                       # no product of two lengths overflows
            s = (self.given[at] * given).sum(axis=1)
            return s, np.ldexp(s, -2 * self.unit)
        u = (self.x[at] * q).sum(axis=1)
        with np.errstate(over="ignore", invalid="ignore"):
            s = (self.given[at] * given).sum(axis=1)
            return np.where(np.isfinite(s), s, np.ldexp(u, 2 * self.unit)), u

    def windows(self, center: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """Where the windows of all queries begin and end in the sorted lines."""
        lo, hi = np.empty(center.shape, np.int64), np.empty(center.shape, np.int64)
        for j in range(center.shape[1]):
            lo[:, j] = np.searchsorted(self.sorted[j], center[:, j] - half)
            hi[:, j] = np.searchsorted(self.sorted[j], center[:, j] + half, side="right")
        return lo, hi

    def collide(self, hits: np.ndarray, lo: np.ndarray, hi: np.ndarray, old: tuple[np.ndarray, np.ndarray]) -> np.ndarray | None:
        """Count the members that windows [lo, hi) have over the old ones.
        Returns them (None: any row may be one)."""
        a, b = old
        size = int((hi - lo).sum() - (b - a).sum())
        if size > 8 * len(self.ids) and not (b > a).any():
            # a first window of many rows: test each row's place against the window's ends
            begin, width = (v.astype(self.places.dtype)[:, None] for v in (lo, hi - lo))
            for j in range(0, len(lo), 8):
                inside = (self.places[j:j + 8] - begin[j:j + 8]) < width[j:j + 8]
                hits += inside.view(np.uint8).sum(axis=0, dtype=np.uint8)
            return None
        parts = [self.order[j, s:e] for j in np.flatnonzero((lo < a) | (hi > b)) for s, e in ((lo[j], a[j]), (b[j], hi[j])) if s < e]
        if not parts:
            return np.zeros(0, np.int32)
        members = np.concatenate(parts)
        np.add.at(hits, members, hits.dtype.type(1))
        return members

    def search(self, query_ids: np.ndarray, given: np.ndarray, start: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and inner products of the k best found, for every query.  All
        windows of a batch of queries widen together, level by level."""
        r, n, m = self.rules, len(self.ids), self.rules.projections
        need = math.ceil(r.threshold * m)
        q = np.ldexp(given, -self.unit) if self.unit else given
        center, qq = q @ self.lines[:-1], (q * q).sum(axis=1)
        hits = np.zeros((len(q), n), np.uint8 if m < 256 else np.uint16)
        seen = self.ids[None, :] == query_ids[:, None]
        left = n - seen.sum(axis=1)
        found: list[list] = [[] for _ in q]
        scores: list[list] = [[] for _ in q]
        best = [np.zeros(0) for _ in q]                # the ``stop`` largest products so far, in units
        live = np.flatnonzero(left > 0)
        first, _ = self.windows(center, 0.0)
        old, radius = (first, first.copy()), start
        while len(live):
            lo, hi = self.windows(center[live], r.window * radius)
            lo, hi = np.minimum(lo, old[0][live]), np.maximum(hi, old[1][live])
            go_on = []
            for at, i in enumerate(live):
                members = self.collide(hits[i], lo[at], hi[at], (old[0][i], old[1][i]))
                if members is None:
                    new = np.flatnonzero((hits[i] >= need) & ~seen[i])
                else:
                    new = np.unique(members[(hits[i][members] >= need) & ~seen[i][members]])
                if len(new):
                    seen[i][new] = True
                    left[i] -= len(new)
                    s, u = self.products(new, given[i], q[i])
                    found[i].append(new)
                    scores[i].append(s)
                    best[i] = np.sort(np.concatenate([best[i], u]))[-self.stop:]
                # squared distance in the lifted space: M^2 + |q|^2 - 2 <x, q>
                done = len(best[i]) == self.stop and self.norms + qq[i] - 2 * best[i][0] <= radius * radius
                if not (done or left[i] == 0 or (lo[at] == 0).all() and (hi[at] == n).all()):
                    go_on.append(i)
            old[0][live], old[1][live] = lo, hi
            live = np.array(go_on, np.int64)
            radius *= r.growth
        out = []
        for f, s in zip(found, scores):
            at, s = np.concatenate(f or [np.zeros(0, np.int64)]), np.concatenate(s or [np.zeros(0)])
            self.verified += len(at)
            top = np.lexsort((self.ids[at], -s))[:r.k]
            out.append((self.ids[at[top]], s[top]))
        return out


def start_radius(x: np.ndarray, q: np.ndarray, top: float, stop: int) -> float:
    """Where windows begin: a low quantile of the distance at which some of the
    queries end.  Only where the search begins - it widens from there."""
    few = q[:: max(1, len(q) // 32)]
    s = np.sort(x @ few.T, axis=0)[-min(stop, len(x))]
    d = np.sqrt(np.maximum(top * top + (few * few).sum(axis=1) - 2 * s, 0.0))
    return max(float(np.quantile(d, 0.1)), 1e-3 * top, 1e-12)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & F.coalesce((F.size("v") > 0) & fine, F.lit(False))))


def nearest(vectors: DataFrame, rules: AnnRules = AnnRules(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for all queries among the rows."""
    rows = usable(vectors, id_col, vec_col)
    # log2 of a length, from its largest component (bound once), so that no square overflows
    norm = F.get(F.transform(F.array(F.array_max(F.transform("v", lambda x: F.abs(x)))), lambda big: F.log2(big) + F.log2(
        F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / big) * (x / big))) / 2), 0)
    is_query = F.col("vec_id") % rules.query_every == 0
    sizes = (rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top"),
                                                      F.sum(is_query.cast("long")).alias("q"))
             .orderBy(F.col("n").desc(), "d").limit(1).collect())
    spark = vectors.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n, n_q = sizes[0]["d"], sizes[0]["n"], sizes[0]["q"]
    unit = math.floor(sizes[0]["top"])
    top = 2.0 ** (float(sizes[0]["top"]) - unit) * (1 + 1e-12)
    shards, blocks = max(1, -(-n // rules.shard_rows)), max(1, -(-n_q // rules.query_rows))
    rows = rows.where(F.size("v") == dim)
    h = F.xxhash64("vec_id", F.lit(rules.seed))
    stop = wanted(rules.k, shards)
    # dealt by row, not by id: copies of one row or id spread over all shards
    base = (rows.withColumn("s", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
            .select((F.col("s") * blocks + F.col("b")).alias("cell"), "vec_id", "v"))
    asked = (rows.where(is_query).withColumn("q", F.xxhash64("v")).dropDuplicates(["vec_id", "q"])
             .withColumn("b", F.pmod(h, F.lit(blocks))).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
             .select((F.col("s") * blocks + F.col("b")).cast("long").alias("cell"), "vec_id", "v", "q"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list, list] = ([], [], [], [])
        if left.num_rows and right.num_rows:
            x, q = _matrix(left["v"]), _matrix(right["v"])
            index = ShardIndex(left["vec_id"].to_numpy(), x, top, rules, unit, stop)
            start = start_radius(index.x, np.ldexp(q, -unit), top, stop)
            asked_ids, keys = right["vec_id"].to_numpy(), right["q"].to_numpy()
            for i in range(0, len(q), rules.batch):
                part = slice(i, i + rules.batch)
                for qid, key, (ids, scores) in zip(asked_ids[part], keys[part], index.search(asked_ids[part], q[part], start)):
                    out[0].extend([qid] * len(ids))
                    out[1].extend(ids.tolist())
                    out[2].extend(scores.tolist())
                    out[3].extend([key] * len(ids))
        return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()),
                                     pa.array(out[3], pa.int64())], names=["query_id", "vec_id", "score", "q"])

    found = base.groupBy("cell").cogroup(asked.groupBy("cell")).applyInArrow(run, OUT)
    order = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rules.k)
            .select("query_id", "rank", "vec_id", "score"))
