"""A18 at any size: exact order statistics without gathering the values.

``F.median`` merges every distinct value into one aggregation buffer.  Here the
wanted ranks are found by narrowing a value range: a round counts the rows of
each of ``buckets`` equal slices of the range (a partial aggregate of at most
``buckets`` rows) and goes on inside the slice that holds the rank, from that slice's
own smallest to its largest value, until those are the same.  A round divides the
range by ``buckets`` at least, so ordinary prices take two or three; data that take
more than ``max_rounds`` (values spread over very many magnitudes), and
values that are not finite, go by exact ranks over range partitions instead.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margincast.operators.ordering import ordered_index


def _by_ranks(x: DataFrame, ks: list[int]) -> dict[int, object]:
    """Values at 0-based positions: distinct values with counts, their running
    sum over the total order, and a filter on the wanted positions."""
    idx = ordered_index(x.groupBy("x").agg(F.count(F.lit(1)).alias("n")), ["x"], out="_before", weight="n")
    hit = F.lit(False)
    for k in ks:
        hit = hit | ((F.col("_before") <= k) & (F.lit(k) < F.col("_before") + F.col("n")))
    rows = idx.where(hit).collect()                       # at most one row per position
    return {k: next(r["x"] for r in rows if r["_before"] <= k < r["_before"] + r["n"]) for k in ks}


def kth_values(df: DataFrame, col: str, ks: list[int], buckets: int = 4096, max_rounds: int = 8) -> dict[int, object]:
    """The values at 0-based positions ``ks`` of the sorted non-null values."""
    x = df.select(F.col(col).alias("x")).where(F.col("x").isNotNull())
    lo, hi = x.agg(F.min("x"), F.max("x")).first()
    found: dict[int, object] = {}
    open_ = [(lo, hi, 0, sorted(set(ks)))]
    for _ in range(max_rounds):
        todo = []
        for lo, hi, below, wanted in open_:
            if lo == hi:
                found.update({k: lo for k in wanted})
                continue
            width = (float(hi) - float(lo)) / buckets
            if not math.isfinite(width) or width == 0:
                found.update(_by_ranks(x, wanted))
                continue
            slot = F.least(F.floor((F.col("x").cast("double") - F.lit(float(lo))) / F.lit(width)), F.lit(buckets - 1)).alias("b")
            slices = (x.where(F.col("x").between(F.lit(lo), F.lit(hi))).groupBy(slot)
                      .agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
                      .collect())                         # at most ``buckets`` rows
            for s in sorted(slices, key=lambda r: r["b"]):
                inside = [k for k in wanted if below <= k < below + s["n"]]
                if inside:
                    todo.append((s["lo"], s["hi"], below, inside))
                below += s["n"]
        open_ = todo
        if not open_:
            return found
    for lo, hi, _, wanted in open_:
        found.update({k: lo for k in wanted} if lo == hi else _by_ranks(x, wanted))
    return found


def exact_quantile(df: DataFrame, col: str, q: float = 0.5) -> float | None:
    """The interpolated quantile of the non-null values; null without any."""
    n = df.agg(F.count(col)).first()[0]
    if not n:
        return None
    at = q * (n - 1)
    a, b = math.floor(at), math.ceil(at)
    v = kth_values(df, col, [a, b])
    if a == b or v[a] == v[b]:
        return float(v[a])
    return (b - at) * float(v[a]) + (at - a) * float(v[b])
