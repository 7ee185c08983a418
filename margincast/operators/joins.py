"""Join helpers: checked broadcasts and the membership / lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows;
    otherwise return it unchanged so the join stays a shuffle join (and AQE may
    still convert it at run time from real shuffle sizes)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def keep_products(df: DataFrame, products: DataFrame, key: str = "product_id") -> DataFrame:
    """Rows whose product is in ``products`` (left semi join)."""
    return df.join(products.select(key), key, "left_semi")


def with_cost(targets: DataFrame, costs: list[float] | None = None,
              default_cost: float = 10.0, rank_col: str = "rank") -> DataFrame:
    """Unit cost by 1-based sales rank, default for ranks past the list."""
    from margincast.operators.pricing import PRODUCT_COSTS
    costs = PRODUCT_COSTS if costs is None else costs
    if not costs:
        return targets.withColumn("cost", F.lit(float(default_cost)))
    # a literal map of a handful of entries; no join needed
    m = F.create_map(*[x for i, c in enumerate(costs, start=1) for x in (F.lit(i), F.lit(float(c)))])
    return targets.withColumn("cost", F.coalesce(F.element_at(m, F.col(rank_col).cast("int")),
                                                 F.lit(float(default_cost))))
