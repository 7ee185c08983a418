"""P1–P11 (+X6, X10, J11, J12): price search for every product in one job.

A *demand scorer* is any function ``DataFrame -> DataFrame`` that adds a
``prediction`` column (expected units) to rows carrying a product's feature
columns with ``AverageSellingPrice`` set to the candidate price.  Two ship:
``LinearDemand`` (per-product least squares of units on price, pure SQL
aggregates) and ``ModelDemand`` (any fitted MLlib pipeline).  Candidates of
all products are scored by one ``transform`` instead of one call per price.
"""

from __future__ import annotations

import math
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from margincast.functions.scalars import (as_units, linspace, pct_change, recommendation,
                                          round_half_up, short_id, to_currency)
from margincast.operators.sales import CATEGORY
from margincast.session import ensure_checkpoint_dir, partitions_for, reuse

P, Q = "AverageSellingPrice", "QuantitySold"

# Unit costs of the top-10 products by sales rank, the
# default unit cost, candidate count, bound factors and swarm constants.
PRODUCT_COSTS = [10, 15, 20, 12, 18, 10, 15, 20, 12, 18]
DEFAULT_COST = 10.0
GRID_POINTS = 20
MEAN_BOUNDS = (0.7, 1.3)
PRICE_FLOOR = 0.1
DEFAULT_BOUNDS = (5.0, 500.0)
SWARM_W, SWARM_C1, SWARM_C2 = 0.5, 1.5, 1.5
SWARM_VEL_SD = 0.1

Scorer = Callable[[DataFrame], DataFrame]


# --------------------------------------------------------------------------- P1
def price_bounds(base: DataFrame, policy: str = "mean", price_col: str | None = None,
                 price_range: float = 0.3) -> DataFrame:
    """(lower, upper) per product.

    * ``mean``       — mean price × [0.7, 1.3]   (``price_col`` default mean_price)
    * ``current``    — current price × [1 − r, 1 + r]
    * ``mean_floor`` — [max(0.1, 0.7·mean), 1.3·mean], default (5, 500) when
      the product has no price statistics."""
    lo_f, hi_f = MEAN_BOUNDS
    if policy == "mean":
        c = F.col(price_col or "mean_price")
        return base.withColumns({"lower": c * lo_f, "upper": c * hi_f})
    if policy == "current":
        c = F.col(price_col or "current_price")
        return base.withColumns({"lower": c * (1 - price_range), "upper": c * (1 + price_range)})
    if policy == "mean_floor":
        c = F.col(price_col or "mean_price")
        # greatest() skips nulls, so the missing-statistics case is tested first
        return base.withColumns({
            "lower": F.when(c.isNull(), F.lit(DEFAULT_BOUNDS[0]))
                      .otherwise(F.greatest(F.lit(PRICE_FLOOR), c * lo_f)),
            "upper": F.when(c.isNull(), F.lit(DEFAULT_BOUNDS[1])).otherwise(c * hi_f)})
    raise ValueError(policy)


# --------------------------------------------------------------------------- P2
def price_candidates(bounds: DataFrame, n: int = GRID_POINTS) -> DataFrame:
    """N evenly spaced prices per product (``k`` = 0..n−1)."""
    return bounds.select("*", F.posexplode(linspace("lower", "upper", n)).alias("k", "price"))


# --------------------------------------------------------------------------- P3
def counterfactual(cand: DataFrame, variant: str = "a") -> DataFrame:
    """Candidate rows carry the base row's features; set the price.

    * ``a`` — price only;
    * ``b`` — also ``AverageSellingPrice_Lag_1`` := current price;
    * ``c`` — also ``Price_Lag_1`` := current, ``Price_Diff_Lag_1`` := new −
      current, ``Qty_Lag_1`` := last units (rolling means kept)."""
    cur = F.col("current_price")
    out = cand.withColumn(P, F.col("price"))
    if variant == "b":
        out = out.withColumn("AverageSellingPrice_Lag_1", cur)
    elif variant == "c":
        out = out.withColumns({"Price_Lag_1": cur, "Price_Diff_Lag_1": F.col("price") - cur,
                               "Qty_Lag_1": F.col("current_units").cast("double")})
    elif variant != "a":
        raise ValueError(variant)
    return out


# --------------------------------------------------------------------------- scorers
class LinearDemand:
    """Per-product linear demand ``units = a + b·price`` fitted by least
    squares on the product's cube rows (``regr_intercept`` / ``regr_slope``,
    both partial aggregates).  A product with one distinct price gets b = 0
    and a = its mean units; a product without rows in ``cube`` gets the line
    fitted on all of them (``pooled=False``: no prediction)."""

    def __init__(self, cube: DataFrame, key: str = "product_id", pooled: bool = True):
        self.key = key
        self.pooled = None
        if pooled:
            a, b, mean = cube.agg(F.regr_intercept(F.col(Q).cast("double"), F.col(P)),
                                  F.regr_slope(F.col(Q).cast("double"), F.col(P)),
                                  F.avg(F.col(Q).cast("double"))).first()
            self.pooled = (mean, 0.0) if b is None else (a, b)
        self.coef = cube.groupBy(key).agg(
            F.regr_intercept(F.col(Q).cast("double"), F.col(P)).alias("_a"),
            F.regr_slope(F.col(Q).cast("double"), F.col(P)).alias("_b"),
            F.avg(F.col(Q).cast("double")).alias("_mean_units"))
        self.coef = self.coef.select(
            key, F.coalesce("_b", F.lit(0.0)).alias("demand_slope"),
            F.when(F.col("_b").isNull(), F.col("_mean_units")).otherwise(F.col("_a"))
             .alias("demand_intercept"))

    def attach(self, df: DataFrame) -> DataFrame:
        out = df.join(self.coef, self.key, "left")
        if self.pooled is None:
            return out
        a, b = self.pooled
        return out.withColumns({"demand_slope": F.coalesce("demand_slope", F.lit(b)),
                                "demand_intercept": F.coalesce("demand_intercept", F.lit(a))})

    def __call__(self, df: DataFrame) -> DataFrame:
        if "demand_slope" not in df.columns:
            df = self.attach(df)
        return df.withColumn("prediction", F.col("demand_intercept") + F.col("demand_slope") * F.col(P))


class ModelDemand:
    """Any fitted MLlib ``PipelineModel`` whose output column is ``prediction``."""

    def __init__(self, model, drop: tuple[str, ...] = ("features", "scaled")):
        self.model, self.drop = model, drop

    def attach(self, df: DataFrame) -> DataFrame:
        return df

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).drop(*[c for c in self.drop])


# --------------------------------------------------------------------------- P4
def profit(scored: DataFrame, price_col: str = "price") -> DataFrame:
    """P4 (+X6): demand rounded half-even and floored at 0; profit =
    (price − cost) × demand.  Without a prediction both are null, not 0."""
    return scored.withColumns({
        "demand": F.when(F.col("prediction").isNotNull(), as_units("prediction")),
    }).withColumn("profit", (F.col(price_col) - F.col("cost")) * F.col("demand"))


def score_candidates(cand: DataFrame, scorer: Scorer, variant: str = "a") -> DataFrame:
    return profit(scorer(counterfactual(cand, variant)))


# --------------------------------------------------------------------------- P5
def grid_search(profits: DataFrame, key: str = "product_id") -> DataFrame:
    """P5: best candidate per product; equal profits → the lowest price.
    A grouped max over (profit, −price) — partial aggregation, no sort.  A
    price without a prediction is never recommended."""
    best = profits.where(F.col("profit").isNotNull()).groupBy(key).agg(F.max(F.struct(
        F.col("profit"), (-F.col("price")).alias("neg_price"), F.col("demand"))).alias("_b"))
    return best.select(key, (-F.col("_b.neg_price")).alias("grid_price"),
                       F.col("_b.profit").alias("grid_profit"), F.col("_b.demand").alias("grid_demand"))


# --------------------------------------------------------------------------- P11
def monotone_demand(profits: DataFrame, key: str = "product_id") -> DataFrame:
    """Make demand non-increasing in price (running minimum over the
    candidate grid of each product) and recompute profit."""
    w = Window.partitionBy(key).orderBy("price").rowsBetween(Window.unboundedPreceding, 0)
    return (profits.withColumn("demand", F.min("demand").over(w))
            .withColumn("profit", (F.col("price") - F.col("cost")) * F.col("demand")))


# --------------------------------------------------------------------------- P6
_MASK53 = (1 << 53) - 1


def _uniform(seed: int, *cols: Column) -> Column:
    """Deterministic U[0,1) from a seeded 64-bit hash of the given columns."""
    h = F.xxhash64(F.lit(seed), *cols)
    return h.bitwiseAND(F.lit(_MASK53)).cast("double") / F.lit(float(1 << 53))


def swarm_search(base: DataFrame, scorer: Scorer, particles: int = 10, iters: int = 30,
                 seed: int = 42, variant: str = "a", checkpoint_every: int = 10,
                 key: str = "product_id") -> DataFrame:
    """Particle-swarm price search for every product at once.

    ``base`` has one row per product with its features, ``current_price``,
    ``cost``, ``lower`` and ``upper``.  The state is narrow: product, particle,
    position, velocity and the bests.  It is hash-partitioned by product, as
    the static feature table is, and meets it once every ``checkpoint_every``
    iterations; checkpoints write the narrow columns only.  In between the features ride
    along in memory, and the per-product best is a window on the same
    partitioning.  Each iteration scores the positions of every swarm with a
    single scorer call; then personal and product bests are updated (strict
    improvement, earliest wins on ties) and velocities move (w = .5, c1 = c2 =
    1.5, clamped to bounds).  Returns (product, swarm_price, swarm_profit) with
    profit positive.
    """
    spark = base.sparkSession
    ensure_checkpoint_dir(spark)
    base = scorer.attach(base) if hasattr(scorer, "attach") else base
    n = partitions_for(spark, base.count() * particles, 5_000)
    static = reuse(base.repartition(n, key))
    span = F.col("upper") - F.col("lower")
    u0 = _uniform(seed, F.col(key), F.col("particle"), F.lit(-1), F.lit(0))
    g1 = _uniform(seed, F.col(key), F.col("particle"), F.lit(-1), F.lit(1))
    g2 = _uniform(seed, F.col(key), F.col("particle"), F.lit(-1), F.lit(2))
    normal = F.sqrt(-2.0 * F.log(1.0 - g1)) * F.cos(2 * math.pi * g2)
    # each product row expands into its own particles (a generator, no join)
    narrow = [key, "particle", "pos", "vel", "pbest_pos", "pbest_val", "g"]
    state = (static.withColumn("particle", F.explode(F.sequence(F.lit(0), F.lit(particles - 1))))
             .withColumns({"pos": F.col("lower") + u0 * span,
                           "vel": normal * SWARM_VEL_SD,
                           "pbest_pos": F.lit(None).cast("double"),
                           "pbest_val": F.lit(None).cast("double"),
                           "g": F.lit(None).cast("struct<val:double,it:int,particle:int,pos:double>")}))
    wide = state.columns
    wprod = Window.partitionBy(key)
    for it in range(iters):
        scored = profit(scorer(counterfactual(state.withColumn("price", F.col("pos")), variant)))
        fit = -F.col("profit")
        better = F.col("pbest_val").isNull() | (fit < F.col("pbest_val"))
        step = scored.withColumns({
            "pbest_pos": F.when(better, F.col("pos")).otherwise(F.col("pbest_pos")),
            "pbest_val": F.when(better, fit).otherwise(F.col("pbest_val")),
            "_cand": F.struct(fit.alias("val"), F.lit(it).alias("it"),
                              F.col("particle").alias("particle"), F.col("pos").alias("pos")),
        })
        it_best = F.min("_cand").over(wprod)
        step = step.withColumn("g", F.when(F.col("g").isNull() | (it_best.getField("val") < F.col("g.val")),
                                           it_best).otherwise(F.col("g")))
        r1 = _uniform(seed, F.col(key), F.col("particle"), F.lit(it), F.lit(1))
        r2 = _uniform(seed, F.col(key), F.col("particle"), F.lit(it), F.lit(2))
        vel = (SWARM_W * F.col("vel") + SWARM_C1 * r1 * (F.col("pbest_pos") - F.col("pos"))
               + SWARM_C2 * r2 * (F.col("g.pos") - F.col("pos")))
        step = step.withColumn("vel", vel)
        step = step.withColumn("pos", F.least(F.greatest(F.col("pos") + F.col("vel"), F.col("lower")),
                                              F.col("upper")))
        # scorers change feature columns of their copy only: the static ones come back from ``static``
        last = it + 1 == iters
        if not last and checkpoint_every and (it + 1) % checkpoint_every == 0:
            kept = step.select(*narrow).checkpoint(eager=True)
            state = static.join(kept, key).select(*wide)
        else:
            state = step.select(*narrow) if last else step.select(*wide)
    best = state.groupBy(key).agg(F.first("g").alias("g"))
    return best.select(key, F.col("g.pos").alias("swarm_price"), (-F.col("g.val")).alias("swarm_profit"))


# --------------------------------------------------------------------------- P7
def best_of(grid: DataFrame, swarm: DataFrame, key: str = "product_id") -> DataFrame:
    """Swarm result only when strictly more profitable than the grid."""
    j = grid.join(swarm, key, "left")
    use = F.col("swarm_profit").isNotNull() & (F.col("swarm_profit") > F.col("grid_profit"))
    return j.withColumns({
        "optimal_price": F.when(use, F.col("swarm_price")).otherwise(F.col("grid_price")),
        "max_profit": F.when(use, F.col("swarm_profit")).otherwise(F.col("grid_profit")),
        "method": F.when(use, F.lit("swarm")).otherwise(F.lit("grid")),
    })


def prices_by_model(base: DataFrame, scorers: dict[str, Scorer], particles: int = 10, iters: int = 30, seed: int = 42,
                    variant: str = "b", key: str = "product_id") -> DataFrame:
    """P10 / A23 input: per fitted model and product the grid's and the swarm's
    best, and the better of both (``model``, ``optimal_price``, ``max_profit``)."""
    out = None
    for name, scorer in scorers.items():
        grid = grid_search(score_candidates(price_candidates(base, GRID_POINTS), scorer, variant))
        swarm = swarm_search(base, scorer, particles, iters, seed, variant)
        one = best_of(grid, swarm).join(base.select(key, "lower", "upper", "current_price"), key).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


# --------------------------------------------------------------------------- P8
def optimization_report(base: DataFrame, best: DataFrame, scorer: Scorer | None = None,
                        variant: str = "a", key: str = "product_id") -> DataFrame:
    """Current vs optimal price, demand, profit, % changes in two
    currencies and the recommendation text, one row per product.

    ``expected_demand`` re-scores the optimal price when a scorer is given,
    else takes the demand the search reported."""
    j = base.join(best, key)
    if scorer is not None:
        rs = profit(scorer(counterfactual(j.withColumn("price", F.col("optimal_price")), variant)))
        j = rs.withColumn("expected_demand", F.col("demand")).drop("demand", "profit", "prediction")
    else:
        j = j.withColumn("expected_demand", F.col("grid_demand"))
    cur_units = F.col("current_units").cast("double")
    cur_profit = (F.col("current_price") - F.col("cost")) * cur_units
    j = j.withColumns({"current_profit": cur_profit})
    out = j.select(
        key, short_id(key, 30).alias("product_id_short"), F.col(CATEGORY).alias("category"),
        round_half_up("current_price", 2).alias("current_price_brl"),
        round_half_up(to_currency("current_price"), 2).alias("current_price_thb"),
        round_half_up("optimal_price", 2).alias("optimal_price_brl"),
        round_half_up(to_currency("optimal_price"), 2).alias("optimal_price_thb"),
        round_half_up(pct_change("optimal_price", "current_price"), 1).alias("price_change_pct"),
        F.col("current_units").cast("long").alias("current_demand"),
        F.col("expected_demand").cast("long").alias("expected_demand"),
        F.when(cur_units > 0, round_half_up(pct_change("expected_demand", cur_units), 1))
         .otherwise(F.lit(0.0)).alias("demand_change_pct"),
        round_half_up("current_profit", 2).alias("current_profit_brl"),
        round_half_up(to_currency("current_profit"), 2).alias("current_profit_thb"),
        round_half_up("max_profit", 2).alias("expected_profit_brl"),
        round_half_up(to_currency("max_profit"), 2).alias("expected_profit_thb"),
        round_half_up(F.col("max_profit") - F.col("current_profit"), 2).alias("profit_increase_brl"),
        round_half_up(to_currency(F.col("max_profit") - F.col("current_profit")), 2).alias("profit_increase_thb"),
        F.when(F.col("current_profit") > 0, round_half_up(pct_change("max_profit", "current_profit"), 1))
         .otherwise(F.lit(0.0)).alias("profit_increase_pct"),
        recommendation("optimal_price", "current_price").alias("recommendation"),
        F.col("method"))
    return out


# --------------------------------------------------------------------------- P9
def profit_curve(profits: DataFrame, key: str = "product_id") -> DataFrame:
    """(product, price, demand, profit) in both currencies, by price."""
    return profits.select(
        key, "k", round_half_up("price", 2).alias("price_brl"), round_half_up(to_currency("price"), 2).alias("price_thb"),
        F.col("demand").cast("long").alias("demand"),
        round_half_up("profit", 2).alias("profit_brl"), round_half_up(to_currency("profit"), 2).alias("profit_thb"))


# --------------------------------------------------------------------------- P10
def optimization_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """P10: per model (or overall): products, mean price change %, total profit."""
    by = by or []
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("products"),
        F.avg(F.col("optimal_price") / F.col("current_price") * 100 - 100).alias("avg_price_change_pct"),
        F.sum("max_profit").alias("total_profit"))


# --------------------------------------------------------------------------- base rows
def base_rows(train: DataFrame, order: list[str] | None = None, key: str = "product_id") -> DataFrame:
    """The latest train row of each product (features + current
    price and units), as the base of every counterfactual."""
    from margincast.operators.windows import latest_rows
    last = latest_rows(train, order, key)
    return last.withColumns({"current_price": F.col(P), "current_units": F.col(Q)})


def base_rows_with_fallback(train: DataFrame, targets: DataFrame, features: list[str],
                            order: list[str] | None = None, key: str = "product_id") -> DataFrame:
    """J11 + A22: a base row for every target, by the first of three levels that
    has one (``base_level``):

    * ``last_week`` - the product's first row (in ``order``) of the last train week;
    * ``last_row``  - its latest train row;
    * ``mean``      - the mean of every feature over the train side (a product
      without train rows; its units are the mean units).

    Levels one and two come from one grouped pass: ``min_by`` ignores rows
    whose ordering is null, which makes it a filtered lookup.  The mean vector
    is one row."""
    from margincast.operators.windows import ORDER
    order = order or ORDER
    cols = list(dict.fromkeys([*features, P, Q]))
    last = train.agg(F.max("Date").alias("d"), *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols]).first()
    row = F.struct("Date", *[F.col(c).cast("double").alias(c) for c in cols])
    found = train.groupBy(key).agg(
        F.min_by(row, F.when(F.col("Date") == F.lit(last["d"]), F.struct(*order))).alias("_week"),
        F.max_by(row, F.struct(*order)).alias("_row"))
    mean = F.struct(F.lit(None).cast("date").alias("Date"), *[F.lit(last[f"m_{c}"]).cast("double").alias(c) for c in cols])
    base = (targets.select(key).distinct().join(found, key, "left")
            .withColumn("base_level", F.when(F.col("_week").isNotNull(), "last_week").when(F.col("_row").isNotNull(), "last_row")
                        .otherwise("mean"))
            .withColumn("_b", F.coalesce("_week", "_row", mean)))
    return (base.select(key, "base_level", "_b.*")
            .withColumns({"current_price": F.col(P), "current_units": F.col(Q)}))


def ranked_targets(train: DataFrame, n: int | None = 10, key: str = "product_id") -> DataFrame:
    """T4 + J12: products ranked by units (ties → lower id) with unit cost by
    rank.  ``n=None`` ranks every product (costs past the list use the
    default)."""
    from margincast.operators.ordering import ordered_index
    tot = train.groupBy(key).agg(F.sum(Q).alias("total_units"))
    if n is not None:
        top = tot.orderBy(F.desc("total_units"), F.asc(key)).limit(n)
        ranked = top.withColumn("rank", F.row_number().over(
            Window.orderBy(F.desc("total_units"), F.asc(key))))   # ≤ n rows
    else:
        ranked = ordered_index(tot.withColumn("_neg", -F.col("total_units")), ["_neg", key], "rank")
        ranked = ranked.withColumn("rank", F.col("rank") + 1).drop("_neg")
    from margincast.operators.joins import with_cost
    return with_cost(ranked, PRODUCT_COSTS, DEFAULT_COST)


def product_costs(train: DataFrame, key: str = "product_id", products: DataFrame | None = None) -> DataFrame:
    """J12 for pricing: unit cost of every product of ``products`` (default:
    of ``train``) — the listed costs for the top sales ranks of ``train``, the
    default for the rest.  Only the top len(list)
    products need a rank, so this is a distributed top-k, not a full sort."""
    top = ranked_targets(train, len(PRODUCT_COSTS), key).select(key, F.col("cost").alias("_c"))
    return ((train if products is None else products).select(key).distinct().join(F.broadcast(top), key, "left")   # ≤ 10 rows broadcast
            .select(key, F.coalesce("_c", F.lit(DEFAULT_COST)).alias("cost")))
