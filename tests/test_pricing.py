import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from margincast.operators.pricing import (LinearDemand, _uniform, grid_search, monotone_demand,
                                          price_bounds, price_candidates, profit, score_candidates,
                                          swarm_search)

BASE = ("product_id long, AverageSellingPrice double, current_price double, current_units long, "
        "cost double, lower double, upper double, demand_intercept double, demand_slope double")


def planted_base(spark):
    # demand = a − b·price; optimum of (p − c)(a − b p) is (a/b + c)/2
    rows = [(1, 50.0, 50.0, 10, 10.0, 20.0, 90.0, 1000.0, -10.0),    # optimum 55 inside
            (2, 30.0, 30.0, 10, 12.0, 5.0, 20.0, 400.0, -5.0),       # optimum 46 → clipped to 20
            (3, 80.0, 80.0, 10, 15.0, 40.0, 120.0, 2000.0, -25.0)]   # optimum 47.5 inside
    return spark.createDataFrame(rows, BASE)


def linear(df):
    return df.withColumn("prediction", F.col("demand_intercept") + F.col("demand_slope") * F.col("AverageSellingPrice"))


def test_grid_and_swarm_find_planted_optimum(spark):
    base = planted_base(spark)
    cand = price_candidates(base, 20)
    g = {r.product_id: r for r in grid_search(score_candidates(cand, linear, "a")).collect()}
    s = {r.product_id: r for r in swarm_search(base, linear, particles=10, iters=30, seed=42).collect()}
    want = {1: 55.0, 2: 20.0, 3: 47.5}
    for pid, opt in want.items():
        assert abs(s[pid].swarm_price - opt) < 0.5, (pid, s[pid].swarm_price)
        assert s[pid].swarm_profit >= g[pid].grid_profit - 1e-6


def test_grid_tie_takes_lower_price(spark):
    df = spark.createDataFrame([(1, 0, 10.0, 4.0, 2.0), (1, 1, 12.0, 8.0, 1.0), (1, 2, 11.0, 10.0, 0.0)],
                               "product_id long, k int, price double, cost double, prediction double")
    best = grid_search(profit(df.withColumn("cost", F.lit(6.0)))).first()
    # profits: (10−6)·2 = 8, (12−6)·1 = 6, (11−6)·0 = 0 → 10; equal profits below
    assert best.grid_price == 10.0
    tie = spark.createDataFrame([(1, 0, 10.0, 6.0, 3.0), (1, 1, 12.0, 6.0, 2.0)],
                                "product_id long, k int, price double, cost double, prediction double")
    assert grid_search(profit(tie)).first().grid_price == 10.0   # 12 = 12 → lower price


def test_monotone_demand_non_increasing(spark):
    df = spark.createDataFrame([(1, 0, 1.0, 0.0, 5.0), (1, 1, 2.0, 0.0, 7.0), (1, 2, 3.0, 0.0, 4.0)],
                               "product_id long, k int, price double, cost double, prediction double")
    got = [r.demand for r in monotone_demand(profit(df)).orderBy("price").collect()]
    assert got == [5.0, 5.0, 4.0]


def test_linear_demand_recovers_line(spark):
    rows = [(1, 0, dt.date(2018, 1, 1 + i), int(100 - 2 * p), float(p)) for i, p in enumerate([10, 20, 30])]
    cube = spark.createDataFrame(rows, "product_id long, seller_state_encoded int, Date date, "
                                       "QuantitySold long, AverageSellingPrice double")
    coef = LinearDemand(cube).coef.first()
    assert abs(coef.demand_slope + 2.0) < 1e-9 and abs(coef.demand_intercept - 100.0) < 1e-9


def _swarm_by_arrays(lo, hi, cost, a, b, start, moves):
    """The swarm's definition on whole arrays: ``start`` holds the three first
    draws of every particle, ``moves`` a pair of draws for every iteration."""
    u, g1, g2 = start
    at = lo + u * (hi - lo)
    speed = np.sqrt(-2 * np.log(1 - g1)) * np.cos(2 * math.pi * g2) * 0.1
    own_at, own, best = at, np.full(len(at), np.inf), (np.inf, np.nan)
    for r1, r2 in moves:
        loss = -(at - cost) * np.maximum(0.0, np.rint(a + b * at))
        own_at, own = np.where(loss < own, at, own_at), np.minimum(loss, own)
        best = min(best, (loss.min(), at[loss.argmin()]), key=lambda x: x[0])
        speed = 0.5 * speed + 1.5 * r1 * (own_at - at) + 1.5 * r2 * (best[1] - at)
        at = np.clip(at + speed, lo, hi)
    return best[1], -best[0]


def test_swarm_equals_bruteforce_reference(spark):
    particles, iters, seed = 6, 7, 11
    base = planted_base(spark)
    got = {r.product_id: (r.swarm_price, r.swarm_profit) for r in
           swarm_search(base, linear, particles=particles, iters=iters, seed=seed, checkpoint_every=3).collect()}
    grid = spark.range(1, 4).select(F.col("id").alias("product_id"),
                                    F.explode(F.sequence(F.lit(0), F.lit(particles - 1))).alias("particle"))
    k, p = F.col("product_id"), F.col("particle")
    init = grid.select("product_id", "particle",
                       _uniform(seed, k, p, F.lit(-1), F.lit(0)).alias("u0"),
                       _uniform(seed, k, p, F.lit(-1), F.lit(1)).alias("g1"),
                       _uniform(seed, k, p, F.lit(-1), F.lit(2)).alias("g2")).collect()
    steps = grid.withColumn("it", F.explode(F.sequence(F.lit(0), F.lit(iters - 1)))).select(
        "product_id", "particle", "it",
        _uniform(seed, k, p, F.col("it"), F.lit(1)).alias("r1"),
        _uniform(seed, k, p, F.col("it"), F.lit(2)).alias("r2")).collect()
    for row in base.collect():
        mine = sorted((r for r in init if r.product_id == row.product_id), key=lambda r: r.particle)
        drawn = sorted((r for r in steps if r.product_id == row.product_id), key=lambda r: (r.it, r.particle))
        pairs = np.array([(r.r1, r.r2) for r in drawn]).reshape(iters, particles, 2).transpose(0, 2, 1)
        want = _swarm_by_arrays(row.lower, row.upper, row.cost, row.demand_intercept, row.demand_slope,
                                np.array([(r.u0, r.g1, r.g2) for r in mine]).T, pairs)
        assert abs(got[row.product_id][0] - want[0]) < 1e-9
        assert abs(got[row.product_id][1] - want[1]) < 1e-6


def test_swarm_same_answer_any_partitioning(spark):
    base = planted_base(spark)
    a = sorted(swarm_search(base, linear, particles=5, iters=6, seed=3).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        b = sorted(swarm_search(base.repartition(3), linear, particles=5, iters=6, seed=3).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_bounds_policies(spark):
    df = spark.createDataFrame([(1, 100.0), (2, None)], "product_id long, mean_price double")
    m = {r.product_id: (r.lower, r.upper) for r in price_bounds(df, "mean_floor").collect()}
    assert m[1] == (70.0, 130.0) and m[2] == (5.0, 500.0)


def test_products_without_train_rows_take_the_pooled_line(spark):
    train = spark.createDataFrame([(1, 10.0, 9), (1, 12.0, 7), (2, 10.0, 5), (2, 14.0, 1)],
                                  "product_id long, AverageSellingPrice double, QuantitySold long")
    b, a = np.polyfit([10.0, 12.0, 10.0, 14.0], [9, 7, 5, 1], 1)
    new = spark.createDataFrame([(1, 11.0), (3, 11.0)], "product_id long, AverageSellingPrice double")
    got = {r["product_id"]: r["prediction"] for r in LinearDemand(train)(new).collect()}
    assert abs(got[1] - 8.0) < 1e-9 and abs(got[3] - (a + b * 11.0)) < 1e-9
    bare = {r["product_id"]: r["prediction"] for r in LinearDemand(train, pooled=False)(new).collect()}
    assert bare[3] is None


def test_no_recommendation_without_a_prediction(spark):
    cand = spark.createDataFrame([(1, 10.0, 3.0), (1, 11.0, None), (2, 10.0, None)],
                                 "product_id long, price double, prediction double").withColumn("cost", F.lit(5.0))
    got = grid_search(profit(cand)).collect()
    assert [(r["product_id"], r["grid_price"]) for r in got] == [(1, 10.0)]
