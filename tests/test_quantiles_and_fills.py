"""Distributed order statistics, whole-sequence fills, base rows with fallback."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from margincast.operators.ordering import global_backfill
from margincast.operators.pricing import base_rows_with_fallback
from margincast.operators.quantiles import exact_quantile, kth_values
from margincast.operators.windows import fill_sequence


@pytest.mark.parametrize("values", [
    [1.0], [2.0, 1.0], [3.0, 1.0, 2.0, 2.0], [5.0] * 40, list(range(100)), [0.1 * i * i for i in range(501)],
    [1e-300, 1.0, 1e300, 2.0, 1.5], [-1e308, 1e308, 3.0, 4.0], [float("inf"), 1.0, 2.0, 3.0], [-7.25, 0.0, -0.5, 9.75, None, None]])
def test_median_equals_numpy(spark, values):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    want = float(np.median([v for v in values if v is not None]))
    assert exact_quantile(df, "v") == pytest.approx(want, rel=1e-15)


def test_quantiles_of_skewed_values(spark):
    rng = random.Random(2)
    values = [round(rng.lognormvariate(3, 2), 2) for _ in range(4000)] + [42.0] * 2000
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert exact_quantile(df, "v", q) == pytest.approx(float(np.quantile(values, q)), rel=1e-14)
    ordered = sorted(values)
    for k, v in kth_values(df, "v", [0, 17, 3000, 5999], buckets=4, max_rounds=2).items():   # ends by ranks
        assert v == ordered[k]


def test_median_of_decimals_and_of_nothing(spark):
    df = spark.sql("SELECT CAST(id AS DECIMAL(20, 2)) / 4 AS v FROM range(11)")
    assert exact_quantile(df, "v") == 1.25
    assert exact_quantile(df.where("false"), "v") is None


def _sequence(rows, cols):
    rows = sorted(rows)
    for c in cols:
        value = None
        for r in reversed(rows):
            if r[c] is None:
                r[c] = value
            value = r[c]
    return rows


@pytest.mark.parametrize("partitions", [1, 5, 13])
def test_global_backfill_equals_loop(spark, partitions):
    rng = random.Random(4)
    rows = [[i // 9, rng.random(), rng.choice([None, None, None, float(i)]), None if i < 150 else rng.choice([None, i])]
            for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b double, x double, y long").repartition(6)
    got = sorted(list(r) for r in global_backfill(df, ["a", "b"], ["x", "y"], partitions).collect())
    assert got == _sequence(rows, [2, 3])


def test_fill_sequence_runs_on_across_products(spark):
    rows = [(1, "b", 1, None), (1, "a", 2, 5.0), (1, "b", 3, None), (2, "a", 1, None), (2, "a", 2, None), (3, "a", 1, 7.0),
            (4, "a", 1, None)]
    df = spark.createDataFrame(rows, "product_id int, c string, t int, v double")
    got = {tuple(r)[:3]: r.v for r in fill_sequence(df, ["v"], ["c", "t"], {"v": 0.0}).collect()}
    # product 1 in order a2, b1, b3 is filled forward; product 2 has nothing and takes product 3's; 4 the default
    assert got == {(1, "a", 2): 5.0, (1, "b", 1): 5.0, (1, "b", 3): 5.0, (2, "a", 1): 7.0, (2, "a", 2): 7.0,
                   (3, "a", 1): 7.0, (4, "a", 1): 0.0}


def test_base_rows_levels(spark):
    d = [dt.date(2020, 1, 6) + dt.timedelta(weeks=i) for i in range(3)]
    train = spark.createDataFrame(
        [(1, d[2], 1, 10.0, 4, 1.0), (1, d[2], 0, 12.0, 6, None), (1, d[0], 0, 99.0, 9, 9.0), (2, d[0], 1, 20.0, 2, 2.0),
         (2, d[1], 1, 22.0, 3, 3.0)],
        "product_id int, Date date, seller_state_encoded int, AverageSellingPrice double, QuantitySold long, f double")
    targets = spark.createDataFrame([(1,), (2,), (3,), (3,)], "product_id int")
    got = {r.product_id: r for r in base_rows_with_fallback(train, targets, ["f"]).collect()}
    assert (got[1].base_level, got[1].current_price, got[1].current_units, got[1].f) == ("last_week", 12.0, 6.0, None)
    assert (got[2].base_level, got[2].current_price, got[2].Date) == ("last_row", 22.0, d[1])
    assert (got[3].base_level, got[3].Date, got[3].f) == ("mean", None, 3.75)
    assert math.isclose(got[3].current_price, 32.6) and len(got) == 3
    none = base_rows_with_fallback(train.where("false"), targets, ["f"]).collect()
    assert {r.base_level for r in none} == {"mean"} and none[0].current_price is None
