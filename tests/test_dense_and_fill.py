import datetime as dt
import random

from pyspark.sql import functions as F

from margincast.operators.cube import densify
from margincast.operators.ordering import next_non_null
from margincast.operators.windows import fill_within_product

CUBE = ("product_id long, product_category_name_english string, seller_state_encoded int, Date date, "
        "QuantitySold long, AverageSellingPrice double, Weight_g_Mean double, Length_cm_Mean double, "
        "Height_cm_Mean double, Width_cm_Mean double")
MON = dt.date(2018, 1, 1)


def wk(i):
    return MON + dt.timedelta(days=7 * i)


def row(p, state, i, q, price):
    return (p, "fashion_x", state, wk(i), q, price, 1.0, 2.0, None, 3.0)


def test_densify_fills_every_week_once(spark):
    rows = [row(1, 0, 1, 2, 10.0), row(1, 3, 1, 1, 11.0), row(1, 0, 4, 5, 12.0),   # two regions in week 1
            row(2, 1, 0, 1, 20.0), row(2, 1, 6, 1, 21.0)]                          # span weeks 0..6
    got = densify(spark.createDataFrame(rows, CUBE)).collect()
    by = {}
    for r in got:
        by.setdefault(r.product_id, []).append((r.Date, r.seller_state_encoded, r.QuantitySold))
    p1 = sorted(by[1])
    assert [d for d, _, _ in p1] == [wk(0), wk(1), wk(1), wk(2), wk(3), wk(4), wk(5), wk(6)]
    assert [(s, q) for d, s, q in p1 if d in (wk(0), wk(2), wk(3), wk(5), wk(6))] == [(-1, 0)] * 5
    assert sorted(by[2]) == [(wk(0), 1, 1)] + [(wk(i), -1, 0) for i in range(1, 6)] + [(wk(6), 1, 1)]
    assert len(got) == 8 + 7


def test_next_non_null_matches_bruteforce(spark):
    rnd = random.Random(5)
    keys = list(range(0, 3000, 3))
    vals = {k: (rnd.random() if rnd.random() < 0.1 else None) for k in keys}
    df = spark.createDataFrame([(k, v) for k, v in vals.items()], "k long, v double")
    got = {r.k: r.nxt for r in next_non_null(df, "k", "v", "nxt", block_rows=37, partitions=7).collect()}
    for i, k in enumerate(keys):
        want = next((vals[j] for j in keys[i:] if vals[j] is not None), None)
        assert got[k] == want


def test_global_fill_takes_next_products_value(spark):
    rows = [row(1, 0, 0, 1, None), row(1, 0, 1, 1, None),      # product 1: no price at all
            row(2, 0, 0, 1, None), row(2, 0, 1, 1, 7.0),       # product 2: leading null
            row(3, 0, 0, 1, None)]                               # product 3: nothing after it
    df = spark.createDataFrame(rows, CUBE)
    glob = {(r.product_id, r.Date): r.AverageSellingPrice for r in
            fill_within_product(df, ["AverageSellingPrice"], scope="global").collect()}
    prod = {(r.product_id, r.Date): r.AverageSellingPrice for r in
            fill_within_product(df, ["AverageSellingPrice"]).collect()}
    assert glob[(1, wk(0))] == 7.0 and prod[(1, wk(0))] is None
    assert glob[(2, wk(0))] == 7.0 == prod[(2, wk(0))]
    assert glob[(3, wk(0))] is None


def test_candidates_within_bounds(spark):
    from margincast.operators.pricing import price_candidates
    df = spark.createDataFrame([(1, 3.0, 9.0), (2, 0.5, 0.5)], "product_id long, lower double, upper double")
    c = price_candidates(df, 20).collect()
    assert len(c) == 40
    assert all(r.lower <= r.price <= r.upper for r in c)
    assert {r.price for r in c if r.product_id == 1 and r.k in (0, 19)} == {3.0, 9.0}


def test_collapse_regions_sums_units_and_weights_price(spark):
    from margincast.operators.cube import collapse_regions
    rows = [row(1, 0, 1, 2, 10.0), row(1, 3, 1, 1, 13.0), row(1, 0, 2, 5, 12.0)]
    got = {r.Date: (r.QuantitySold, r.AverageSellingPrice, r.seller_state_encoded)
           for r in collapse_regions(spark.createDataFrame(rows, CUBE)).collect()}
    assert got[wk(1)] == (3, 11.0, -1) and got[wk(2)] == (5, 12.0, -1)


def test_carrying_while_generating_equals_filling_the_grid(spark):
    from margincast.operators.cube import MEASURES, mean_over_weeks
    rnd = random.Random(8)
    rows = []
    for p in range(25):
        for i in sorted(rnd.sample(range(12), rnd.randrange(1, 9))):
            for s in rnd.sample(range(4), rnd.choice([1, 1, 2])):
                price = None if p == 3 or rnd.random() < 0.4 else round(rnd.uniform(1, 9), 2)
                rows.append((p, "fashion_x", s, wk(i), 1, price, 1.0, rnd.choice([None, 2.0]), None, 3.0))
    cube = spark.createDataFrame(rows, CUBE)
    order, cols = ["Date", "seller_state_encoded"], MEASURES[1:]
    key = ["product_id", *order, "QuantitySold"]
    after = fill_within_product(densify(cube), cols, order).select(*key, *cols)
    first = fill_within_product(cube, cols, order)
    during = densify(first, carry=True).select(*key, *cols)
    assert sorted(after.collect(), key=repr) == sorted(during.collect(), key=repr)
    want = after.agg(F.avg("AverageSellingPrice")).first()[0]
    assert abs(mean_over_weeks(first, "AverageSellingPrice") - want) < 1e-9


def test_fast_rounding_equals_round(spark):
    import math
    from margincast.functions.scalars import round_places
    rnd = random.Random(3)
    vals = [None, 0.0, -0.0, math.nan, math.inf, -math.inf, 5e-7, -5e-7, 2.5e-6, 1.0000005, -1.0000005, 0.1234565, 1e300, 1e12, 999999.9999995]
    vals += [rnd.uniform(-1, 1) * 10 ** rnd.randint(-9, 9) for _ in range(3000)] + [round(rnd.uniform(-9, 9), 6) + 5e-7 for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in vals], "x double").select((F.round("x", 6) + F.lit(0.0)).alias("a"), round_places("x", 6).alias("b"))
    assert got.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0
    assert got.where("b = 0").count() and not [r for r in got.collect() if r.b == 0 and math.copysign(1, r.b) < 0]


def test_calendar_comes_from_a_table_of_days(spark):
    from margincast.operators.features import calendar_days, dense_features
    cube = spark.createDataFrame([row(1, 0, i, 1, 10.0 + i / 7) for i in range(0, 70)] + [row(2, 0, 3, 1, 5.0)], CUBE)
    days = calendar_days(cube).collect()
    assert len(days) == 69 * 7 + 1 and {d.IsHolidayWeek for d in days} == {0, 1}
    whole, cut = dense_features(cube), dense_features(cube, rounded={"Month_Sin": 3, "Price_Roll_Mean_4": 3, "PriceLag1_x_MonthSin": 3})
    assert whole.columns == cut.columns and whole.columns[:2] == ["Year", "Week"]
    a, b = ({r.Date: r for r in x.where("product_id = 1").collect()} for x in (whole, cut))
    assert a.keys() == b.keys() and len(a) == 18
    for d, r in a.items():
        assert abs(r.Month_Sin - round(r.Month_Sin, 9)) < 1e-8 and abs(b[d].Month_Sin - r.Month_Sin) <= 5.1e-4
        assert abs(b[d].PriceLag1_x_MonthSin - r.Price_Lag_1 * r.Month_Sin) <= 5.1e-4      # of the unrounded sine
        assert b[d].Price_Roll_Mean_4 == round(b[d].Price_Roll_Mean_4, 3)


def test_rolls_from_lags_equal_sliding_frames(spark):
    from margincast.operators.features import dense_features
    rnd = random.Random(21)
    rows = [row(p, s, i, rnd.randrange(1, 6), round(rnd.uniform(1, 9), 2) / 3) for p in range(4) for i in range(90)
            if i in (0, 89) or rnd.random() < 0.6 for s in rnd.sample(range(3), rnd.choice([1, 1, 2]))]
    lags = dense_features(spark.createDataFrame(rows, CUBE))
    # an unknown number of units, in a product of its own, asks for frames, which skip it
    frames = dense_features(spark.createDataFrame(rows + [row(9, 0, 40, None, 5.0)], CUBE)).where("product_id < 9")
    plan = [x._jdf.queryExecution().optimizedPlan().toString() for x in (lags, frames)]
    assert "RowFrame, -12, -1)" not in plan[0] and "RowFrame, -12, -1)" in plan[1]
    assert lags.columns == frames.columns and lags.dtypes == frames.dtypes
    key = lambda r: (r.product_id, r.Date, r.seller_state_encoded)
    a, b = sorted(lags.collect(), key=key), sorted(frames.collect(), key=key)
    assert len(a) == len(b) > 100
    for x, y in zip(a, b):
        for c in lags.columns:
            same = x[c] == y[c]
            assert same or "Std" in c and abs(x[c] - y[c]) < 1e-12, (c, x[c], y[c])
