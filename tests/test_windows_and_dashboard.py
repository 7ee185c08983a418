import datetime as dt

from pyspark.sql import functions as F

from margincast.operators.dashboard import recent_change
from margincast.operators.windows import by_product, fill_within_product, lag, latest_rows

SCHEMA = ("product_id long, seller_state_encoded int, Date date, QuantitySold long, "
          "AverageSellingPrice double")


def d(s):
    return dt.date.fromisoformat(s)


def test_lag_crosses_regions_in_one_week(spark):
    rows = [(1, 0, d("2018-01-01"), 3, 10.0), (1, 2, d("2018-01-01"), 5, 11.0),
            (1, 1, d("2018-01-08"), 7, 12.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.seller_state_encoded, r.Date): r.l1 for r in
           df.select("seller_state_encoded", "Date", lag("QuantitySold", 1).alias("l1")).collect()}
    assert got[(0, d("2018-01-01"))] is None
    assert got[(2, d("2018-01-01"))] == 3      # previous row = other region, same week
    assert got[(1, d("2018-01-08"))] == 5


def test_leading_null_price_filled_within_product(spark):
    rows = [(1, 0, d("2018-01-01"), 1, None), (1, 0, d("2018-01-08"), 1, 5.0),
            (1, 0, d("2018-01-15"), 1, None), (2, 0, d("2018-01-01"), 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = fill_within_product(df, ["AverageSellingPrice"], default={"AverageSellingPrice": -1.0})
    got = {(r.product_id, r.Date): r.AverageSellingPrice for r in out.collect()}
    assert got[(1, d("2018-01-01"))] == 5.0     # backward fill
    assert got[(1, d("2018-01-15"))] == 5.0     # forward fill
    assert got[(2, d("2018-01-01"))] == -1.0    # all-null product: default, not a neighbour


def test_recent_change_needs_eight_rows(spark):
    base = [(i, 0, d("2018-01-01") + dt.timedelta(days=7 * i), i + 1, 10.0) for i in range(8)]
    eight = spark.createDataFrame(base, SCHEMA)
    seven = spark.createDataFrame(base[1:], SCHEMA)
    r7 = recent_change(seven).first()
    assert (r7.revenue_change, r7.sales_change) == (0.0, 0.0)
    r8 = recent_change(eight).first()
    recent, prev = sum(range(5, 9)), sum(range(1, 5))
    assert abs(r8.sales_change - (recent / (prev + 1e-6) - 1) * 100) < 1e-9


def test_latest_row_per_product(spark):
    rows = [(1, 0, d("2018-01-01"), 1, 1.0), (1, 3, d("2018-01-08"), 2, 2.0),
            (1, 1, d("2018-01-08"), 9, 9.0), (2, 0, d("2018-01-01"), 4, 4.0)]
    got = {r.product_id: r.QuantitySold for r in latest_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 2, 2: 4}
