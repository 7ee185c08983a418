import random

from pyspark.sql import functions as F

from margincast.operators.ordering import dense_codes, ordered_index
from margincast.operators.splits import row_split


def test_ordered_index_matches_sorted_rank(spark):
    rnd = random.Random(7)
    keys = rnd.sample(range(100000), 3000)
    df = spark.createDataFrame([(k, rnd.randint(1, 9)) for k in keys], "k long, w long")
    got = {r.k: (r._rank, r.before) for r in
           ordered_index(ordered_index(df, ["k"], partitions=13), ["k"], out="before", weight="w",
                         partitions=5).collect()}
    ws = dict(df.collect())
    running = 0
    for i, k in enumerate(sorted(keys)):
        assert got[k] == (i, running)
        running += ws[k]


def test_dense_codes_string_keys(spark):
    vals = ["b", "a", "c", "a", None, "b"]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    codes = {r.s: r.code for r in dense_codes(df, "s", "code", partitions=3).collect()}
    assert codes == {"a": 0, "b": 1, "c": 2}


def test_row_split_positional_and_complete(spark):
    rows = [(p, 0, __import__("datetime").date(2018, 1, 1 + w), 1, 1.0)
            for p in range(37) for w in range(p % 5 + 1)]
    df = spark.createDataFrame(rows, "product_id long, seller_state_encoded int, Date date, "
                                     "QuantitySold long, AverageSellingPrice double")
    out = row_split(df, 0.8).collect()
    n = len(rows)
    assert len(out) == n
    ordered = sorted(out, key=lambda r: (r.product_id, r.Date))
    flags = [r.is_train for r in ordered]
    cut = int(n * 0.8)
    assert flags == [True] * cut + [False] * (n - cut)


def test_ordered_index_under_aqe_coalescing(spark):
    rnd = random.Random(11)
    keys = rnd.sample(range(10**6), 5000)
    df = spark.createDataFrame([(k, 1) for k in keys], "k long, w long")
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions",
                                          "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    try:
        got = {r.k: r._rank for r in ordered_index(df, ["k"]).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [got[k] for k in sorted(keys)] == list(range(len(keys)))


def test_encode_small_falls_back_when_bound_fails(spark, monkeypatch):
    import margincast.operators.cube as C
    df = spark.createDataFrame([(v,) for v in ["d", "b", "a", "c", "b", None]], "s string")
    small = {r.s: r.code for r in C.encode_small(df, "s", "code").collect()}
    monkeypatch.setattr(C, "SMALL_DICT_MAX", 2)
    large = {r.s: r.code for r in C.encode_small(df, "s", "code").collect()}
    assert small == large == {"a": 0, "b": 1, "c": 2, "d": 3, None: None}
