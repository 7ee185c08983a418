"""CSV files with byte-order marks, quoted line breaks and malformed rows; stored encoders."""

import pytest
from pyspark.sql import functions as F

from margincast.operators.models import demand_model
from margincast.sources.model_store import encode, fit_encoders, load_encoders, load_model, save_model
from margincast.sources.tables import SOURCE_FILES, SOURCE_SCHEMAS, read_sources, read_sources_checked

ITEMS = ('﻿order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n'
         'o1,1,"p ""one""",s1,2018-01-01 00:00:00,10.5,1\n'
         'o2,1,"line\nbreak, comma",s1,,20.25,\n'
         'o3,first,p3,s1,,30,\n'
         'o4,1,p4\n'
         'o5,2,p5,s2,,,3\n')


@pytest.fixture
def folder(tmp_path):
    for name, schema in SOURCE_SCHEMAS.items():
        text = ITEMS if name == "order_items" else "﻿" + ",".join(schema.names) + "\n"
        (tmp_path / SOURCE_FILES[name]).write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_malformed_rows_are_set_apart(spark, folder):
    src, bad = read_sources_checked(spark, folder)
    rows = {r.order_id: r for r in src["order_items"].collect()}
    assert set(rows) == {"o1", "o2", "o5"}
    assert rows["o1"].product_id == 'p "one"' and rows["o2"].product_id == "line\nbreak, comma" and rows["o5"].price is None
    assert sorted(r.record.split(",")[0] for r in bad.where("source = 'order_items'").collect()) == ["o3", "o4"]
    assert bad.count() == 2
    # the same rows are bad whatever columns a query reads
    assert src["order_items"].select("product_id").count() == 3
    assert src["order_items"].agg(F.sum("price")).first()[0] == 30.75
    assert src["orders"].count() == 0


def test_failfast_stops_at_a_malformed_row(spark, folder):
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        read_sources(spark, folder)["order_items"].collect()


def frame(spark):
    rows = [(f"p{i % 7}", "ab"[i % 2], float(i), float(3 * i + i % 7)) for i in range(60)]
    return spark.createDataFrame(rows, "product string, kind string, price double, QuantitySold double")


def test_stored_encoders_score_new_rows_in_a_new_session(spark, tmp_path):
    train, cols = frame(spark), ["product_code", "kind_code", "price"]
    enc = fit_encoders(train, {"product": "product_code", "kind": "kind_code"}, unseen="code")
    model = demand_model("linear", cols).fit(encode(train, enc))
    save_model(model, str(tmp_path), spark, cols, enc)
    new = [("p3", "a", 5.0), ("p9", "b", 6.0), (None, "z", 7.0)]
    before = sorted(model.transform(encode(spark.createDataFrame(new, "product string, kind string, price double"), enc))
                    .select("price", "product_code", "kind_code", "prediction").collect())
    other = spark.newSession()
    loaded, feats = load_model(str(tmp_path), other)
    assert [r.feature for r in feats.collect()] == cols
    rows = other.createDataFrame(new, "product string, kind string, price double")
    after = sorted(loaded.transform(encode(rows, load_encoders(str(tmp_path), other)))
                   .select("price", "product_code", "kind_code", "prediction").collect())
    assert after == before
    assert [(r.product_code, r.kind_code) for r in after] == [(3, 0), (-1, 1), (-1, -1)]


def test_unseen_values_by_rule(spark):
    train = frame(spark)
    new = spark.createDataFrame([("p1", 1), ("new", 2), (None, 3)], "product string, k int")
    drop = fit_encoders(train, {"product": "c"}, unseen="drop")
    assert [(r.k, r.c) for r in encode(new, drop).collect()] == [(1, 1)]
    error = fit_encoders(train, {"product": "c"})
    assert [r.c for r in encode(new.where("k = 1"), error).collect()] == [1]
    with pytest.raises(Exception, match="not in the dictionary: new"):
        encode(new.where("k = 2"), error).collect()
    with pytest.raises(ValueError):
        fit_encoders(train, {"product": "c"}, unseen="guess")
