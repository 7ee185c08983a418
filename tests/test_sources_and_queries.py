import os

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from margincast.sources import check_sources, load_driver_sources, read_sources
from margincast.sources.tables import SOURCE_FILES


def test_check_sources_present_and_missing(spark):
    res = {r.file: (r.present, r.all_ready) for r in
           check_sources(spark, SF0001, ["orders.parquet", "nope.csv"]).collect()}
    assert res["orders.parquet"][0] is True and res["nope.csv"][0] is False
    assert res["orders.parquet"][1] is False


def test_csv_sources_round_trip(spark, tmp_path):
    src = load_driver_sources(spark, SF0001)
    cols = {n: [f.name for f in s.fields] for n, s in
            __import__("margincast.sources.tables", fromlist=["SOURCE_SCHEMAS"]).SOURCE_SCHEMAS.items()}
    for name, df in src.items():
        full = df.select(*[F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string").alias(c)
                           for c in cols[name]])
        full.coalesce(1).write.option("header", True).csv(str(tmp_path / f"{name}.dir"))
        part = [f for f in os.listdir(tmp_path / f"{name}.dir") if f.endswith(".csv")][0]
        os.rename(tmp_path / f"{name}.dir" / part, tmp_path / SOURCE_FILES[name])
    back = read_sources(spark, str(tmp_path), "csv")
    for name, df in src.items():
        assert back[name].count() == df.count()


def test_translation_csv_with_bom(spark, tmp_path):
    from margincast.sources.tables import SOURCE_SCHEMAS
    rows = [("calcados", "fashion_shoes"), ("moda, esporte", "fashion_sport"), ("saude", "health_beauty")]
    for name, schema in SOURCE_SCHEMAS.items():
        lines = [",".join(schema.names)]
        if name == "translation":
            lines += [f'"{a}",{b}' for a, b in rows]
        (tmp_path / SOURCE_FILES[name]).write_text("\n".join(lines) + "\n", encoding="utf-8-sig")
    (tmp_path / SOURCE_FILES["translation"]).rename(tmp_path / "names.csv")
    t = read_sources(spark, str(tmp_path), "csv", files={"translation": "names.csv"})["translation"]
    assert sorted(tuple(r) for r in t.collect()) == sorted(rows)
    assert t.columns[0] == "product_category_name"


def test_r2_of_a_constant_label(spark):
    from margincast.operators.models import metrics
    met = spark.createDataFrame([(2.0, 2.0)] * 3, "y double, p double")
    missed = spark.createDataFrame([(2.0, 2.0), (2.0, 1.0)], "y double, p double")
    assert metrics(met, "y", "p").first()["r2"] == 1.0
    assert metrics(missed, "y", "p").first()["r2"] == 0.0


def test_cube_units_equal_lines(spark):
    from margincast.plans.common import cube, lines
    assert cube(spark, SF0001).agg(F.sum("QuantitySold")).first()[0] == lines(spark, SF0001).count()


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "optimal_price_brl" in df.columns


ORACLE_SAMPLE = ["a1_weekly_cube", "a7_top_products", "a11_product_analysis", "e2_batch_features",
                 "e3_service_features", "w10_row_split", "p5_grid_search", "p8_optimization_report",
                 "m8_metrics", "j7_densify"]


@pytest.mark.parametrize("name", ORACLE_SAMPLE)
def test_oracle_agrees_sf0001(spark, name):
    import __spark_entry__ as E
    con = duckdb.connect()
    for t in ["orders", "lineitem", "part", "supplier", "nation"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF0001)
    cols = sorted(sdf.columns)
    s = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols))
                for r in sdf.collect()), key=repr)
    res = con.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in res.description]
    assert sorted(dcols) == cols
    idx = [dcols.index(c) for c in cols]
    d = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in (row[i] for i in idx))
                for row in res.fetchall()), key=repr)
    assert s == d


@pytest.mark.parametrize("prefix", ["fashion_", None])
def test_preaggregated_cube_equals_line_cube(spark, prefix):
    from margincast.operators.cube import weekly_cube, weekly_cube_from_sources
    from margincast.operators.sales import sales_lines
    from margincast.sources.driver_tables import DELIVERED
    src = load_driver_sources(spark, SF0001)
    a = sorted(weekly_cube(sales_lines(src, DELIVERED, prefix)).collect())
    b = sorted(weekly_cube_from_sources(src, DELIVERED, prefix).collect())
    assert a == b and len(a) > 0


def test_entry_without_the_training_data_subpackage(monkeypatch):
    import sys

    import __spark_entry__ as E
    monkeypatch.setitem(sys.modules, "margincast.llm", None)
    monkeypatch.setitem(sys.modules, "margincast.llm.queries", None)
    names = set(E.queries())
    assert "a1_weekly_cube" in names and "pipeline" not in names
    assert set(E.oracle_sql()) <= names
