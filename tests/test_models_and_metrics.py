from pyspark.sql import functions as F

from margincast.operators.models import demand_model, mape, metrics, residual_hist, residuals


def test_mape_zero_actual_both_forms(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 5.0)], "y double, yhat double")
    skip = mape(df, "y", "yhat", "skip").first().mape
    eps = mape(df, "y", "yhat", "eps").first().mape
    assert abs(skip - (0.5 + 0.25) / 2 * 100) < 1e-9
    assert abs(eps - (1.0 / 1e-6 + 0.5 + 0.25) / 3 * 100) < 1e-3


def test_metrics_match_direct_formulas(spark):
    ys, ps = [1.0, 2.0, 3.0, 4.0], [1.5, 1.5, 3.5, 3.0]
    df = spark.createDataFrame(list(zip(ys, ps)), "y double, yhat double")
    m = metrics(df, "y", "yhat").first()
    e = [a - b for a, b in zip(ys, ps)]
    mean = sum(ys) / 4
    assert abs(m.mae - sum(abs(x) for x in e) / 4) < 1e-12
    assert abs(m.rmse - (sum(x * x for x in e) / 4) ** 0.5) < 1e-12
    assert abs(m.r2 - (1 - sum(x * x for x in e) / sum((y - mean) ** 2 for y in ys))) < 1e-12


def test_residual_histogram_counts_all_points(spark):
    df = spark.createDataFrame([(float(i), 0.0) for i in range(50)], "QuantitySold double, prediction double")
    h = residual_hist(residuals(df), 100).collect()
    assert len(h) == 99 and sum(r["count"] for r in h) == 50 and h[-1]["count"] >= 1


def test_linear_pipeline_fits_planted_line(spark):
    rows = [(float(x), 3.0 + 2.0 * x) for x in range(30)]
    df = spark.createDataFrame(rows, "x double, QuantitySold double")
    model = demand_model("linear", ["x"]).fit(df)
    pred = model.transform(df)
    assert metrics(pred).first().rmse < 1e-6


def test_search_goes_on_where_it_stopped(spark, tmp_path):
    from pyspark.sql import functions as F

    from margincast.operators.models import GBT_FIXED, GBT_SPACE, demand_model, resumable_search, with_folds
    rows = [(i, float(i % 17), float(i % 5), float(3 * (i % 17) + (i % 5) + i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, QuantitySold double")
    pipe = demand_model("gbt_a", ["a", "b"])
    space = GBT_SPACE | {"maxIter": ("int", 2, 4), "maxDepth": ("choice", [2, 3])}
    args = dict(folds=3, seed=5, key_cols=["id"], fixed=GBT_FIXED)
    first = resumable_search(pipe, space, df, str(tmp_path), n=2, **args).collect()
    stamp = {r.draw: r.r2_mean for r in first}
    done = spark.read.parquet(f"{tmp_path}/draws").select("draw", "fit_sec").collect()
    more = resumable_search(pipe, space, df.repartition(5), str(tmp_path), n=4, **args).collect()
    again = spark.read.parquet(f"{tmp_path}/draws")
    assert {r.draw for r in more} == {0, 1, 2, 3} and all(r.folds == 3 for r in more)
    assert all(abs(stamp[r.draw] - r.r2_mean) < 1e-12 for r in more if r.draw in stamp)
    # the first draws were not fitted again
    assert sorted(map(tuple, done)) == sorted(map(tuple, again.where("draw < 2").select("draw", "fit_sec").collect()))
    assert [r.best for r in more] == [True, False, False, False] and more[0].r2_mean > 0.5
    a = with_folds(df, 3, 5, ["id"]).select("id", "fold").collect()
    b = with_folds(df.repartition(7), 3, 5, ["id"]).orderBy(F.desc("id")).select("id", "fold").collect()
    assert sorted(a) == sorted(b) and {r.fold for r in a} == {0, 1, 2}


def test_units_before_scoring(spark):
    from margincast.operators.models import demand_units
    df = spark.createDataFrame([(1.0, -3.2), (2.0, 2.5), (2.0, 1.5), (0.0, 0.4)], "y double, prediction double")
    assert [r.prediction for r in demand_units(df).collect()] == [0.0, 2.0, 2.0, 0.0]


def test_rows_of_a_fit_are_dealt_over_the_cores(spark):
    from margincast.session import spread
    rows = [(i % 40, i // 40, float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "product_id int, week int, y double").coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    some = spread(df, ["product_id", "week"], rows_per_task=100, rows_per_partition=1_000_000)
    assert some.rdd.getNumPartitions() == min(cores, 60) and sorted(map(tuple, some.collect())) == sorted(rows)
    more = spread(df, ["product_id", "week"], rows_per_task=1, rows_per_partition=-(-6000 // (2 * cores)))
    assert more.rdd.getNumPartitions() == 2 * cores        # whole waves
    assert spread(df, ["product_id", "week"], rows_per_task=6000) is df
    # the same rows in the same places, however they came
    again = spread(df.repartition(7), ["product_id", "week"], rows_per_task=100, rows_per_partition=1_000_000)
    assert some.rdd.glom().collect() == again.rdd.glom().collect()


def test_queries_fit_on_spread_rows(spark, monkeypatch):
    from margincast.plans import catalog
    frame = spark.range(6000).selectExpr("id % 50 AS product_id", "date_add(date'2018-01-01', cast(7 * (id div 50) AS int)) AS Date",
                                         "0 AS seller_state_encoded", "1.0 AS QuantitySold")
    monkeypatch.setattr(catalog, "batch_frame", lambda spark, d: frame.coalesce(1))
    f = catalog._Fit(spark, "")
    assert (f.train.count(), f.test.count()) == (4800, 1200)
    assert f.train.rdd.getNumPartitions() > 1 and f.test.rdd.getNumPartitions() > 1
    assert f.pipeline("rf").getStages()[-1].getCacheNodeIds()


def test_fit_builds_only_the_sides_a_query_reads(spark, monkeypatch):
    from pyspark.sql import functions as F
    from margincast.plans import catalog
    feats = spark.createDataFrame([(p, 1, 1, i, i % 5 < 4) for p in range(3) for i in range(10)],
                                  "product_id long, Date int, seller_state_encoded int, QuantitySold long, is_train boolean")
    monkeypatch.setattr(catalog, "batch_frame", lambda *a: (_ for _ in ()).throw(AssertionError("built a second time")))
    f = catalog._Fit(spark, "nowhere", feats)
    assert "test" not in vars(f)
    assert f.train.count() == 24 and f.test.count() == 6 and "test" in vars(f)
    assert f.test is f.test and "is_train" not in f.train.columns
    assert f.test.agg(F.sum("QuantitySold")).first()[0] == 3 * (4 + 9)


def test_forest_search_draws_from_the_whole_space(spark, monkeypatch):
    import duckdb

    from margincast.operators import models
    from margincast.plans import catalog
    seen = {}

    def search(pipeline, space, train, path, **args):
        seen.update(args, space=space, trees=pipeline.getStages()[-1].getNumTrees())
        return spark.range(args["n"]).selectExpr("cast(id AS int) AS draw", f"{args['folds']} AS folds", "0.5 AS r2_mean", "0.1 AS r2_std")

    frame = spark.createDataFrame([(p, 1, 1, 1) for p in range(10)], "product_id long, Date int, seller_state_encoded int, QuantitySold long")
    monkeypatch.setattr(catalog, "batch_frame", lambda *a: frame)
    monkeypatch.setattr(models, "resumable_search", search)
    fn, sql = catalog.REGISTRY["m5_random_search"]
    got = sorted(map(tuple, fn(spark, "").collect()))
    assert (seen["n"], seen["folds"], seen["space"]) == (20, 3, models.RF_SPACE) and not seen["fixed"]
    assert got == sorted(duckdb.sql(sql).fetchall()) and len(got) == 20


def test_profit_of_every_demand_model(spark, monkeypatch):
    from types import SimpleNamespace

    from margincast.operators.models import MODEL_SETTINGS
    from margincast.plans import catalog
    P, tiny = "AverageSellingPrice", {"gbt_a": dict(maxIter=1), "gbt_b": dict(maxIter=1), "rf": dict(numTrees=2), "linear": {}}
    train = spark.createDataFrame([(float(x), 9.0 - x % 7) for x in range(60)], f"{P} double, QuantitySold double")
    base = spark.createDataFrame([(p, 10.0 + p, 1.0, 5.0, 15.0) for p in range(4)],
                                 "product_id long, current_price double, cost double, lower double, upper double")
    price = SimpleNamespace(feats=None, base=base.drop("cost", "lower", "upper"), costs=base.select("product_id", "cost"),
                            bounds=lambda: base.select("product_id", "lower", "upper"))
    monkeypatch.setattr(catalog, "_Price", lambda *a: price)
    monkeypatch.setattr(catalog, "_Fit", lambda *a: SimpleNamespace(
        train=train, pipeline=lambda kind: demand_model(kind, [P], **tiny[kind])))
    got = catalog.REGISTRY["p10m_profit_by_model"][0](spark, "").collect()
    assert {r.model for r in got} == set(MODEL_SETTINGS) and len(got) == 4
    assert all(r.products == 4 and r.total_profit > 0 for r in got)


def test_forest_grown_in_parts_is_one_forest(spark, monkeypatch, tmp_path):
    from pyspark.ml import PipelineModel

    from margincast.operators import models
    monkeypatch.setattr(models, "FOREST_CELLS", 4 * 300, raising=False)       # four trees at a time
    fits = []
    whole = models.RandomForestRegressor._fit
    monkeypatch.setattr(models.RandomForestRegressor, "_fit", lambda self, df: fits.append(self.getNumTrees()) or whole(self, df))
    df = spark.createDataFrame([(float(i % 17), float(i % 5), float(3 * (i % 17) + i % 5)) for i in range(300)],
                               "a double, b double, QuantitySold double")
    m = demand_model("rf", ["a", "b"], numTrees=10).fit(df)
    forest = m.stages[-1]
    assert fits == [4, 4, 2] and forest.getNumTrees == 10 and forest.numFeatures == 2 and forest.getMaxDepth() == 30
    trees = [t.toDebugString.split("\n", 1)[1] for t in forest.trees]
    assert len(set(trees)) == 10                                              # no part repeats another's draws
    rows = m.transform(df).select("features", "prediction").limit(20).collect()
    assert all(abs(r.prediction - sum(t.predict(r.features) for t in forest.trees) / 10) < 1e-9 for r in rows)
    assert abs(sum(forest.featureImportances.toArray()) - 1) < 1e-9 and metrics(m.transform(df)).first().r2 > 0.8
    m.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert [r.prediction for r in again.transform(df).collect()] == [r.prediction for r in m.transform(df).collect()]


def test_leaderboard_scores_a_side_once(spark):
    from margincast.operators.models import compare
    train = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "QuantitySold double")
    test = spark.createDataFrame([(0.0,), (2.0,), (3.0,)], "QuantitySold double")
    scored = []

    passes = []

    class Counted:                   # counts the passes over what was scored
        def __init__(self, df):
            self.df = df

        def __getattr__(self, name):
            made = getattr(self.df, name)
            return (lambda *a: passes.append(name) or made(*a)) if name in ("agg", "select") else made

    class Constant:
        def __init__(self, at):
            self.at = at

        def fit(self, df):
            return self

        def transform(self, df):
            scored.append(df.withColumn("prediction", F.lit(self.at)))
            return Counted(scored[-1])

    board, fitted = compare({"a": Constant(1.0), "b": Constant(2.0)}, train, test)
    rows = {r.model: r for r in board.collect()}
    assert len(passes) == 4 and len(scored) == 4 and {k: m.at for k, m in fitted.items()} == {"a": 1.0, "b": 2.0}
    for name, at in (("a", 1.0), ("b", 2.0)):
        tr, te = (metrics(x.withColumn("prediction", F.lit(at))).first() for x in (train, test))
        r = rows[name]
        assert (r.train_mae, r.train_rmse, r.train_r2, r.test_mae, r.test_rmse, r.test_r2) == (*tr[1:], *te[1:])
        assert r.test_mape == mape(test.withColumn("prediction", F.lit(at))).first().mape and r.overfit_gap_r2 == tr.r2 - te.r2
    assert board.first().model == "b"
