"""Demand models on Spark MLlib, metrics as SQL aggregates.

Metrics (M8, M9, M15) are plain aggregations over any (label, prediction)
columns, so they are oracle-checkable; model fits are MLlib jobs.
"""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margincast.functions.scalars import as_units, mape_verdict, overfit_verdict, r2_verdict
from margincast.operators.splits import sample_n
from margincast.session import reuse

LABEL = "QuantitySold"

# Model settings of the batch script and service
# (trees/iterations, learning rate, depth, min rows per leaf, seed).
MODEL_SETTINGS = {
    "gbt_a": dict(maxIter=100, stepSize=0.05, maxDepth=7, minInstancesPerNode=20, seed=42),
    "gbt_b": dict(maxIter=300, stepSize=0.05, maxDepth=7, subsamplingRate=0.8,
                  featureSubsetStrategy="0.8", seed=42),
    "rf": dict(numTrees=400, featureSubsetStrategy="sqrt", maxDepth=30, seed=42),
    "linear": dict(regParam=0.0),
}


# Fixed value: rows x trees of a forest grown at a time.  MLlib keeps a count and a node
# per row and tree: some 12 bytes each with the nodes before and after a level.
FOREST_CELLS = 500_000_000


class PartedForest(RandomForestRegressor):
    """A forest grown a part of its trees at a time, so what a row keeps does not grow
    with the number of trees.  Parts have seeds of their own; the model is the one
    MLlib makes of all their trees.  With few rows it is a single part."""

    def _fit(self, dataset):
        trees = self.getNumTrees()
        size = max(1, FOREST_CELLS // max(1, dataset.count()))
        if size >= trees:
            return super()._fit(dataset)
        cols = [self.getFeaturesCol(), self.getLabelCol()]
        if self.isDefined(self.weightCol) and self.getWeightCol():
            cols.append(self.getWeightCol())
        kept = reuse(dataset.select(*cols))
        grown = []
        for start in range(0, trees, size):
            part = self.copy({self.numTrees: min(size, trees - start), self.seed: self.getSeed() + start})
            grown.append(super(PartedForest, part)._fit(kept))
        kept.unpersist()
        sc = dataset.sparkSession.sparkContext
        ml = sc._jvm.org.apache.spark.ml.regression
        joined = [tree for model in grown for tree in model._java_obj.trees()]
        every = sc._gateway.new_array(ml.DecisionTreeRegressionModel, len(joined))
        for i, tree in enumerate(joined):
            every[i] = tree
        self._transfer_params_to_java()
        java = ml.RandomForestRegressionModel(self.uid, every, grown[0].numFeatures)
        model = RandomForestRegressionModel(self._java_obj.copyValues(java, self._empty_java_param_map()))
        return self._copyValues(model)


def demand_model(kind: str, feature_cols: list[str], label: str = LABEL, **overrides) -> Pipeline:
    """M1–M4: assemble → standard-scale → regressor, as one Pipeline."""
    params = {**MODEL_SETTINGS[kind], **overrides}
    if kind.startswith("gbt"):
        reg = GBTRegressor(featuresCol="features", labelCol=label, **params)
    elif kind == "rf":
        # every row keeps its node per tree: a level moves it one step instead of walking from the root
        reg = PartedForest(featuresCol="features", labelCol=label, **{"cacheNodeIds": True, **params})
    elif kind == "linear":
        reg = LinearRegression(featuresCol="features", labelCol=label, **params)
    else:
        raise ValueError(kind)
    return Pipeline(stages=[
        VectorAssembler(inputCols=feature_cols, outputCol="features_raw", handleInvalid="error"),
        StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True),
        reg])


class LogTargetModel:
    """M6: fit on log1p(label), predict expm1(prediction)."""

    def __init__(self, pipeline: Pipeline, label: str = LABEL):
        self.pipeline, self.label = pipeline, label
        self.model: PipelineModel | None = None

    def fit(self, df: DataFrame) -> "LogTargetModel":
        pipeline = self.pipeline.copy()          # the caller's pipeline keeps its own label
        pipeline.getStages()[-1].setLabelCol("_log_label")
        self.model = pipeline.fit(df.withColumn("_log_label", F.log1p(F.col(self.label))))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumn("prediction", F.expm1("prediction"))


def predict(model, df: DataFrame) -> DataFrame:
    """M7: batch prediction, one transform over all rows."""
    return model.transform(df).drop("features_raw", "features")


def metrics(pred: DataFrame, label: str = LABEL, prediction: str = "prediction", extra: list | None = None) -> DataFrame:
    """M8: n, MAE, RMSE, R² (= 1 − SSE / (n·var_pop(y))) as one row.  On a
    constant label R² is 1 when every prediction meets it, else 0.  ``extra``:
    further aggregates of the same pass."""
    e = F.col(label).cast("double") - F.col(prediction)
    agg = pred.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
                   F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("_sse"),
                   F.var_pop(F.col(label).cast("double")).alias("_var"),
                   (F.min(label) == F.max(label)).alias("_flat"), *(extra or []))
    more = agg.columns[6:]
    return agg.select("n", "mae", "rmse",
                      F.when(F.col("_flat"), (F.col("_sse") == 0).cast("double"))
                      .otherwise(F.lit(1.0) - F.col("_sse") / F.nullif(F.col("n") * F.col("_var"), F.lit(0.0)))
                      .alias("r2"), *more)


def mape(pred: DataFrame, label: str = LABEL, prediction: str = "prediction",
         zero: str = "skip") -> DataFrame:
    """M9: mean absolute % error; zero actuals skipped, or replaced by 1e-6."""
    y = F.col(label).cast("double")
    err = F.abs(y - F.col(prediction))
    if zero == "skip":
        term = F.when(y != 0, err / F.abs(y))
    else:
        term = err / F.abs(F.when(y == 0, F.lit(1e-6)).otherwise(y))
    return pred.agg((F.avg(term) * 100).alias("mape"))


def residuals(pred: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, residual) points."""
    return pred.select(F.col(label).cast("double").alias("actual"),
                       F.col(prediction).alias("predicted"),
                       (F.col(label).cast("double") - F.col(prediction)).alias("residual"))


def residual_hist(points: DataFrame, edges: int = 100, col: str = "residual") -> DataFrame:
    """Histogram over ``edges`` evenly spaced edges (edges − 1 bins,
    the last bin closed).  Empty bins are reported with 0."""
    span = points.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = span["lo"], span["hi"]
    nb = edges - 1
    width = (hi - lo) / nb if hi is not None and hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(nb - 1)).cast("int")
    counts = points.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = points.sparkSession.range(nb).select(F.col("id").cast("int").alias("bin"))
    return (bins.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"),
                    F.coalesce("count", F.lit(0)).alias("count")))


def _metric_row(pred: DataFrame, label: str) -> dict:
    return metrics(pred, label).first().asDict()


def demand_units(pred: DataFrame, prediction: str = "prediction") -> DataFrame:
    """X6 on a scored table: predictions as whole units, none below zero."""
    return pred.withColumn(prediction, as_units(prediction))


def _scores(pred: DataFrame, label: str) -> dict:
    """M8 and M9 in one pass over the scored rows."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col("prediction")
    points = pred.select(F.col(label), F.col("prediction"), F.when(y != 0, F.abs(e) / F.abs(y)).alias("_ape"))
    return metrics(points, label, extra=[(F.avg("_ape") * 100).alias("mape")]).first().asDict()


def compare(models: dict, train: DataFrame, test: DataFrame, label: str = LABEL, units: bool = False):
    """Fit every model on the (cached) train side, score both sides (raw,
    or with ``units`` after rounding to whole non-negative units), return (leaderboard DataFrame, fitted models).  Leaderboard order: test
    R² descending, then test RMSE ascending (T3).  A side is scored once a model."""
    spark = train.sparkSession
    rows, fitted = [], {}
    for name, est in models.items():
        t0 = time.time()
        m = est.fit(train)
        fit_s = time.time() - t0
        fitted[name] = m
        scored = (lambda df: demand_units(m.transform(df))) if units else m.transform  # noqa: B023
        tr, te = _scores(scored(train), label), _scores(scored(test), label)
        rows.append((name, tr["mae"], te["mae"], tr["rmse"], te["rmse"], tr["r2"], te["r2"], te["mape"],
                     (tr["r2"] - te["r2"]) if tr["r2"] is not None and te["r2"] is not None else None,
                     float(fit_s)))
    board = spark.createDataFrame(rows, "model string, train_mae double, test_mae double, "
                                        "train_rmse double, test_rmse double, train_r2 double, "
                                        "test_r2 double, test_mape double, overfit_gap_r2 double, "
                                        "train_time_sec double")
    board = board.withColumns({"r2_verdict": r2_verdict("test_r2"),
                               "overfit_verdict": overfit_verdict("train_r2", "test_r2"),
                               "mape_verdict": mape_verdict("test_mape")})
    return board.orderBy(F.desc("test_r2"), F.asc("test_rmse")), fitted


def cross_validate(est, df: DataFrame, k: int = 3, n: int = 10000, seed: int = 42,
                   label: str = LABEL) -> DataFrame:
    """K contiguous folds over a seeded sample of up to n rows; mean ±
    population std of MAE and R²; stable when std(R²) < 0.05."""
    from margincast.operators.ordering import ordered_index
    s = sample_n(df, n, seed).withColumn("_h", F.xxhash64(F.lit(seed + 1), *[F.col(c) for c in df.columns]))
    s = ordered_index(s, ["_h"] + df.columns[:1], out="_rank")
    m = s.count()
    s = s.withColumn("fold", F.floor(F.col("_rank") * k / F.lit(m)).cast("int")).drop("_h", "_rank")
    s = s.cache()
    spark = df.sparkSession
    rows = []
    for f in range(k):
        model = est.fit(s.where(F.col("fold") != f))
        r = _metric_row(model.transform(s.where(F.col("fold") == f)), label)
        rows.append((f, r["mae"], r["r2"]))
    s.unpersist()
    folds = spark.createDataFrame(rows, "fold int, mae double, r2 double")
    return folds.agg(F.avg("mae").alias("mae_mean"), F.stddev_pop("mae").alias("mae_std"),
                     F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"),
                     F.count(F.lit(1)).alias("folds")).withColumn("stable", F.col("r2_std") < 0.05)


def importance(model: PipelineModel, feature_cols: list[str], n: int = 10) -> DataFrame:
    """Feature importances of a fitted tree pipeline, top n."""
    spark = SparkSessionOf(model)
    imp = model.stages[-1].featureImportances.toArray().tolist()
    df = spark.createDataFrame(list(zip(feature_cols, [float(x) for x in imp])),
                               "feature string, importance double")
    return df.orderBy(F.desc("importance"), F.asc("feature")).limit(n)


def SparkSessionOf(_model):
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


def training_summary(features: DataFrame, split: DataFrame, feature_cols: list[str],
                     started: float | None = None) -> DataFrame:
    """Rows, products, categories, split sizes, feature count, duration."""
    from margincast.operators.sales import CATEGORY
    out = split.agg(
        F.count(F.lit(1)).alias("data_size"),
        F.countDistinct("product_id").alias("num_products"),
        F.countDistinct(CATEGORY).alias("num_categories"),
        F.sum(F.col("is_train").cast("int")).cast("long").alias("train_samples"),
        F.sum((~F.col("is_train")).cast("int")).cast("long").alias("test_samples"))
    out = out.withColumn("num_features", F.lit(len(feature_cols)))
    if started is not None:
        out = out.withColumn("training_time", F.lit(round(time.time() - started, 1)))
    return out


# Random-search spaces of the earlier script, mapped to MLlib
# parameter names (depth "unlimited" becomes MLlib's maximum, 30).
RF_SPACE = {"numTrees": ("int", 100, 300), "maxDepth": ("choice", [30, 15, 20, 25]),
            "minInstancesPerNode": ("int", 1, 4),
            "featureSubsetStrategy": ("choice", ["sqrt", "0.7", "0.9"]),
            "subsamplingRate": ("choice", [0.7, 0.9])}
GBT_SPACE = {"maxIter": ("int", 200, 500), "stepSize": ("choice", [0.01, 0.02, 0.05]),
             "maxDepth": ("choice", [30, 15, 20]),
             "featureSubsetStrategy": ("choice", ["0.7", "0.9"])}
# What the boosted-tree search holds constant (rows a leaf, row share).
GBT_FIXED = {"minInstancesPerNode": 50, "subsamplingRate": 0.8}


def sample_param_maps(reg, space: dict, n: int = 20, seed: int = 42) -> list:
    """Draw n parameter maps from a space of int ranges and choices."""
    rng = random.Random(seed)
    maps = []
    for _ in range(n):
        pm = {}
        for name, spec in space.items():
            p = reg.getParam(name)
            if spec[0] == "int":
                pm[p] = rng.randint(spec[1], spec[2])
            else:
                pm[p] = rng.choice(spec[1])
        maps.append(pm)
    return maps


def random_search(pipeline: Pipeline, space: dict, n: int = 20, folds: int = 3, seed: int = 42,
                  parallelism: int = 4, label: str = LABEL) -> CrossValidator:
    """M5: n sampled parameter maps × k folds scored by R² (CrossValidator)."""
    reg = pipeline.getStages()[-1]
    maps = sample_param_maps(reg, space, n, seed)
    ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="r2")
    return CrossValidator(estimator=pipeline, estimatorParamMaps=maps, evaluator=ev,
                          numFolds=folds, parallelism=parallelism, seed=seed)


def with_folds(df: DataFrame, folds: int = 3, seed: int = 42, key_cols: list[str] | None = None, out: str = "fold") -> DataFrame:
    """Folds by a seeded hash of the row's key: a row keeps its fold on every
    read and partitioning, so a search can stop and go on later."""
    key = [F.col(c) for c in (key_cols or df.columns)]
    return df.withColumn(out, F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(folds)).cast("int"))


def resumable_search(pipeline: Pipeline, space: dict, train: DataFrame, path: str, n: int = 20, folds: int = 3,
                     seed: int = 42, parallelism: int = 4, label: str = LABEL, key_cols: list[str] | None = None,
                     fixed: dict | None = None) -> DataFrame:
    """M5 as a job that survives being stopped: ``n`` sampled parameter maps x
    ``folds`` hash folds, scored by R², best first (``draw, params, r2_mean,
    r2_std, best``).

    The feature stages are fitted once and their output (vector, label, fold) is
    kept; ``parallelism`` draws are fitted at a time over it.  Every finished draw
    is written to ``path`` and skipped when the search is started again with
    the same seed and space.  ``fixed`` parameters hold for every draw."""
    spark = train.sparkSession
    reg = pipeline.getStages()[-1].copy({pipeline.getStages()[-1].getParam(k): v for k, v in (fixed or {}).items()})
    prep = Pipeline(stages=pipeline.getStages()[:-1]).fit(train)
    # the fold is a column of the kept frame: fits filter it and read nothing else
    data = reuse(prep.transform(with_folds(train, folds, seed, key_cols, "_fold")).select("features", label, "_fold"))
    maps = sample_param_maps(reg, space, n, seed)
    schema = "draw int, params string, fold int, r2 double, fit_sec double"

    def finished() -> DataFrame:
        try:
            return spark.read.schema(schema).parquet(f"{path}/draws")
        except AnalysisException:              # nothing written yet
            return spark.createDataFrame([], schema)

    def run(draw: int) -> None:
        named = str(sorted((p.name, v) for p, v in maps[draw].items()))
        rows = []
        for f in range(folds):
            t0 = time.time()
            model = reg.copy(maps[draw]).fit(data.where(F.col("_fold") != f))
            r2 = _metric_row(model.transform(data.where(F.col("_fold") == f)), label)["r2"]
            rows.append((draw, named, f, r2, time.time() - t0))
        # a folder of its own: draws finish side by side
        spark.createDataFrame(rows, schema).drop("draw").coalesce(1).write.mode("overwrite").parquet(f"{path}/draws/draw={draw}")

    done = {r["draw"] for r in finished().select("draw").distinct().collect()}
    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(inheritable_thread_target(spark)(run), [i for i in range(n) if i not in done]))
    data.unpersist()
    per_draw = finished().where(F.col("draw") < n).groupBy("draw", "params").agg(
        F.avg("r2").alias("r2_mean"), F.stddev_pop("r2").alias("r2_std"), F.count(F.lit(1)).alias("folds"))
    best = per_draw.agg(F.max_by("draw", F.struct("r2_mean", -F.col("draw")))).first()[0]
    return per_draw.withColumn("best", F.col("draw") == F.lit(best)).orderBy(F.desc("r2_mean"), "draw")


__all__ = ["demand_model", "LogTargetModel", "predict", "metrics", "mape", "residuals",
           "residual_hist", "compare", "cross_validate", "importance", "training_summary",
           "random_search", "resumable_search", "with_folds", "demand_units", "GBT_FIXED", "sample_param_maps", "RF_SPACE", "GBT_SPACE", "ParamGridBuilder"]
