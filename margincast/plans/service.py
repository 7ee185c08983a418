"""The service operations as methods of one state object (the reference
keeps them in process globals behind HTTP routes; routes themselves are not
rebuilt).  Every method returns a DataFrame."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from margincast.operators import dashboard as D
from margincast.operators import pricing as PR
from margincast.operators.cube import weekly_cube_from_sources
from margincast.operators.features import SERVICE_FEATURES, service_features
from margincast.operators.models import demand_model, metrics, mape, training_summary
from margincast.operators.splits import row_split
from margincast.session import reuse
from margincast.sources.tables import SOURCE_FILES, check_sources


class Service:
    def __init__(self, src: dict[str, DataFrame], status: str = "delivered",
                 prefix: str = "fashion_", min_units: int = 10):
        self.src, self.status, self.prefix, self.min_units = src, status, prefix, min_units
        self.model = None
        self.frame = self.split = None

    # -- uploads
    @staticmethod
    def upload_status(spark, directory: str) -> DataFrame:
        return check_sources(spark, directory, list(SOURCE_FILES.values()))

    # -- training
    def train(self, kind: str = "gbt_b", **overrides) -> DataFrame:
        t0 = time.time()
        cube = weekly_cube_from_sources(self.src, self.status, self.prefix)
        self.frame = reuse(service_features(cube, self.min_units))
        self.split = reuse(row_split(self.frame, 0.8))
        train = self.split.where("is_train")
        self.model = demand_model(kind, SERVICE_FEATURES, **overrides).fit(train)
        return training_summary(self.frame, self.split, SERVICE_FEATURES, started=t0)

    def evaluation(self) -> DataFrame:
        test = self.model.transform(self.split.where(~F.col("is_train")))
        m = metrics(test).withColumn("_k", F.lit(1))
        return m.join(mape(test, zero="eps").withColumn("_k", F.lit(1)), "_k").drop("_k")

    def model_status(self) -> DataFrame:
        trained = self.model is not None
        spark = self.src["orders"].sparkSession
        if not trained:
            return spark.createDataFrame([(False, 0, 0, 0)], "trained boolean, train_samples long, "
                                                             "test_samples long, num_features int")
        return self.split.agg(F.lit(True).alias("trained"),
                              F.sum(F.col("is_train").cast("long")).alias("train_samples"),
                              F.sum((~F.col("is_train")).cast("long")).alias("test_samples"),
                              F.lit(len(SERVICE_FEATURES)).alias("num_features"))

    # -- dashboards (over the post-feature frame, as the service reads it)
    def dashboard_metrics(self) -> DataFrame:
        return D.kpis(self.frame)

    def sales_trend(self) -> DataFrame:
        return D.sales_trend(self.frame, 12)

    def top_products(self) -> DataFrame:
        return D.top_products(self.frame, 10)

    def products(self) -> DataFrame:
        return D.product_listing(self.frame)

    def product_analysis(self, product_id) -> DataFrame:
        one = D.for_product(self.frame, product_id)
        return D.product_analysis(one).join(
            D.product_history(one, 12).groupBy("product_id").agg(
                F.sort_array(F.collect_list(F.struct("week", "sales", "price_brl", "price_thb")))
                .alias("sales_history")), "product_id")   # ≤ 12 rows per product

    # -- price optimisation (one product, or every product when product_id is None)
    def optimize(self, product_id=None, cost: float = PR.DEFAULT_COST, price_range: float = 0.3,
                 particles: int = 30, iters: int = 50, seed: int = 42) -> dict[str, DataFrame]:
        frame = self.frame if product_id is None else D.for_product(self.frame, product_id)
        base = PR.base_rows(frame).withColumn("cost", F.lit(float(cost)))
        base = PR.price_bounds(base, "current", price_range=price_range)
        scorer = PR.ModelDemand(self.model, drop=("features_raw", "features"))
        swarm = PR.swarm_search(base, scorer, particles, iters, seed, "a")
        best = swarm.withColumns({"optimal_price": F.col("swarm_price"), "max_profit": F.col("swarm_profit"),
                                  "method": F.lit("swarm"), "grid_demand": F.lit(None).cast("double")})
        curve = PR.score_candidates(PR.price_candidates(base, PR.GRID_POINTS), scorer, "a")
        return {"report": PR.optimization_report(base, best, scorer, "a"),
                "curve": PR.profit_curve(curve)}
