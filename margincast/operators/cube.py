"""The weekly product × region cube and friends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from margincast.functions.dates import week_label, week_spine_bounds
from margincast.operators.ordering import dense_codes
from margincast.operators.quantiles import exact_quantile
from margincast.operators.sales import CATEGORY, DIM_COLS
from margincast.session import ensure_checkpoint_dir, partitions_for, small_shuffles

CUBE_KEYS = ["product_id", CATEGORY, "seller_state_encoded", "Date"]
MEASURES = ["QuantitySold", "AverageSellingPrice", "Weight_g_Mean", "Length_cm_Mean",
            "Height_cm_Mean", "Width_cm_Mean"]
_DIM_OUT = dict(zip(DIM_COLS, MEASURES[2:]))
# largest dictionary ranked in one window and broadcast; bigger ones go distributed
SMALL_DICT_MAX = 100_000


def exact_mean(c, scale: int = 4) -> Column:
    """Mean of a money-like column via an exact decimal sum: the result does
    not depend on summation order (same bits on any partitioning)."""
    col = F.col(c) if isinstance(c, str) else c
    dec = col.cast(f"decimal(30,{scale})")
    return F.sum(dec).cast("double") / F.nullif(F.count(col), F.lit(0))


def encode_small(df: DataFrame, col: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """E1 for a dimension with a small, domain-bounded number of values
    (regions, categories): sorted distinct → 0-based code, broadcast back.
    The ranking window runs over the distinct values only.  ``source`` (a
    smaller frame with the same value set) may supply the dictionary."""
    values = (source if source is not None else df).select(col).where(F.col(col).isNotNull()).distinct()
    if values.limit(SMALL_DICT_MAX + 1).count() > SMALL_DICT_MAX:
        # the bound does not hold: distributed dictionary, shuffle join
        return df.join(dense_codes(values, col, out), col, "left")
    codes = values.select(col, (F.dense_rank().over(Window.orderBy(col)) - 1).cast("int").alias(out))
    return df.join(F.broadcast(codes), col, "left")


def encode_large(df: DataFrame, col: str, out: str, partitions: int | None = None) -> DataFrame:
    """E1 for a dimension of any size (products): distributed dictionary
    (range partition + per-partition offsets), joined back on the key."""
    return df.join(dense_codes(df, col, out, partitions), col, "left")


def weekly_cube(lines: DataFrame, materialize: bool = True) -> DataFrame:
    """A1: one row per (product, category, region, week ending Monday).

    Partial aggregation runs map-side, so a product holding a third of all
    lines still shuffles one row per (key, map task).  The region dictionary
    is fitted on the regions present after the family filter (before any
    popularity filter) and applied to the aggregated rows, which are far
    fewer than the lines.

    With ``materialize`` the aggregated rows are written once to the reliable
    checkpoint folder, so the dictionary branch and the main branch do not
    both re-run the joins (and lineage is cut for executor loss).
    """
    # a line without a timestamp has no week: the grouping drops it (as a
    # null grouping key is dropped by the weekly resampling being rebuilt)
    lines = lines.where(F.col("order_purchase_timestamp").isNotNull())
    raw = (lines.groupBy("product_id", CATEGORY, "seller_state",
                         week_label("order_purchase_timestamp").alias("Date"))
           .agg(F.count(F.lit(1)).alias("QuantitySold"),
                exact_mean(F.col("price"), 2).alias("AverageSellingPrice"),
                *[exact_mean(c).alias(o) for c, o in _DIM_OUT.items()]))
    if materialize:
        ensure_checkpoint_dir(raw.sparkSession)
        with small_shuffles(raw.sparkSession):
            raw = raw.checkpoint(eager=True)
    enc = encode_small(raw, "seller_state", "seller_state_encoded")
    return enc.select(*CUBE_KEYS, *MEASURES)


def weekly_cube_from_sources(src: dict[str, DataFrame], status: str = "delivered",
                             prefix: str | None = "fashion_", materialize: bool = True,
                             semi_join_max: int = 5_000_000) -> DataFrame:
    """A1 straight from the five sources, pre-aggregating before the
    product- and seller-keyed joins.

    Product category/measures and seller region are constant per key, so
    the order lines are reduced to one row per (product, seller, week) right
    after the orders join — map-side partial aggregation, one line-level
    shuffle in total (on order_id) — and the product and seller joins and the
    final grouping run on those aggregated rows.  A product holding a third of
    all lines is therefore reduced inside each map task before any shuffle
    keyed by product.  When the family's product ids are provably few
    (``semi_join_max``) they are broadcast to cut non-family lines before the
    orders join.  Sums are exact decimals and counts, so the result equals
    ``weekly_cube(sales_lines(src))`` value for value."""
    from margincast.operators.sales import delivered, products_with_category, with_purchase_ts
    prods = products_with_category(src["products"], src["translation"], prefix).where(
        F.col(CATEGORY).isNotNull()).select("product_id", CATEGORY, *DIM_COLS)
    items = src["order_items"].select("order_id", "product_id", "seller_id", "price")
    if prefix:
        ids = prods.select("product_id")
        if ids.limit(semi_join_max + 1).count() <= semi_join_max:
            items = items.join(F.broadcast(ids), "product_id", "left_semi")
    orders = with_purchase_ts(delivered(src["orders"], status)).select(
        "order_id", "order_purchase_timestamp").where(F.col("order_purchase_timestamp").isNotNull())
    pre = (items.join(orders, "order_id")
           .groupBy("product_id", "seller_id", week_label("order_purchase_timestamp").alias("Date"))
           .agg(F.count(F.lit(1)).alias("_n"),
                F.sum(F.col("price").cast("decimal(30,2)")).alias("_price_sum"),
                F.count("price").alias("_price_n")))
    sellers = src["sellers"].select("seller_id", "seller_state")
    j = (pre.join(prods, "product_id")
         .join(sellers, "seller_id", "left")
         .withColumn("seller_state", F.coalesce("seller_state", F.lit("Unknown"))))
    dim_aggs = []
    for c, o in _DIM_OUT.items():
        dec = F.col(c).cast("decimal(30,4)")
        dim_aggs.append((F.sum(dec * F.col("_n")).cast("double")
                         / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("_n"))), F.lit(0))).alias(o))
    raw = (j.groupBy("product_id", CATEGORY, "seller_state", "Date")
           .agg(F.sum("_n").alias("QuantitySold"),
                (F.sum("_price_sum").cast("double") / F.nullif(F.sum("_price_n"), F.lit(0)))
                .alias("AverageSellingPrice"),
                *dim_aggs))
    if materialize:
        ensure_checkpoint_dir(raw.sparkSession)
        with small_shuffles(raw.sparkSession):
            raw = raw.checkpoint(eager=True)
    enc = encode_small(raw, "seller_state", "seller_state_encoded")
    return enc.select(*CUBE_KEYS, *MEASURES)


def product_totals(cube: DataFrame) -> DataFrame:
    """A2."""
    return cube.groupBy("product_id").agg(F.sum("QuantitySold").alias("total_units"))


def popular(cube: DataFrame, min_units: int = 1) -> DataFrame:
    """A3 (+J5): keep products with at least ``min_units`` units in total.

    Written as a per-product window sum rather than aggregate + semi join:
    every later window is also partitioned by product, so this reuses the
    same shuffle instead of adding one."""
    tot = F.sum("QuantitySold").over(Window.partitionBy("product_id"))
    return cube.withColumn("_tot", tot).where(F.col("_tot") >= min_units).drop("_tot")


def top_n_products(cube: DataFrame, n: int = 500) -> DataFrame:
    """A4: the n products with most units (ties → lower product id)."""
    return (product_totals(cube)
            .orderBy(F.desc("total_units"), F.asc("product_id")).limit(n))


def top_by_units(cube: DataFrame, n: int = 20) -> DataFrame:
    """A5: units per (product, category), top n."""
    return (cube.groupBy("product_id", CATEGORY).agg(F.sum("QuantitySold").alias("total_units"))
            .orderBy(F.desc("total_units"), F.asc("product_id")).limit(n))


def distinct_counts(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """One-row table of distinct counts (approximate sketch at scale)."""
    fn = F.approx_count_distinct if approx else F.countDistinct
    return df.agg(*[fn(c).alias(f"n_{c}") for c in cols])


def distinct_sketches(df: DataFrame, cols: list[str], by: str = "Date", log2_k: int = 12) -> DataFrame:
    """A13 kept up to date: per ``by`` value (a week) one HyperLogLog sketch of
    every column's values.  New weeks add rows; old ones are not read again."""
    plain = {"int", "bigint", "string", "binary"}
    as_key = {c: F.col(c) if t in plain else F.col(c).cast("string") for c, t in df.dtypes}
    return df.groupBy(by).agg(*[F.hll_sketch_agg(as_key[c], F.lit(log2_k)).alias(f"s_{c}") for c in cols])


def merged_distinct(sketches: DataFrame, cols: list[str]) -> DataFrame:
    """The distinct counts over all rows of any set of sketches.  However they
    were grouped before, the union has the same registers; its estimate may differ
    by a few units below the standard error (1.04 / sqrt(2^log2_k))."""
    return sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(f"s_{c}")).alias(f"n_{c}") for c in cols])


def category_counts(lines: DataFrame) -> DataFrame:
    """A14."""
    return (lines.groupBy(CATEGORY).agg(F.count(F.lit(1)).alias("rows"))
            .orderBy(F.desc("rows"), F.asc(CATEGORY)))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows) for a sequence of named stages."""
    out = None
    for i, (name, df) in enumerate(stages.items()):
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(i).alias("step"), F.lit(name).alias("stage"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def date_span(df: DataFrame, col: str = "Date") -> DataFrame:
    """A16."""
    return df.agg(F.min(col).alias("min_date"), F.max(col).alias("max_date"))


def price_stats(df: DataFrame, key: str = "product_id", col: str = "AverageSellingPrice") -> DataFrame:
    """Mean, sample std, min, max per product."""
    return df.groupBy(key).agg(F.avg(col).alias("mean_price"), F.stddev_samp(col).alias("std_price"),
                               F.min(col).alias("min_price"), F.max(col).alias("max_price"))


def fallback_value(df: DataFrame, col: str, how: str = "median") -> float | None:
    """The global fallback used to fill what per-product fills leave.
    ``median`` is the exact, interpolated one, found by narrowing value ranges
    (``quantiles``), so no task holds all prices; one scalar comes back to the driver."""
    if how == "median":
        return exact_quantile(df, col)
    return df.agg(F.avg(col).alias("v")).first()["v"]


def distinct_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """A19."""
    return df.dropDuplicates(cols) if cols else df.distinct()


def min_volume(df: DataFrame, threshold: float = 5, key: str = "product_id",
               col: str = "QuantitySold") -> DataFrame:
    """Keep rows of groups whose total exceeds ``threshold``."""
    tot = F.sum(col).over(Window.partitionBy(key))
    return df.withColumn("_tot", tot).where(F.col("_tot") > threshold).drop("_tot")


def product_week_grid(cube: DataFrame) -> DataFrame:
    """J6 + J8: every (product, category) paired with every week label from the
    global first to last week.  Each product row expands its own week array
    (no cartesian join operator); the size is products × weeks, which is the
    dense grid itself."""
    span = cube.agg(F.min("Date").alias("lo"), F.max("Date").alias("hi")).first()
    prods = cube.select("product_id", CATEGORY).dropDuplicates(["product_id"])
    return prods.select("product_id", CATEGORY,
                        F.explode(week_spine_bounds(F.lit(span["lo"]), F.lit(span["hi"]))).alias("Date"))


def collapse_regions(cube: DataFrame) -> DataFrame:
    """Q24 option: one row per (product, week) — units summed over regions,
    price the unit-weighted mean (the mean over that week's lines), product
    measures carried (constant per product); region code −1 (all regions)."""
    return (cube.groupBy("product_id", CATEGORY, "Date")
            .agg(F.sum("QuantitySold").alias("QuantitySold"),
                 (F.sum(F.col("AverageSellingPrice") * F.col("QuantitySold")) / F.sum("QuantitySold"))
                 .alias("AverageSellingPrice"),
                 *[F.max(m).alias(m) for m in MEASURES[2:]])
            .withColumn("seller_state_encoded", F.lit(-1))
            .select(*CUBE_KEYS, *MEASURES))


def mean_over_weeks(cube: DataFrame, col: str) -> float | None:
    """The mean of ``col`` over the dense grid that ``densify(carry=True)`` makes of
    ``cube``, from the cube alone: a row counts once for itself and once for
    every empty week it is carried into."""
    span = cube.agg(F.min("Date").alias("lo"), F.max("Date").alias("hi")).first()
    w = Window.partitionBy("product_id").orderBy("Date", "seller_state_encoded")
    until = F.coalesce(F.lead("Date").over(w), F.date_add(F.lit(span["hi"]), 7))
    weeks = F.greatest(F.datediff(until, "Date") / 7, F.lit(1))
    before = F.when(F.lag("Date").over(w).isNull(), F.datediff("Date", F.lit(span["lo"])) / 7).otherwise(F.lit(0))
    n = F.when(F.col(col).isNotNull(), F.col("_n"))
    return (cube.withColumn("_n", (weeks + before).cast("long"))
            .agg((F.sum(F.col(col) * n) / F.nullif(F.sum(n), F.lit(0))).alias("v")).first()["v"])


def densify(cube: DataFrame, drop_filled: bool = False, carry: bool = False) -> DataFrame:
    """J7 (+J6, J8): every product over every week from the global first to
    last week; weeks without sales get QuantitySold 0, null measures and
    region code -1 (``drop_filled`` leaves the code null, the variant that
    later loses those rows to a null drop).  A week with several regions
    keeps several rows.

    No grid join: within each product (ordered by week, region) every cube
    row emits itself plus the empty weeks up to the product's next sale (the
    first row also emits the weeks since the global start, the last row those
    up to the global end).  One window on the product partitioning and a
    generator — the lag and rolling windows that follow reuse the same
    partitioning, so the products × weeks frame is never shuffled.

    ``carry`` fills while generating: an empty week takes the price and measures of
    the row that emits it (the product's previous row, or its first one for the
    weeks before).  With the cube's own nulls filled within the product first,
    that is what a forward and backward fill over the grid gives, without a
    window over products × weeks."""
    span = cube.agg(F.min("Date").alias("lo"), F.max("Date").alias("hi"), F.count(F.lit(1)).alias("rows")).first()
    lo, hi = F.lit(span["lo"]), F.lit(span["hi"])
    w = Window.partitionBy("product_id").orderBy("Date", "seller_state_encoded")
    nxt, prv = F.lead("Date").over(w), F.lag("Date").over(w)
    step = F.expr("INTERVAL 7 DAYS")
    none = F.array().cast("array<date>")
    after = F.date_add("Date", 7)
    trailing = (F.when(nxt.isNull() & (after <= hi), F.sequence(after, hi, step))
                .when(nxt.isNotNull() & (after <= F.date_sub(nxt, 7)), F.sequence(after, F.date_sub(nxt, 7), step))
                .otherwise(none))
    before = F.date_sub("Date", 7)
    leading = F.when(prv.isNull() & (lo <= before), F.sequence(lo, before, step)).otherwise(none)
    code = F.lit(None).cast("int") if drop_filled else F.lit(-1)
    held = [(F.col(m) if carry else F.lit(None).cast("double")).alias(m) for m in MEASURES[1:]]

    def empty(d):
        return F.struct(code.alias("seller_state_encoded"), d.alias("Date"),
                        F.lit(0).cast("long").alias("QuantitySold"), *held)

    real = F.struct(F.col("seller_state_encoded"), F.col("Date"),
                    F.col("QuantitySold").cast("long").alias("QuantitySold"),
                    *[F.col(m) for m in MEASURES[1:]])
    # the generator multiplies rows (every product gets every week), so the
    # partition count is sized from the output (products × weeks) instead of
    # being coalesced by AQE from the small cube
    weeks = (span["hi"] - span["lo"]).days // 7 + 1
    products = cube.select("product_id").distinct().count()
    # and, whatever that is capped at, no task sorts more than about half a million cube rows
    n = max(partitions_for(cube.sparkSession, products * weeks, 200_000), -(-span["rows"] // 500_000))
    gaps = cube.repartition(n, "product_id").withColumns({"_lead": leading, "_trail": trailing})
    rows = F.concat(F.transform("_lead", empty), F.array(real), F.transform("_trail", empty))
    out = gaps.select("product_id", CATEGORY, F.explode(rows).alias("_r"))  # generator pass
    return out.select("product_id", CATEGORY, "_r.*").select(*CUBE_KEYS, *MEASURES)
