"""Revenue model: training frame, gradient-boosted trees, evaluation, scoring, rule of thumb."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, GroupedData, functions as F

from backline.functions.rounding import cents_mean, clamp, half_even, half_up
from backline.operators import demand, money, pricing, series as ts
from backline.session import checkpoint_dir, cut_lineage

# --- fixed values ---------------------------------------------------------------------------
CATEGORICAL = ["season", "city", "country", "artist_tier"]
NUMERIC = ["venue_capacity", "avg_ticket_price", "price_range", "max_revenue_naive", "is_weekend", "month", "demand_score", "best_rog_30d", "cross_platform_score"]
SETTINGS = (300, 5, 5)  # trees, depth, rows per leaf
# the option by_size: rows below, and the settings there
SIZES = [(30, (100, 3, 2)), (100, (200, 4, 3))]
# folds of a cross validation that are fitted at a time, each with its binned rows in memory or on disk
FOLDS_AT_ONCE = 3
# the days of a made history that ``artist_summary`` reads: the newest (also its peak), the last ones 7 and 30 days older, the
# first of the last 14; none is 90 days older, and four rows pass every least number of points
SUMMARY_DAYS = [1, 8, 15, 31]
RULE_IMPORTANCE = {"venue_capacity": 0.30, "avg_ticket_price": 0.25, "demand_score": 0.25, "artist_tier": 0.10, "seasonality": 0.10}


def artist_summary(metrics: DataFrame) -> DataFrame:
    """One row per artist: tier, social velocity, best 30-day growth, cross-platform score."""
    s = ts.primary_metric(metrics)
    growth = ts.growth_windows(s)
    return (
        demand.artist_tier(metrics).join(ts.social_velocity(s), "artist_id", "left").join(ts.best_growth(growth), "artist_id", "left")
        .join(ts.cross_platform_score(growth), "artist_id", "left")
        .fillna({"social_velocity": 0.0, "best_rog_30d": 0.0, "cross_platform_score": 50.0})
    )


def training_metrics(metrics: DataFrame, artists: DataFrame, as_of: str, days: list[int] | None = None) -> DataFrame:
    """Metrics of artists with seven rows or more; the others get a history made from their snapshot (all or some ``days`` of it)."""
    enough = metrics.groupBy("artist_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 7").select("artist_id")
    real = metrics.join(enough, "artist_id", "left_semi")
    cols = ["artist_id", "spotify_listeners", "youtube_subscribers", "instagram_followers", "facebook_followers", "twitter_followers"]
    made = ts.synthesize_metrics(artists.where("active").select(*cols).join(enough, "artist_id", "left_anti"), as_of, "training", days)
    names = ["artist_id", "platform", "date", "followers", "streams", "views", "likes", "comments", "shares"]
    return real.select(*names).unionByName(made.select(*names))


def price_range(concerts: DataFrame) -> DataFrame:
    """Lowest and highest ticket price of a concert, from stored tiers or the mean."""
    avg = F.coalesce(F.col("avg_ticket_price").cast("double"), F.lit(0.0))
    nz = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.col(c).cast("double"))
    low = F.coalesce(nz("price_tier3"), F.when(avg > 0, avg * 0.5).otherwise(F.lit(500.0)))
    high = F.coalesce(nz("price_vip"), F.when(avg > 0, avg * 2.0).otherwise(F.lit(2000.0)))
    df = concerts.withColumn("ticket_price_min", F.when(low <= 0, F.lit(500.0)).otherwise(low))
    return df.withColumn("ticket_price_max", F.when(high <= F.col("ticket_price_min"), F.col("ticket_price_min") * 3.0).otherwise(high))


def training_frame(concerts: DataFrame, metrics: DataFrame, artists: DataFrame, as_of: str, cross_score: str = "growth") -> DataFrame:
    """Features and label of every concert with revenue and capacity.

    The snapshot history keeps its shape whatever its end date, so one summary per artist serves
    all concerts.  ``cross_score='velocity'`` keeps the older training-only definition.
    """
    rows = price_range(concerts.where("total_revenue > 0 and capacity > 0")).withColumnsRenamed({"demand_score": "stored_demand", "capacity": "venue_capacity"})
    # the history is put together once and read by each part of the summary; of a made one, a formula of the day, only the
    # days that the summary reads are written out
    history = cut_lineage(training_metrics(metrics, artists, as_of, SUMMARY_DAYS))
    df = demand.concert_features(rows.drop("avg_ticket_price")).join(artist_summary(history), "artist_id")
    stored = F.col("stored_demand")
    df = df.withColumn("demand_score", F.when(stored > 0, stored.cast("double")).otherwise(clamp(F.col("social_velocity") * 100.0, 5, 95)))
    if cross_score == "velocity":
        df = df.withColumn("cross_platform_score", clamp(F.col("social_velocity") * 110.0, 0, 100))
    return df.select("concert_id", "artist_id", *[F.col(c).cast("double").alias(c) for c in NUMERIC], *CATEGORICAL, F.col("total_revenue").cast("double").alias("actual_revenue"))


def build_stages(trees: int, depth: int, leaf: int) -> Pipeline:
    """Standardised numbers, one-hot categories (unknown ones ignored), boosted trees."""
    index = StringIndexer(inputCols=CATEGORICAL, outputCols=[f"{c}_i" for c in CATEGORICAL], handleInvalid="keep", stringOrderType="alphabetAsc")
    onehot = OneHotEncoder(inputCols=[f"{c}_i" for c in CATEGORICAL], outputCols=[f"{c}_v" for c in CATEGORICAL], handleInvalid="keep")
    numbers = VectorAssembler(inputCols=NUMERIC, outputCol="numbers_raw")
    scale = StandardScaler(inputCol="numbers_raw", outputCol="numbers", withMean=True, withStd=True)
    join = VectorAssembler(inputCols=["numbers", *[f"{c}_v" for c in CATEGORICAL]], outputCol="features")
    gbt = GBTRegressor(labelCol="actual_revenue", featuresCol="features", maxIter=trees, maxDepth=depth, minInstancesPerNode=leaf, stepSize=0.05, subsamplingRate=0.8, seed=42)
    return Pipeline(stages=[index, onehot, numbers, scale, join, gbt])


def split_frame(frame: DataFrame, test_share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train and test by a hash of the concert, the same whatever the partitioning."""
    slot = F.pmod(F.xxhash64(F.col("concert_id"), F.lit(42)), F.lit(1000))
    return frame.where(slot >= int(test_share * 1000)), frame.where(slot < int(test_share * 1000))


def by_size(rows: int) -> tuple[int, int, int]:
    """Settings for small training sets."""
    return next((settings for below, settings in SIZES if rows < below), SETTINGS)


def train_revenue(frame: DataFrame, trees: int = SETTINGS[0], depth: int = SETTINGS[1], leaf: int = SETTINGS[2]) -> PipelineModel:
    """Fit the boosted trees; their lineage is cut in the checkpoint folder."""
    checkpoint_dir(frame.sparkSession)
    return build_stages(trees, depth, leaf).fit(frame)


def _rated(rows: DataFrame | GroupedData, label: str, pred: str) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(pred).cast("double")
    a = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.abs(y - p)).alias("mae"), F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(2.220446049250313e-16))).alias("ape"),
        F.sum((y - p) * (y - p)).alias("sse"), F.var_pop(y).alias("var"),
    )
    r2 = F.lit(1.0) - F.col("sse") / F.when(F.col("var") > 0, F.col("var") * F.col("rows"))
    return a.withColumns({"r2": r2, "mape": F.col("ape") * 100.0, "label_std": F.sqrt("var")})


def evaluate(preds: DataFrame, label: str = "actual_revenue", pred: str = "prediction") -> DataFrame:
    """One row: mean absolute error, R2, MAPE and the deviation of the label, in one pass."""
    return _rated(preds, label, pred).select("rows", "mae", "r2", "mape", "label_std")


def out_of_fold(frame: DataFrame, folds: int = 5, trees: int = SETTINGS[0], depth: int = SETTINGS[1], leaf: int = SETTINGS[2]) -> DataFrame:
    """The frame with ``fold`` (a hash of the concert) and the prediction of the model that did not see the fold.

    The trees of a model follow one another in many short stages, so ``FOLDS_AT_ONCE`` folds are fitted side by side.
    """
    rows = cut_lineage(frame.withColumn("fold", F.pmod(F.xxhash64(F.col("concert_id"), F.lit(7)), F.lit(folds)).cast("int")))

    def fitted(k: int) -> DataFrame:
        rest, own = rows.where(F.col("fold") != k), rows.where(F.col("fold") == k)
        if rest.isEmpty() or own.isEmpty():
            return own.withColumn("prediction", F.lit(None).cast("double"))
        return train_revenue(rest, trees, depth, leaf).transform(own).select(*rows.columns, "prediction")

    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        parts = [*pool.map(inheritable_thread_target(frame.sparkSession)(fitted), range(folds))]
    return reduce(DataFrame.unionByName, parts)


def cross_validate(frame: DataFrame, folds: int = 5, trees: int = SETTINGS[0], depth: int = SETTINGS[1], leaf: int = SETTINGS[2]) -> DataFrame:
    """Evaluation of the out-of-fold predictions, one row per fold and one over all rows (fold null), in one aggregation."""
    return evaluate_folds(out_of_fold(frame, folds, trees, depth, leaf))


def evaluate_folds(preds: DataFrame, label: str = "actual_revenue", pred: str = "prediction") -> DataFrame:
    """``evaluate`` per fold and over all rows; rows without a prediction count in neither."""
    known = preds.where(F.col(pred).isNotNull() & F.col(label).isNotNull())
    return _rated(known.rollup("fold"), label, pred).select("fold", "rows", "mae", "r2", "mape", "label_std")


def importances(model: PipelineModel, top: int = 10) -> list[tuple[str, float]]:
    labels = [f"{c}={v}" for c, vs in zip(CATEGORICAL, model.stages[0].labelsArray) for v in [*vs, "other"]]
    names = NUMERIC + labels
    values = model.stages[-1].featureImportances.toArray()
    total = values.sum() or 1.0
    return sorted(((n, round(float(x / total), 4)) for n, x in zip(names, values)), key=lambda t: -t[1])[:top]


def heuristic(df: DataFrame) -> Column:
    cap = F.col("venue_capacity")
    return cap * F.col("avg_ticket_price") * pricing.share_sold(F.col("demand_score"), cap)


def _confidence(low: Column, high: Column, mid: Column) -> Column:
    width = (high - low) / F.when(mid != 0, mid)
    return F.when(mid == 0, F.lit(0.5)).otherwise(half_even(clamp(F.lit(1.0) - width / 2.0, 0.1, 0.95), 3))


def _report(df: DataFrame) -> DataFrame:
    """Local and USD amounts from raw ``mid``, ``low``, ``high``."""
    code = F.col("currency")
    df = df.withColumn("currency", money.currency_of(F.col("country"))).withColumn("confidence", _confidence(F.col("low"), F.col("high"), F.col("mid")))
    local = {n: half_even(F.greatest(F.lit(0.0), F.col(c)), 2) for n, c in (("predicted_revenue", "mid"), ("lower_bound", "low"), ("upper_bound", "high"))}
    df = df.withColumns(local)
    return df.withColumns({f"{n}_usd": money.local_to_usd(F.col(n), code) for n in local}).withColumn("exchange_rate", money.usd_rate(code)).drop("mid", "low", "high")


def heuristic_revenue(frame: DataFrame) -> DataFrame:
    """Rule of thumb with bounds of 30 % either way."""
    df = frame.withColumn("mid", heuristic(frame))
    return _report(df.withColumn("low", F.col("mid") * 0.70).withColumn("high", F.col("mid") * 1.30))


def leaf_values(model: PipelineModel, spark) -> list[list[float]]:
    """Weighted value of every leaf, per tree, in leaf order; bounded by trees x 2^depth."""
    gbt = model.stages[-1]
    path = f"{checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    gbt.write().save(path)
    rows = spark.read.parquet(f"{path}/data").where("nodeData.leftChild = -1").select("treeID", "nodeData.id", "nodeData.prediction").collect()
    out: list[list[float]] = [[] for _ in gbt.treeWeights]
    for r in sorted(rows, key=lambda r: (r.treeID, r.id)):
        out[r.treeID].append(float(r.prediction) * gbt.treeWeights[r.treeID])
    return out


def _staged_bounds(values: list[list[float]]):
    """Vectorised: the prediction after each stage from the leaf of every tree, its 10th and 90th percentile and its last value."""
    width = max(map(len, values))
    table = np.array([[*v, *[0.0] * (width - len(v))] for v in values])

    @F.pandas_udf("low double, high double, last double")
    def bounds(leaves: pd.Series) -> pd.DataFrame:
        taken = np.array(leaves.tolist(), np.int64)
        if not len(taken):
            return pd.DataFrame({"low": [], "high": [], "last": []}, dtype=float)
        stages = np.cumsum(table[np.arange(len(table)), taken], axis=1)
        low, high = np.percentile(stages, [10, 90], axis=1)
        return pd.DataFrame({"low": low, "high": high, "last": stages[:, -1]})

    return bounds


def score_concerts(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """Blend of model (55 %) and rule of thumb (45 %) with bounds from the staged predictions.

    Each tree's leaf gives the prediction after that stage; the 10th and 90th percentile of those
    are the bounds, widened when they do not enclose the blend.
    """
    staged = model.copy()
    staged.stages[-1].setLeafCol("leaf")
    bounds = _staged_bounds(leaf_values(model, frame.sparkSession))
    df = staged.transform(frame).withColumn("b", bounds(vector_to_array("leaf"))).withColumn("rule", heuristic(frame))
    mix = lambda c: c * 0.55 + F.col("rule") * 0.45
    df = df.withColumns({"mid": mix(F.col("prediction")), "low": mix(F.col("b.low")), "high": mix(F.col("b.high")), "last_stage": F.col("b.last")})
    off = (F.col("low") > F.col("mid")) | (F.col("high") < F.col("mid")) | (F.col("low") == F.col("high"))
    spread = F.greatest(F.abs(F.col("mid") - F.col("low")), F.abs(F.col("high") - F.col("mid")), F.col("mid") * 0.2, F.lit(1.0))
    df = df.withColumn("spread", F.when(off, spread))
    df = df.withColumn("low", F.coalesce(F.col("mid") - F.col("spread"), "low")).withColumn("high", F.coalesce(F.col("mid") + F.col("spread"), "high"))
    return _report(df.select(*frame.columns, "prediction", "last_stage", "mid", "low", "high"))


def revenue_inputs(concerts: DataFrame, as_of: str) -> DataFrame:
    """Serving inputs for every (artist, city): mean capacity and price, price range, date."""
    pos = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    g = concerts.groupBy("artist_id", F.lower("city").alias("k")).agg(
        F.min("city").alias("city"), F.min("country").alias("country"), cents_mean(pos("capacity")).alias("cap"), cents_mean(pos("avg_ticket_price")).alias("price"),
        cents_mean(pos("price_tier3")).alias("low"), cents_mean(pos("price_vip")).alias("high"))
    avg = F.coalesce("price", F.lit(1250.0))
    derived = pricing.tiers_from_avg(avg)
    return g.select(
        "artist_id", "city", "country", F.greatest(F.lit(100.0), half_up(F.coalesce("cap", F.lit(5000.0)))).cast("long").alias("venue_capacity"), half_up(avg, 4).alias("avg_ticket_price"),
        half_up(F.coalesce("low", derived["price_min"]), 4).alias("ticket_price_min"), half_up(F.coalesce("high", derived["price_max"]), 4).alias("ticket_price_max"),
        F.date_add(F.lit(as_of).cast("date"), 30).alias("concert_date"),
    )


def retrain_if_ready(frame: DataFrame, path: str, least: int = 10, settings: tuple[int, int, int] = SETTINGS) -> PipelineModel | None:
    """Train and save when there are at least ``least`` rows (a documented gate); None otherwise."""
    n = frame.count()
    if n < least:
        return None
    model = train_revenue(frame, *settings)
    model.write().overwrite().save(path)
    return model


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
