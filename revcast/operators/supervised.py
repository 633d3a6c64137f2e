"""Supervised 30-day revenue model with Spark ML.

The pooled model is trained for all series at once: a single distributed fit
whatever the number of series. The series enters by its number in an exact
index (:func:`series_index`), as the number's binary digits, so no two series
share a place and n series take log2(n) columns. The models by series
(:func:`fit_by_series`) are one linear model for each, all solved side by side
from sums that Spark makes in one aggregation. No driver loop over series.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rounded_rmse
from ..session import cut_lineage
from .backtest import time_series_folds
from .features import FEATURE_COLUMNS

# The forest sizes searched, folds, hold-out share and seed
N_TREES_GRID = [10, 15, 20, 25]
N_FOLDS = 5
TEST_SHARE = 0.25
# days that a row's target covers, its own included
TARGET_DAYS = 30
SEED = 42
# ridge of the models by series, per training row, on standardised features
RIDGE = 1e-3


def series_index(features: DataFrame) -> DataFrame:
    """``(series_id, series_no)``: numbers from 1, dense, in the order of the ids;
    kept in the checkpoint folder, so that training and prediction use the same.

    One row per series is all that the numbering sees.
    """
    ids = features.select("series_id").distinct()
    return cut_lineage(ids.select("series_id", F.row_number().over(Window.orderBy("series_id")).alias("series_no")))


def index_digits(index: DataFrame) -> list[str]:
    """Names of the digit columns that tell all series of ``index`` apart (and none, 0)."""
    most = index.agg(F.max("series_no")).first()[0] or 0
    return [f"_series{k}" for k in range(max(1, int(most).bit_length()))]


def with_series_digits(df: DataFrame, index: DataFrame, digits: list[str]) -> DataFrame:
    """``df`` with the binary digits of its series' number; a series that the index does not hold has 0."""
    no = F.coalesce("series_no", F.lit(0))
    return df.join(index, "series_id", "left").select(
        *df.columns, *[F.shiftright(no, k).bitwiseAND(1).cast("double").alias(d) for k, d in enumerate(digits)])


def rf_pipeline(digits: list[str] = (), num_trees: int = 20, seed: int = SEED) -> Pipeline:
    """Assembler + standard scaler + random forest (and the series' digits, as they are)."""
    stages = [VectorAssembler(inputCols=list(FEATURE_COLUMNS), outputCol="_raw"),
              StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True)]
    feats = "_scaled"
    if digits:
        stages.append(VectorAssembler(inputCols=["_scaled", *digits], outputCol="_feat"))
        feats = "_feat"
    rf = RandomForestRegressor(featuresCol=feats, labelCol="target", predictionCol="prediction",
                               numTrees=num_trees, seed=seed)
    stages.append(rf)
    return Pipeline(stages=stages)


class PooledModel:
    """A fitted pipeline with the series index that it was trained with."""

    def __init__(self, model: PipelineModel, index: DataFrame, digits: list[str]):
        self.model, self.index, self.digits = model, index, digits

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(with_series_digits(df, self.index, self.digits))


# Partitions of an ML training frame. A forest draws its samples per
# partition, so the number is fixed: the model depends on the data, not on the
# cores or on how the input was dealt. Record it with a saved model.
ML_PARTITIONS = 16


def ml_ready(df: DataFrame) -> DataFrame:
    """The training frame in ``ML_PARTITIONS`` partitions by (series, day), each in that order."""
    keys = [c for c in ("series_id", "date") if c in df.columns]
    return df.repartition(ML_PARTITIONS, *keys).sortWithinPartitions(*keys)


def fit_pooled(df: DataFrame, num_trees: int = 20, index: DataFrame | None = None) -> PooledModel:
    """One forest over all series, fitted on the fixed partitions of :func:`ml_ready`."""
    index = series_index(df) if index is None else index
    digits = index_digits(index)
    return PooledModel(rf_pipeline(digits, num_trees).fit(ml_ready(with_series_digits(df, index, digits))), index, digits)


def _double(df: DataFrame) -> DataFrame:
    num = set(FEATURE_COLUMNS) | {"target"}
    return df.select(*[F.col(c).cast("double").alias(c) if c in num else F.col(c) for c in df.columns])


def time_split(features: DataFrame, test_share: float = TEST_SHARE) -> tuple[DataFrame, DataFrame]:
    """U4 (time-ordered, the default): last ``test_share`` of each series' rows is the test set.

    The target of a day holds the revenue of ``TARGET_DAYS`` days from it, so
    the training rows end that many days before the first test day: none of
    their targets reaches into the test period.
    """
    w = Window.partitionBy("series_id").orderBy("date")
    tagged = features.withColumn("_test", F.percent_rank().over(w) >= F.lit(1 - test_share))
    first = F.min(F.when(F.col("_test"), F.col("date"))).over(Window.partitionBy("series_id"))
    tagged = tagged.withColumn("_before", F.coalesce(F.col("date") <= F.date_sub(first, TARGET_DAYS), F.lit(True)))
    return (tagged.where(~F.col("_test") & F.col("_before")).drop("_test", "_before"),
            tagged.where(F.col("_test")).drop("_test", "_before"))


def random_split(features: DataFrame, test_share: float = TEST_SHARE,
                 seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """U4 (shuffled, as the studied pipeline): a seeded shuffle of each
    series' days; the first ``round((1 - test_share)·n)`` are the training rows.
    The shuffle is the integer hash of :func:`sample_key`, so the split is
    reproducible on any engine and any partitioning."""
    w = Window.partitionBy("series_id").orderBy(sample_key(F.unix_date(F.col("date")), seed), "date")
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    tagged = (features.withColumn("_rn", F.row_number().over(w)).withColumn("_n", n)
              .withColumn("_train", F.col("_rn") <= F.round(F.col("_n") * F.lit(1.0 - test_share))))
    return (tagged.where(F.col("_train")).drop("_rn", "_n", "_train"),
            tagged.where(~F.col("_train")).drop("_rn", "_n", "_train"))


# Fixed value: Knuth's multiplicative hashing constant (2^32 / golden ratio)
HASH_MULTIPLIER = 2654435761


def sample_key(day: "F.Column", seed: int) -> "F.Column":
    """Seeded pseudo-random order of days: (day·2654435761 + seed) mod 2^32.

    Integer arithmetic only, so every engine orders the rows the same way.
    """
    return (day.cast("bigint") * F.lit(HASH_MULTIPLIER) + F.lit(seed)) % F.lit(2 ** 32)


def exact_sample(df: DataFrame, fraction: float = 0.3, seed: int = SEED,
                 key: str = "date") -> DataFrame:
    """Exactly ``round(fraction · n)`` rows of each series, without
    replacement, chosen by a seeded hash order of the day (deterministic,
    per-series windows, nothing on the driver)."""
    w = Window.partitionBy("series_id").orderBy(sample_key(F.unix_date(F.col(key)), seed), key)
    n = F.count(F.lit(1)).over(Window.partitionBy("series_id"))
    return (df.withColumn("_rn", F.row_number().over(w)).withColumn("_n", n)
            .where(F.col("_rn") <= F.round(F.col("_n") * F.lit(float(fraction))))
            .drop("_rn", "_n"))


def grid_search(train: DataFrame, grid=N_TREES_GRID, folds: int = N_FOLDS, parallelism: int = 4,
                index: DataFrame | None = None):
    """Forest size chosen by k-fold CV on contiguous time blocks (R²,
    unweighted mean over folds), then refit on all training rows."""
    index = series_index(train) if index is None else index
    digits = index_digits(index)
    data = time_series_folds(_double(train), folds).withColumnRenamed("fold", "_fold")
    data = ml_ready(with_series_digits(data, index, digits))
    pipe = rf_pipeline(digits)
    rf = pipe.getStages()[-1]
    params = ParamGridBuilder().addGrid(rf.numTrees, list(grid)).build()
    ev = RegressionEvaluator(labelCol="target", predictionCol="prediction", metricName="r2")
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=params, evaluator=ev,
                        foldCol="_fold", numFolds=folds, parallelism=parallelism, seed=SEED)
    model = cv.fit(data)
    scores = [(int(p[rf.numTrees]), float(m)) for p, m in zip(params, model.avgMetrics)]
    return PooledModel(model.bestModel, index, digits), scores


def train_supervised(features: DataFrame, num_trees: int | None = None,
                     shuffle: bool = False, search: bool = True):
    """M11 + M12: hold-out RMSE on a 75/25 split, then refit on all rows.

    Returns ``(model, holdout_rmse, scores)``; the hold-out RMSE is
    ``round(sqrt(mse))`` (F13). ``num_trees`` skips the grid search.
    """
    f = ml_ready(_double(features))
    index = series_index(f)
    tr, te = random_split(f) if shuffle else time_split(f)
    if num_trees is None and search:
        _, scores = grid_search(tr, index=index)
        best = max(scores, key=lambda s: s[1])[0]
    else:
        best, scores = num_trees or 20, []
    pred = fit_pooled(tr, best, index).transform(te)
    rmse = pred.select(rounded_rmse(F.avg((F.col("target") - F.col("prediction")) ** 2))).first()[0]
    return fit_pooled(f, best, index), rmse, scores


# ---- M13: one model for each series


def fit_by_series(features: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """One linear model for each series: ``(series_id, n, intercept, weights)``.

    The sums and products of the features are one hash aggregation by series
    (partial sums before the shuffle, some forty numbers for a series); the
    small systems are solved in batches of series. Features are centred at their
    own mean and scaled by their own deviation before the ridge counts; a
    feature that does not vary in a series has weight 0, and a series of one row
    is its intercept.
    """
    x = list(FEATURE_COLUMNS)
    rows = _double(features).where("target IS NOT NULL").na.fill(0.0, x)
    # sums around the first mean of each series, so that large amounts do not cancel
    centre = rows.groupBy("series_id").agg(*[F.avg(c).alias(f"_m{k}") for k, c in enumerate([*x, "target"])])
    at = [F.col(c) - F.col(f"_m{k}") for k, c in enumerate([*x, "target"])]
    pairs = [(a, b) for a in range(len(at)) for b in range(a, len(at))]
    sums = rows.join(centre, "series_id").groupBy("series_id", *[f"_m{k}" for k in range(len(at))]).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(at[a] * at[b]).alias(f"_s{a}_{b}") for a, b in pairs])

    def solve(batches):
        import numpy as np
        import pandas as pd
        for part in batches:
            p = len(x)
            gram = np.zeros((len(part), p + 1, p + 1))
            for a, b in pairs:
                gram[:, a, b] = gram[:, b, a] = part[f"_s{a}_{b}"]
            mean = part[[f"_m{k}" for k in range(p + 1)]].to_numpy()
            n = part["n"].to_numpy(float)
            scale = np.sqrt(np.einsum("rii->ri", gram)[:, :p] / n[:, None])
            flat = scale <= 1e-9 * (np.abs(mean[:, :p]) + 1)
            scale[flat] = 1.0
            system = gram[:, :p, :p] / (scale[:, :, None] * scale[:, None, :]) + (n * ridge)[:, None, None] * np.eye(p)
            right = gram[:, :p, p] / scale
            dead = np.where(flat, 0.0, 1.0)
            system = system * dead[:, :, None] * dead[:, None, :] + np.eye(p) * flat[:, None, :]
            w = np.linalg.solve(system, (right * dead)[:, :, None])[:, :, 0] / scale
            yield pd.DataFrame({"series_id": part["series_id"], "n": part["n"],
                                "intercept": mean[:, p] - (w * mean[:, :p]).sum(1), "weights": list(w)})

    return sums.mapInPandas(solve, "series_id string, n bigint, intercept double, weights array<double>")


def predict_by_series(models: DataFrame, features: DataFrame) -> DataFrame:
    """``features`` with ``prediction`` by the model of their own series (null: it has none)."""
    f = _double(features)
    value = F.col("intercept")
    for k, c in enumerate(FEATURE_COLUMNS):
        value = value + F.coalesce(F.col(c), F.lit(0.0)) * F.col("weights")[k]
    return f.join(models.select("series_id", "intercept", "weights"), "series_id", "left").select(*f.columns, value.alias("prediction"))


def holdout_by_series(features: DataFrame, ridge: float = RIDGE) -> DataFrame:
    """M12 + M13: per series, rows and RMSE of its own model on the last quarter of its
    days, fitted on those before, and the RMSE of the training mean beside it."""
    train, test = time_split(_double(features))
    mean = train.groupBy("series_id").agg(F.avg("target").alias("_mean"))
    scored = predict_by_series(fit_by_series(train, ridge), test).join(mean, "series_id", "left")
    rmse = lambda p: rounded_rmse(F.avg((F.col("target") - F.col(p)) ** 2))
    return scored.groupBy("series_id").agg(rmse("prediction").alias("rmse"), rmse("_mean").alias("rmse_mean"), F.count("prediction").alias("n_test"))


def save_model(model: PooledModel, path: str) -> None:
    """Persist a fitted pipeline (Spark ML format, overwrite) with its series index."""
    model.model.write().overwrite().save(f"{path}/pipeline")
    model.index.write.mode("overwrite").parquet(f"{path}/series")


def load_model(spark, path: str) -> PooledModel:
    """Load a persisted pipeline."""
    index = spark.read.parquet(f"{path}/series")
    return PooledModel(PipelineModel.load(f"{path}/pipeline"), index, index_digits(index))


def predict_supervised(model: PooledModel, features: DataFrame) -> DataFrame:
    """Predictions for feature rows (e.g. the untrimmed feature table)."""
    out = model.transform(_double(features))
    return out.select("series_id", "date", "target", F.col("prediction").alias("y_pred"),
                      F.lit(None).cast("double").alias("y_proba"))
