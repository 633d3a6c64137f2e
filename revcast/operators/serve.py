"""Answering requests from a forecast table.

A request is ``(country, year, month, day)`` strings. Requests are a
table, validated with expressions and answered with joins: nothing is
looped over on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import ALL_SERIES, date_from_parts, hms_duration, slug, version_tag

REQUEST_SCHEMA = T.StructType([
    T.StructField("country", T.StringType()), T.StructField("year", T.StringType()),
    T.StructField("month", T.StringType()), T.StructField("day", T.StringType()),
])


def validate_requests(requests: DataFrame, forecasts: DataFrame,
                      date_col: str = "date") -> DataFrame:
    """P13 + J5: status of every request.

    ``bad_date`` (parts not numeric or not a calendar date), ``unknown_series``
    (no forecast for that series), ``out_of_range`` (date outside the series'
    forecast dates), else ``ok``. Series bounds come from one aggregation of
    the forecast table (one row per series) joined on ``series_id``.
    """
    r = requests.select(
        "*",
        F.when(F.lower(F.col("country")) == ALL_SERIES, F.lit(ALL_SERIES))
        .otherwise(slug("country")).alias("series_id"),
        F.when(F.col("year").rlike(r"^\d{4}$") & F.col("month").rlike(r"^\d{1,2}$")
               & F.col("day").rlike(r"^\d{1,2}$"),
               date_from_parts("year", "month", "day")).alias("target_date"))
    bounds = forecasts.groupBy("series_id").agg(F.min(date_col).alias("_lo"),
                                                F.max(date_col).alias("_hi"))
    j = r.join(bounds, on="series_id", how="left")
    status = (F.when(F.col("target_date").isNull(), F.lit("bad_date"))
              .when(F.col("_lo").isNull(), F.lit("unknown_series"))
              .when(~F.col("target_date").between(F.col("_lo"), F.col("_hi")), F.lit("out_of_range"))
              .otherwise(F.lit("ok")))
    return j.select(*requests.columns, "series_id", "target_date", status.alias("status"))


def lookup_requests(requests: DataFrame, forecasts: DataFrame, value: str = "yhat_30d",
                    date_col: str = "date") -> DataFrame:
    """J6 + M21: validated requests answered by an equi-join on
    ``(series_id, target_date)`` against a materialised forecast table."""
    v = validate_requests(requests, forecasts, date_col)
    f = forecasts.select("series_id", F.col(date_col).alias("target_date"), F.col(value).alias(value))
    return v.join(f, on=["series_id", "target_date"], how="left").select(
        *v.columns, F.when(F.col("status") == "ok", F.col(value)).alias(value))


def asof_lookup(requests: DataFrame, issued: DataFrame, value: str = "yhat_30d",
                issued_col: str = "cutoff") -> DataFrame:
    """For each (series_id, target_date) request, the latest forecast
    issued on or before the target date (``max cutoff <= target_date``).

    Requests and issued forecasts are merged into one frame per series and
    a running ``last(ignorenulls)`` carries the latest issued value forward:
    one sort per series, no range join, no pairs.
    """
    req = requests.select("series_id", F.col("target_date").alias("_t"),
                          F.lit(1).alias("_req"), F.lit(None).cast("date").alias("_cut"),
                          F.lit(None).cast("double").alias("_v"))
    iss = issued.select("series_id", F.col(issued_col).alias("_t"), F.lit(0).alias("_req"),
                        F.col(issued_col).alias("_cut"), F.col(value).cast("double").alias("_v"))
    w = (Window.partitionBy("series_id").orderBy("_t", "_req")
         .rowsBetween(Window.unboundedPreceding, 0))
    m = req.unionByName(iss).select(
        "series_id", "_t", "_req",
        F.last(F.when(F.col("_req") == 0, F.struct("_cut", "_v")), ignorenulls=True).over(w).alias("_s"))
    return (m.where(F.col("_req") == 1)
            .select("series_id", F.col("_t").alias("target_date"),
                    F.col("_s._cut").alias(issued_col), F.col("_s._v").alias(value)))


def weekly_cutoffs(series: DataFrame, weekday: int = 2, value: str = "y") -> DataFrame:
    """Retraining cutoffs, one per week of each series' calendar
    (``dayofweek == weekday``, 1 = Sunday), whether or not that day has a value."""
    first_last = series.where(F.col(value).isNotNull()).groupBy("series_id").agg(
        F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    days = first_last.select("series_id", F.explode(F.sequence("_lo", "_hi")).alias("cutoff"))
    return days.where(F.dayofweek("cutoff") == weekday)


# ---------------------------------------------------------------- models by series

def save_models(coefs: DataFrame, path: str, layout, version: str, is_test: bool = False) -> None:
    """The fitted models, one folder for each series below ``prefix=sl`` or,
    for models of a test run, ``prefix=test`` (production models are left alone).

    The number of trend hinges is kept with each model, so it can be read
    without the data it was trained on.
    """
    tag = "test" if is_test else "sl"
    (coefs.withColumn("hinges", F.lit(layout.hinges)).withColumn("model_version", F.lit(version))
     .withColumn("model_name", model_name(tag, "series_id", version))
     .write.mode("overwrite").partitionBy("series_id").parquet(f"{path}/prefix={tag}"))


def load_models(spark, path: str, series: str | None = None, is_test: bool = False) -> DataFrame:
    """The saved models of one series or of all; only that series' folder is read.
    An unknown series raises, as an unknown request does (J5)."""
    from .daily import UnknownSeriesError
    from .forecast import COEF_SCHEMA
    schema = T.StructType(COEF_SCHEMA.fields + [T.StructField("hinges", T.IntegerType()),
                                                T.StructField("model_version", T.StringType()),
                                                T.StructField("model_name", T.StringType())])
    models = spark.read.schema(schema).parquet(f"{path}/prefix={'test' if is_test else 'sl'}")
    if series is None:
        return models
    models = models.where(F.col("series_id") == series)
    if models.isEmpty():
        raise UnknownSeriesError(f"no model of series {series!r}")
    return models


def predict_requests(models: DataFrame, requests: DataFrame, spec, horizon: int = 30) -> DataFrame:
    """M14 + J5: every request answered by the latest model of its own series that
    was trained before the requested day, as the total of the ``horizon`` days from it.

    The forecast starts at the requested day, whatever the model's cutoff;
    ``status`` tells requests that no model can answer.
    """
    from .forecast import Layout, forecast_horizon, thirty_day_total
    r = requests.select(
        *REQUEST_SCHEMA.names,
        F.when(F.lower("country") == ALL_SERIES, F.lit(ALL_SERIES)).otherwise(slug("country")).alias("series_id"),
        date_from_parts("year", "month", "day").alias("target_date"))
    known = models.groupBy("series_id").agg(F.min("cutoff").alias("_first"))
    latest = (r.join(models, on="series_id").where(F.col("cutoff") < F.col("target_date"))
              .groupBy("series_id", "target_date").agg(F.max_by(F.struct(*[models[c] for c in models.columns if c != "series_id"]), "cutoff").alias("m")))
    hinges = models.agg(F.max("hinges")).first()[0]
    # the horizon is counted from the day before the requested one
    ready = latest.select("series_id", "m.*", "target_date").withColumn("cutoff", F.date_sub("target_date", 1)).drop("target_date")
    totals = thirty_day_total(forecast_horizon(ready, Layout(spec, int(hinges or 0)), horizon), horizon)
    out = (r.join(known, on="series_id", how="left")
           .join(totals.withColumn("target_date", F.date_add("cutoff", 1)).drop("cutoff"), on=["series_id", "target_date"], how="left"))
    status = (F.when(F.col("target_date").isNull(), "bad_date").when(F.col("_first").isNull(), "unknown_series")
              .when(F.col("target_date") <= F.col("_first"), "out_of_range")
              .when(F.col("yhat_total").isNull(), "too_few_rows").otherwise("ok"))
    return out.select(*REQUEST_SCHEMA.names, "series_id", "target_date", status.alias("status"),
                      "yhat_total", "yhat_lower_total", "yhat_upper_total")


# ---------------------------------------------------------------- logs

TRAIN_LOG_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("first_date", T.DateType()),
    T.StructField("last_date", T.DateType()), T.StructField("rmse", T.DoubleType()),
    T.StructField("runtime_s", T.DoubleType()), T.StructField("model_version", T.StringType()),
    T.StructField("note", T.StringType()), T.StructField("is_test", T.BooleanType()),
])

PREDICT_LOG_SCHEMA = T.StructType([
    T.StructField("series_id", T.StringType()), T.StructField("y_pred", T.DoubleType()),
    T.StructField("y_proba", T.DoubleType()), T.StructField("target_date", T.DateType()),
    T.StructField("runtime_s", T.DoubleType()), T.StructField("model_version", T.StringType()),
    T.StructField("is_test", T.BooleanType()),
])


def append_log(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append records to a Parquet log table (partitioned by test flag)."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]) \
        .write.mode("append").partitionBy("is_test").parquet(path)


def read_log(spark, path: str) -> DataFrame:
    """A log table with its runtime also as ``HHH:MM:SS``."""
    df = spark.read.parquet(path)
    return df.withColumn("runtime", hms_duration("runtime_s"))


def model_name(prefix: str, tag_col: str, version) -> "F.Column":
    """``<prefix>-<tag>-<version with '.' → '_'>`` model names."""
    return F.concat_ws("-", F.lit(prefix), F.col(tag_col), version_tag(F.lit(str(version))))
