"""Monitoring of predicted against actual revenue.

Forecast and actual 30-day totals are compared in exact cents
(``decimal(18,2)``), so rolling error sums do not depend on summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day_number, to_cents


def predicted_vs_actual(forecast_totals: DataFrame, filled: DataFrame,
                        horizon: int = 30, pred: str = "yhat_total") -> DataFrame:
    """Forecast 30-day totals joined to the actual revenue of the same
    window, ``(cutoff, cutoff + horizon]``.

    ``forecast_totals``: ``series_id, cutoff, <pred>``; ``filled``: a
    calendar-completed daily frame with exact ``revenue``. The actual total
    is a forward RANGE window (W2) read at the day after each cutoff.
    """
    w = (Window.partitionBy("series_id").orderBy(day_number("date"))
         .rangeBetween(0, horizon - 1))
    actual = filled.select("series_id", F.date_sub("date", 1).alias("cutoff"),
                           F.sum("revenue").over(w).alias("actual_total"),
                           F.count("revenue").over(w).alias("actual_days"))
    f = forecast_totals.select("series_id", "cutoff",
                               to_cents(pred).alias("forecast_total"))
    j = f.join(actual, on=["series_id", "cutoff"], how="inner")
    err = F.col("actual_total") - F.col("forecast_total")
    return j.select("series_id", "cutoff", "forecast_total", "actual_total", "actual_days",
                    err.alias("error"),
                    (F.abs(err).cast("double")
                     / F.nullif(F.abs(F.col("actual_total")).cast("double"), F.lit(0.0))).alias("ape"))


def error_monitor(pva: DataFrame, window: int = 4) -> DataFrame:
    """Rolling error over the last ``window`` forecasts of each series
    and a drift ratio (current rolling MAE / previous rolling MAE)."""
    w = Window.partitionBy("series_id").orderBy("cutoff")
    cur = w.rowsBetween(-(window - 1), 0)
    prev = w.rowsBetween(-(2 * window - 1), -window)
    abs_err = F.abs(F.col("error"))
    mae = F.sum(abs_err).over(cur).cast("double") / F.count(abs_err).over(cur)
    mae_prev = F.sum(abs_err).over(prev).cast("double") / F.nullif(F.count(abs_err).over(prev), F.lit(0))
    out = pva.select("*", mae.alias("rolling_mae"), mae_prev.alias("prev_rolling_mae"))
    return out.withColumn("drift_ratio", F.col("rolling_mae") / F.nullif(F.col("prev_rolling_mae"), F.lit(0.0)))


def feature_drift(features: DataFrame, split_date: str, cols) -> DataFrame:
    """M23 (data drift): standardised shift of each feature's mean between
    the rows before and from ``split_date``, per series."""
    after = features.withColumn("_after", F.col("date") >= F.lit(split_date).cast("date"))
    return feature_drift_flag(after, "_after", cols)


def feature_drift_flag(features: DataFrame, flag: str, cols) -> DataFrame:
    """M23 (data drift): per series and feature, ``shift`` = (mean after - mean
    before) / sd before, and ``percentile_shift`` = (median after - median
    before) / interquartile range before, which outliers do not move; ``flag``
    marks the "after" rows. One aggregation."""
    before = ~F.col(flag)
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(F.when(before, x)).alias(f"{c}__m0"), F.avg(F.when(~before, x)).alias(f"{c}__m1"),
                 F.stddev(F.when(before, x)).alias(f"{c}__s0"),
                 F.percentile(F.when(before, x), [0.25, 0.5, 0.75]).alias(f"{c}__q0"),
                 F.percentile(F.when(~before, x), F.lit(0.5)).alias(f"{c}__q1")]
    a = features.groupBy("series_id").agg(*aggs)
    stacked = [F.struct(F.lit(c).alias("feature"),
                        ((F.col(f"{c}__m1") - F.col(f"{c}__m0"))
                         / F.nullif(F.col(f"{c}__s0"), F.lit(0.0))).alias("shift"),
                        ((F.col(f"{c}__q1") - F.col(f"{c}__q0")[1])
                         / F.nullif(F.col(f"{c}__q0")[2] - F.col(f"{c}__q0")[0], F.lit(0.0))).alias("percentile_shift")) for c in cols]
    return a.select("series_id", F.explode(F.array(*stacked)).alias("d")).select("series_id", "d.*")
