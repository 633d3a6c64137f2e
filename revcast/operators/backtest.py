"""Rolling-origin evaluation.

Cutoffs are generated per series with ``sequence`` (no driver loop); the
fits for every (series, cutoff) come from one ``fit_forecaster`` call; the
error metrics are one aggregation grouped by horizon.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import to_cents
from . import clean_series as cs
from .forecast import ForecastSpec, baseline_forecasts, fit_forecaster, forecast_horizon

# Default backtest windows (days)
INITIAL_DAYS = 90
HORIZON_DAYS = 30


def cv_cutoffs(series: DataFrame, initial: int = INITIAL_DAYS, horizon: int = HORIZON_DAYS,
               period: int | None = None, value: str = "y") -> DataFrame:
    """M6 cutoffs: counted back from ``last - horizon`` in steps of ``period``
    (default horizon / 2) while ``>= first + initial``.

    ``first``/``last`` are the first/last observed (non-null) days of each
    series. A cutoff is the last training day; its forecast covers
    ``(cutoff, cutoff + horizon]``.
    """
    period = period or max(1, horizon // 2)
    obs = series.where(F.col(value).isNotNull())
    b = obs.groupBy("series_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    top = F.date_sub("last", horizon)
    low = F.date_add("first", initial)
    k = F.floor(F.datediff(top, low) / F.lit(period)).cast("int")
    return (b.where(top >= low)
            .select("series_id", F.explode(F.sequence(F.lit(0), k)).alias("_k"), top.alias("_top"))
            .select("series_id", F.date_sub("_top", F.col("_k") * F.lit(period)).alias("cutoff")))


def masked_training(series: DataFrame, mask: str = "none", value: str = "y") -> DataFrame:
    """Training values under a masking policy (P8 / SD13).

    * ``none``: values as they are;
    * ``whole``: quantiles of the whole series (parity with the studied
      pipeline; looks past the cutoff);
    * ``causal``: each day is judged against the quantiles of the days
      strictly before it (expanding window, sketch-based), so a fit on days
      ≤ c never sees anything after c. The forecaster applies the same rule
      exactly inside its per-series step (``fit_forecaster(mask="causal")``).
    """
    if mask == "none":
        return series
    if mask == "whole":
        return cs.quantile_mask(series, value)
    if mask == "causal":
        x = F.col(value).cast("double")
        w = (Window.partitionBy("series_id").orderBy("date")
             .rowsBetween(Window.unboundedPreceding, -1))
        qs = F.percentile_approx(x, [cs.OUTLIER_MIN, cs.OUTLIER_MAX], 10000).over(w)
        staged = series.withColumn("_q", qs)
        keep = x.between(F.col("_q")[0], F.col("_q")[1]) | F.col("_q").isNull()
        return staged.withColumn(value, F.when(keep, x)).drop("_q")
    raise ValueError(f"unknown mask {mask!r}")


def _train_and_mask(series: DataFrame, mask: str, value: str):
    """Training frame and the mask left for the fitter: the causal mask is
    applied exactly inside the per-series fit; the others as expressions."""
    base = series.select("series_id", "date", value)
    if mask == "causal":
        return base, "causal"
    return masked_training(base, mask, value), "none"


def cross_validation(series: DataFrame, cutoffs: DataFrame | None = None,
                     spec: ForecastSpec = ForecastSpec(), horizon: int = HORIZON_DAYS,
                     initial: int = INITIAL_DAYS, mask: str = "none", value: str = "y") -> DataFrame:
    """M6: ``(series_id, cutoff, ds, y, yhat, yhat_lower, yhat_upper)``.

    ``series`` is a calendar-completed frame ``series_id, date, y``. Truth
    ``y`` is the unmasked value; the model is fitted on the masked values.
    """
    cutoffs = cutoffs if cutoffs is not None else cv_cutoffs(series, initial, horizon, value=value)
    train, fit_mask = _train_and_mask(series, mask, value)
    coefs, layout = fit_forecaster(train, cutoffs, spec, value=value, horizon=horizon, mask=fit_mask)
    fc = forecast_horizon(coefs, layout, horizon)
    truth = series.select("series_id", F.col("date").alias("ds"), F.col(value).cast("double").alias("y"))
    return (fc.join(truth, on=["series_id", "ds"], how="left")
            .select("series_id", "cutoff", "ds", "y", "yhat", "yhat_lower", "yhat_upper",
                    "trend", "weekly", "yearly"))


def sig_round(x, digits: int = 10):
    """Round to ``digits`` significant digits (reporting precision)."""
    e = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - F.lit(digits - 1))
    return F.when((x == 0) | x.isNull(), x).otherwise(F.round(x / e) * e)


def performance_metrics(cv: DataFrame, pred: str = "yhat", by_series: bool = False,
                        digits: int = 10) -> DataFrame:
    """M8: error metrics by horizon (days after the cutoff).

    ``mse, rmse, mae, mape, coverage`` over the rows with a known truth;
    MAPE skips ``y = 0`` (``nullif``) and uses ``|y|``; coverage needs
    ``yhat_lower/upper`` (null otherwise). Rounded to ``digits`` significant
    digits (the reporting precision).
    """
    keys = ["series_id"] if by_series else []
    e = F.col("y") - F.col(pred)
    ape = F.abs(e) / F.nullif(F.abs(F.col("y")), F.lit(0.0))
    has_int = "yhat_lower" in cv.columns and pred == "yhat"
    cov = (F.when(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")), 1.0).otherwise(0.0)
           if has_int else F.lit(None).cast("double"))
    rows = cv.where(F.col("y").isNotNull() & F.col(pred).isNotNull())
    agg = rows.groupBy(*keys, F.datediff("ds", "cutoff").cast("bigint").alias("horizon")).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.avg(ape).alias("mape"),
        F.avg(cov).alias("coverage"), F.count(F.lit(1)).alias("n"))
    r = lambda c: sig_round(c, digits)
    return agg.select(*keys, "horizon", r(F.col("mse")).alias("mse"),
                      r(F.sqrt("mse")).alias("rmse"), r(F.col("mae")).alias("mae"),
                      r(F.col("mape")).alias("mape"), r(F.col("coverage")).alias("coverage"), "n")


def smoothed_metrics(cv: DataFrame, pred: str = "yhat", by_series: bool = False, window: float = 0.1,
                     horizon: int = HORIZON_DAYS, digits: int = 10) -> DataFrame:
    """M8 with smoothing: the metrics of each horizon over the rows of the days
    up to it, ``window`` of the whole horizon wide (one day at least).

    Errors are added up by horizon, then over a RANGE frame, so every row
    counts alike however many a day has. ``n`` are the rows in the frame with a
    truth and a forecast, ``unanswered`` those without. A horizon none of whose
    rows can be scored has null metrics.
    """
    keys = ["series_id"] if by_series else []
    e = F.col("y") - F.col(pred)
    ape = F.abs(e) / F.nullif(F.abs(F.col("y")), F.lit(0.0))
    inside = F.when(e.isNull(), None).when(F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper")), 1.0).otherwise(0.0) \
        if "yhat_lower" in cv.columns and pred == "yhat" else F.lit(None).cast("double")
    sums = cv.groupBy(*keys, F.datediff("ds", "cutoff").cast("bigint").alias("horizon")).agg(
        F.sum(e * e).alias("_s2"), F.sum(F.abs(e)).alias("_s1"), F.sum(ape).alias("_sp"), F.sum(inside).alias("_sc"),
        F.count(e).alias("_n"), F.count(ape).alias("_np"), F.count(inside).alias("_nc"), (F.count(F.lit(1)) - F.count(e)).alias("_u"))
    # one row per horizon (and series): the frame's task is small whatever the backtest holds
    frame = Window.partitionBy(*keys).orderBy("horizon").rangeBetween(-(max(1, round(window * horizon)) - 1), 0)
    over = {c: F.sum(c).over(frame) for c in ("_s2", "_s1", "_sp", "_sc", "_n", "_np", "_nc", "_u")}
    mean = lambda s, n: over[s] / F.nullif(over[n], F.lit(0))
    out = sums.select(*keys, "horizon", mean("_s2", "_n").alias("mse"), mean("_s1", "_n").alias("mae"), mean("_sp", "_np").alias("mape"),
                      mean("_sc", "_nc").alias("coverage"), over["_n"].alias("n"), over["_u"].alias("unanswered"))
    r = lambda c: sig_round(c, digits)
    return out.select(*keys, "horizon", r(F.col("mse")).alias("mse"), r(F.sqrt("mse")).alias("rmse"), r(F.col("mae")).alias("mae"),
                      r(F.col("mape")).alias("mape"), r(F.col("coverage")).alias("coverage"), "n", "unanswered")


def baseline_cv(series: DataFrame, cutoffs: DataFrame | None = None, horizon: int = HORIZON_DAYS,
                initial: int = INITIAL_DAYS, season: int = 7, value: str = "y") -> DataFrame:
    """M18 through the M6 harness: baseline forecasts with the truth joined."""
    cutoffs = cutoffs if cutoffs is not None else cv_cutoffs(series, initial, horizon, value=value)
    fc = baseline_forecasts(series, cutoffs, horizon, season, value)
    truth = series.select("series_id", F.col("date").alias("ds"), F.col(value).cast("double").alias("y"))
    return fc.join(truth, on=["series_id", "ds"], how="left")


def time_series_folds(frame: DataFrame, k: int = 5, order: str = "date") -> DataFrame:
    """M9: expanding-window folds; ``fold`` 0..k-1 in time order per series.

    Train on ``fold < f``, test on ``fold = f``. Fold = contiguous block of
    rows (``ntile`` over the time order of each series).
    """
    w = Window.partitionBy("series_id").orderBy(order)
    return frame.withColumn("fold", (F.ntile(k).over(w) - 1).cast("bigint"))


def masked_vs_raw(series: DataFrame, spec: ForecastSpec = ForecastSpec(),
                  horizon: int = HORIZON_DAYS, initial: int = INITIAL_DAYS,
                  masks=("none", "causal"), value: str = "y") -> DataFrame:
    """Overall MAE/MAPE of the same backtest with and without masking.

    All masks are scored on the same rows: the days that every one of them
    answers (``n``); ``answered`` is each mask's own share of the days with a truth.
    """
    cutoffs = cv_cutoffs(series, initial, horizon, value=value)
    key = ["series_id", "cutoff", "ds"]
    both = None
    for m in masks:
        cv = cross_validation(series, cutoffs, spec, horizon, initial, mask=m, value=value)
        one = cv.where(F.col("y").isNotNull()).select(*key, "y", F.col("yhat"), F.lit(m).alias("mask"))
        both = one if both is None else both.unionByName(one)
    common = F.count("yhat").over(Window.partitionBy(*key)) == F.lit(len(masks))
    e = F.when(F.col("_common"), F.abs(F.col("y") - F.col("yhat")))
    return (both.withColumn("_common", common).groupBy("series_id", "mask")
            .agg(F.avg(e).alias("mae"), F.avg(e / F.nullif(F.abs(F.col("y")), F.lit(0.0))).alias("mape"),
                 F.count(e).alias("n"), (F.count("yhat") / F.count(F.lit(1))).alias("answered")))


def best_method(cv: DataFrame, preds: dict) -> DataFrame:
    """Per series, the candidate forecast with the lowest MAE.

    ``preds`` maps a method name to its prediction column. Errors are taken
    in exact cents (decimal), so the MAE and the ranking do not depend on
    summation order; ties go to the alphabetically first method.
    """
    cands = F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("yhat"))
                      for m, c in preds.items()])
    stacked = cv.select("series_id", "y", F.explode(cands).alias("c")).select("series_id", "y", "c.*")
    err = F.abs(to_cents(F.col("y") - F.col("yhat")))
    agg = (stacked.where(F.col("y").isNotNull() & F.col("yhat").isNotNull())
           .groupBy("series_id", "method")
           .agg((F.sum(err).cast("double") / F.count(F.lit(1))).alias("mae"),
                F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("series_id").orderBy("mae", "method")
    return agg.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def prior_grid(series: DataFrame, scales=(0.01, 0.05, 0.1, 0.15, 0.2),
               spec: ForecastSpec = ForecastSpec(), horizon: int = HORIZON_DAYS,
               initial: int = INITIAL_DAYS, mask: str = "causal", value: str = "y") -> DataFrame:
    """M2 + J8 + A12: backtest MAE/MAPE of every changepoint prior scale per
    series, and the best scale (lowest MAE, ties to the smaller scale).

    All scales are solved from the same sums inside one fit, so the grid
    adds solves, not passes over the data.
    """
    cutoffs = cv_cutoffs(series, initial, horizon, value=value)
    train, fit_mask = _train_and_mask(series, mask, value)
    coefs, layout = fit_forecaster(train, cutoffs, spec, value=value, horizon=horizon,
                                   prior_scales=list(scales), mask=fit_mask)
    fc = forecast_horizon(coefs, layout, horizon)
    truth = series.select("series_id", F.col("date").alias("ds"), F.col(value).cast("double").alias("y"))
    cv = fc.join(truth, on=["series_id", "ds"], how="left")
    e = F.col("y") - F.col("yhat")
    scores = (cv.where(F.col("y").isNotNull() & F.col("yhat").isNotNull())
              .groupBy("series_id", "cps")
              .agg(F.avg(F.abs(e)).alias("mae"),
                   F.avg(F.abs(e) / F.nullif(F.abs(F.col("y")), F.lit(0.0))).alias("mape"),
                   F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("series_id").orderBy("mae", "cps")
    return scores.withColumn("is_best", F.row_number().over(w) == 1)
