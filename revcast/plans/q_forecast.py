"""Queries: forecasting, backtests, serving and monitoring (steps 7, 8, 11, 12)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import rounded_rmse
from ..operators import backtest as bt
from ..operators import forecast as fc
from ..operators import monitor as mon
from ..operators import serve as sv
from ..session import cut_lineage, ensure_checkpoint_dir
from . import sql_fragments as q
from .q_series import daily, filled
from .registry import query


def series_y(spark, sf, checkpoint: bool = False):
    """Gap-null daily revenue of every series as ``(series_id, date, y)``.

    ``checkpoint=True`` materialises it once (series x days, small) in the
    shared checkpoint directory, so a query that uses it in several branches
    scans the invoice lines once."""
    s = filled(spark, sf, "null").select("series_id", "date",
                                         F.col("revenue").cast("double").alias("y"))
    return cut_lineage(s) if checkpoint else s


# ------------------------------------------------------------------ SQL pieces

S_Y = """
s AS (SELECT series_id, "date", CAST(revenue AS DOUBLE) AS y FROM filled)"""

CUTS = """
cb AS (SELECT series_id, min("date") FILTER (WHERE y IS NOT NULL) AS first_d,
              max("date") FILTER (WHERE y IS NOT NULL) AS last_d FROM s GROUP BY series_id),
cuts AS (
  SELECT series_id, CAST(last_d - CAST(30 + 15 * k AS INTEGER) AS DATE) AS cutoff
  FROM (SELECT series_id, first_d, last_d,
               unnest(generate_series(0, CAST(floor(datediff('day', first_d + 90, last_d - 30) / 15) AS BIGINT))) AS k
        FROM cb WHERE last_d - 30 >= first_d + 90) t
)"""

FIRSTS = """
fs AS (SELECT series_id, arg_min(y, "date") FILTER (WHERE y IS NOT NULL) AS y_first,
              min("date") FILTER (WHERE y IS NOT NULL) AS d_first FROM s GROUP BY series_id)"""

BASELINES = FIRSTS + """,
ls AS (SELECT series_id, "date",
              last_value(y IGNORE NULLS) OVER w AS y_last,
              last_value(CASE WHEN y IS NOT NULL THEN "date" END IGNORE NULLS) OVER w AS d_last
       FROM s WINDOW w AS (PARTITION BY series_id ORDER BY "date"
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ends AS (SELECT c.series_id, c.cutoff, fs.y_first, fs.d_first, ls.y_last, ls.d_last
         FROM cuts c JOIN fs ON fs.series_id = c.series_id
         JOIN ls ON ls.series_id = c.series_id AND ls."date" = c.cutoff),
fut AS (SELECT e.*, g.h, CAST(e.cutoff + CAST(g.h AS INTEGER) AS DATE) AS ds,
               CAST(e.cutoff + CAST(g.h - 7 * CAST(ceil(g.h / 7) AS INTEGER) AS INTEGER) AS DATE) AS sd
        FROM ends e, generate_series(1, 30) g(h)),
base AS (
  SELECT f.series_id, f.cutoff, f.ds, CAST(f.h AS BIGINT) AS h,
         f.y_last AS yhat_naive, sn.y AS yhat_snaive,
         f.y_last + coalesce((f.y_last - f.y_first)
                             / nullif(CAST(datediff('day', f.d_first, f.d_last) AS DOUBLE), 0.0), 0.0)
                    * CAST(datediff('day', f.d_last, f.ds) AS DOUBLE) AS yhat_drift
  FROM fut f LEFT JOIN s sn ON sn.series_id = f.series_id AND sn."date" = f.sd
)"""

DRIFT_TABLE = FIRSTS + """,
lb AS (SELECT series_id, "date",
              last_value(y IGNORE NULLS) OVER w AS y_last,
              last_value(CASE WHEN y IS NOT NULL THEN "date" END IGNORE NULLS) OVER w AS d_last
       FROM s WINDOW w AS (PARTITION BY series_id ORDER BY "date"
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ft AS (
  SELECT lb.series_id, lb."date",
         30.0 * lb.y_last
         + coalesce((lb.y_last - fs.y_first)
                    / nullif(CAST(datediff('day', fs.d_first, lb.d_last) AS DOUBLE), 0.0), 0.0)
           * CAST(30 * datediff('day', lb.d_last, CAST(lb."date" - 1 AS DATE)) + 465 AS DOUBLE) AS yhat_30d
  FROM lb JOIN fs ON fs.series_id = lb.series_id
)"""

BASE = q.with_(q.LINES, q.DAILY, q.filled("null"), S_Y)


def _metric_sql(col: str) -> str:
    return (f"CASE WHEN {col} = 0 OR {col} IS NULL THEN {col} ELSE "
            f"round({col} / pow(10.0, floor(log10(abs({col}))) - 9)) * pow(10.0, floor(log10(abs({col}))) - 9) END")


# ------------------------------------------------------------------ step 8: backtest harness

@query("m6_cv_cutoffs", BASE + "," + CUTS + """
SELECT series_id, cutoff FROM cuts""")
def m6_cv_cutoffs(spark, sf):
    """M6 cutoffs: initial 90 days, horizon 30, step 15, counted back from the end."""
    return bt.cv_cutoffs(series_y(spark, sf))


@query("m18_baseline_forecasts", BASE + "," + CUTS + "," + BASELINES + """
SELECT * FROM base""")
def m18_baseline_forecasts(spark, sf):
    """Naive / seasonal-naive / drift forecasts at every M6 cutoff."""
    s = series_y(spark, sf, checkpoint=True)
    return fc.baseline_forecasts(s, bt.cv_cutoffs(s))


@query("m8_baseline_metrics", BASE + "," + CUTS + "," + BASELINES + f""",
cv AS (SELECT b.*, s.y FROM base b LEFT JOIN s ON s.series_id = b.series_id AND s."date" = b.ds),
e AS (SELECT datediff('day', cutoff, ds) AS horizon, y - yhat_drift AS err,
             abs(y - yhat_drift) / nullif(abs(y), 0.0) AS ape
      FROM cv WHERE y IS NOT NULL AND yhat_drift IS NOT NULL),
a AS (SELECT CAST(horizon AS BIGINT) AS horizon, avg(err * err) AS mse, avg(abs(err)) AS mae,
             avg(ape) AS mape, count(*) AS n FROM e GROUP BY horizon)
SELECT horizon, {_metric_sql('mse')} AS mse, {_metric_sql('sqrt(mse)')} AS rmse,
       {_metric_sql('mae')} AS mae, {_metric_sql('mape')} AS mape,
       CAST(NULL AS DOUBLE) AS coverage, n
FROM a""")
def m8_baseline_metrics(spark, sf):
    """M8 on the drift baseline: MSE/RMSE/MAE/MAPE by horizon (10 significant digits)."""
    s = series_y(spark, sf, checkpoint=True)
    return bt.performance_metrics(bt.baseline_cv(s), pred="yhat_drift")


@query("m8_smoothed_metrics", BASE + "," + CUTS + "," + BASELINES + f""",
cv AS (SELECT b.*, s.y FROM base b LEFT JOIN s ON s.series_id = b.series_id AND s."date" = b.ds),
e AS (SELECT CAST(datediff('day', cutoff, ds) AS BIGINT) AS horizon, y - yhat_snaive AS err, y FROM cv),
h AS (SELECT horizon, sum(err * err) AS s2, sum(abs(err)) AS s1, sum(abs(err) / nullif(abs(y), 0.0)) AS sp, count(err) AS n,
             count(abs(err) / nullif(abs(y), 0.0)) AS np, count(*) - count(err) AS unanswered FROM e GROUP BY horizon),
w AS (SELECT horizon, sum(s2) OVER r / nullif(sum(n) OVER r, 0) AS mse, sum(s1) OVER r / nullif(sum(n) OVER r, 0) AS mae,
             sum(sp) OVER r / nullif(sum(np) OVER r, 0) AS mape, CAST(sum(n) OVER r AS BIGINT) AS n, CAST(sum(unanswered) OVER r AS BIGINT) AS unanswered
      FROM h WINDOW r AS (ORDER BY horizon RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT horizon, {_metric_sql('mse')} AS mse, {_metric_sql('sqrt(mse)')} AS rmse, {_metric_sql('mae')} AS mae, {_metric_sql('mape')} AS mape,
       CAST(NULL AS DOUBLE) AS coverage, n, unanswered
FROM w""")
def m8_smoothed_metrics(spark, sf):
    """M8: metrics of the seasonal-naive baseline smoothed over a tenth of the horizon
    (3 days), weighted by rows; rows without truth or forecast are counted."""
    s = series_y(spark, sf, checkpoint=True)
    return bt.smoothed_metrics(bt.baseline_cv(s), pred="yhat_snaive")


@query("m9_time_series_folds", BASE + """
SELECT series_id, "date", y, CAST(ntile(5) OVER (PARTITION BY series_id ORDER BY "date") - 1 AS BIGINT) AS fold
FROM s""")
def m9_time_series_folds(spark, sf):
    """M9: five contiguous time folds per series (expanding-window CV)."""
    return bt.time_series_folds(series_y(spark, sf))


@query("a12_best_baseline", BASE + "," + CUTS + "," + BASELINES + """,
cv AS (SELECT b.*, s.y FROM base b LEFT JOIN s ON s.series_id = b.series_id AND s."date" = b.ds),
m AS (SELECT series_id, 'naive' AS method, yhat_naive AS yhat, y FROM cv
      UNION ALL SELECT series_id, 'snaive', yhat_snaive, y FROM cv
      UNION ALL SELECT series_id, 'drift', yhat_drift, y FROM cv),
a AS (SELECT series_id, method,
             CAST(sum(abs(CAST(floor((y - yhat) * 100.0 + 0.5) / 100.0 AS DECIMAL(18,2)))) AS DOUBLE) / count(*) AS mae, count(*) AS n
      FROM m WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY series_id, method),
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mae, method) AS rn FROM a)
SELECT series_id, method, mae, n FROM r WHERE rn = 1""")
def a12_best_baseline(spark, sf):
    """Per series, the baseline with the lowest backtest MAE (errors in cents)."""
    s = series_y(spark, sf, checkpoint=True)
    cv = bt.baseline_cv(s)
    return bt.best_method(cv, {"naive": "yhat_naive", "snaive": "yhat_snaive", "drift": "yhat_drift"})


# ------------------------------------------------------------------ step 11: serving

@query("m21_forecast_table", BASE + "," + DRIFT_TABLE + """
SELECT series_id, "date", yhat_30d FROM ft""")
def m21_forecast_table(spark, sf):
    """Materialised 30-day forecast for every (series, origin day)."""
    return fc.drift_forecast_table(series_y(spark, sf))


REQUESTS_SQL = """,
req AS (
  SELECT DISTINCT d.series_id AS country, strftime(d."date", '%Y') AS year,
         CAST(month(d."date") AS VARCHAR) AS month, v.day
  FROM daily d, (VALUES ('1'), ('31')) v(day)
  UNION ALL
  SELECT DISTINCT d.series_id || '_x', strftime(d."date", '%Y'), CAST(month(d."date") AS VARCHAR), '1'
  FROM daily d WHERE d.series_id = 'all'
),
r AS (SELECT *, CASE WHEN lower(country) = 'all' THEN 'all'
                     ELSE regexp_replace(lower(country), '\\s+', '_', 'g') END AS series_id,
             CASE WHEN regexp_full_match(year, '\\d{4}') AND regexp_full_match(month, '\\d{1,2}')
                       AND regexp_full_match(day, '\\d{1,2}')
                  THEN CAST(try_strptime(year || '-' || lpad(month, 2, '0') || '-' || lpad(day, 2, '0'),
                                         '%Y-%m-%d') AS DATE) END AS target_date
      FROM req),
fb AS (SELECT series_id, min("date") AS lo, max("date") AS hi FROM ft GROUP BY series_id),
v AS (SELECT r.country, r.year, r.month, r.day, r.series_id, r.target_date,
             CASE WHEN r.target_date IS NULL THEN 'bad_date'
                  WHEN fb.lo IS NULL THEN 'unknown_series'
                  WHEN r.target_date NOT BETWEEN fb.lo AND fb.hi THEN 'out_of_range'
                  ELSE 'ok' END AS status
      FROM r LEFT JOIN fb ON fb.series_id = r.series_id)"""


def shared_daily(spark, sf):
    """Daily revenue materialised once for queries that read it in several
    branches (requests, forecast table, actuals). Only what they read is kept,
    so the exact distincts of the other measures are never computed."""
    return cut_lineage(daily(spark, sf, ["revenue"]))


def y_from_daily(d):
    from ..operators import calendar as cal
    return cal.fill_calendar(d, "null").select("series_id", "date",
                                               F.col("revenue").cast("double").alias("y"))


def requests_table(spark, sf, d=None):
    """Prediction requests derived from the data: for every series and month,
    day 1 (valid) and day 31 (invalid for short months), plus an unknown
    series for every month of the market series."""
    d = d if d is not None else daily(spark, sf, ["revenue"])
    ym = [F.date_format("date", "yyyy").alias("year"), F.month("date").cast("string").alias("month")]
    valid = (d.select(F.col("series_id").alias("country"), *ym,
                      F.explode(F.array(F.lit("1"), F.lit("31"))).alias("day")).distinct())
    unknown = (d.where(F.col("series_id") == "all")
               .select(F.concat(F.col("series_id"), F.lit("_x")).alias("country"), *ym,
                       F.lit("1").alias("day")).distinct())
    return valid.unionByName(unknown)


@query("p13_request_validation", BASE + "," + DRIFT_TABLE + REQUESTS_SQL + """
SELECT * FROM v""")
def p13_request_validation(spark, sf):
    """P13 + J5: status of every request (bad date, unknown series, out of range, ok)."""
    d = shared_daily(spark, sf)
    ft = fc.drift_forecast_table(y_from_daily(d))
    return sv.validate_requests(requests_table(spark, sf, d), ft)


@query("j6_lookup_requests", BASE + "," + DRIFT_TABLE + REQUESTS_SQL + """
SELECT v.*, CASE WHEN v.status = 'ok' THEN ft.yhat_30d END AS yhat_30d
FROM v LEFT JOIN ft ON ft.series_id = v.series_id AND ft."date" = v.target_date""")
def j6_lookup_requests(spark, sf):
    """Requests answered from the materialised forecast table."""
    d = shared_daily(spark, sf)
    ft = fc.drift_forecast_table(y_from_daily(d))
    return sv.lookup_requests(requests_table(spark, sf, d), ft)


@query("j9_asof_forecast", BASE + "," + DRIFT_TABLE + """,
iss AS (SELECT series_id, "date" AS issued, yhat_30d FROM ft WHERE dayofweek("date") = 1),
rq AS (SELECT series_id, "date" AS target_date FROM ft)
SELECT rq.series_id, rq.target_date, iss.issued, iss.yhat_30d
FROM rq ASOF LEFT JOIN iss ON rq.series_id = iss.series_id AND rq.target_date >= iss.issued""")
def j9_asof_forecast(spark, sf):
    """J9 + M22: forecasts issued weekly (Mondays); each day takes the latest
    forecast issued on or before it."""
    ft = fc.drift_forecast_table(series_y(spark, sf, checkpoint=True))
    issued = ft.where(F.dayofweek("date") == 2).select(
        "series_id", F.col("date").alias("issued"), "yhat_30d")
    req = ft.select("series_id", F.col("date").alias("target_date"))
    return sv.asof_lookup(req, issued, "yhat_30d", "issued")


# ------------------------------------------------------------------ step 12: monitoring

PVA_SQL = BASE + "," + CUTS + "," + DRIFT_TABLE + """,
act AS (SELECT series_id, CAST("date" - 1 AS DATE) AS cutoff,
               sum(revenue) OVER w AS actual_total, count(revenue) OVER w AS actual_days
        FROM (SELECT *, datediff('day', DATE '1970-01-01', "date") AS dn FROM filled) t
        WINDOW w AS (PARTITION BY series_id ORDER BY dn RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING)),
fc AS (SELECT c.series_id, c.cutoff, CAST(floor(ft.yhat_30d * 100.0 + 0.5) / 100.0 AS DECIMAL(18,2)) AS forecast_total
       FROM cuts c JOIN ft ON ft.series_id = c.series_id AND ft."date" = c.cutoff + 1),
pva AS (SELECT fc.series_id, fc.cutoff, fc.forecast_total, act.actual_total, act.actual_days,
               act.actual_total - fc.forecast_total AS error,
               CAST(abs(act.actual_total - fc.forecast_total) AS DOUBLE)
                 / nullif(CAST(abs(act.actual_total) AS DOUBLE), 0.0) AS ape
        FROM fc JOIN act ON act.series_id = fc.series_id AND act.cutoff = fc.cutoff)"""


def _pva(spark, sf):
    from ..operators import calendar as cal
    f = cut_lineage(cal.fill_calendar(daily(spark, sf, ["revenue"]), "null"))
    s = f.select("series_id", "date", F.col("revenue").cast("double").alias("y"))
    ft = fc.drift_forecast_table(s)
    cuts = bt.cv_cutoffs(s)
    totals = (cuts.join(ft, (cuts.series_id == ft.series_id)
                        & (ft.date == F.date_add(cuts.cutoff, 1)))
              .select(cuts.series_id, cuts.cutoff, F.col("yhat_30d").alias("yhat_total")))
    return mon.predicted_vs_actual(totals, f)


def _money_out(df, cols):
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c) for c in df.columns])


@query("j7_predicted_vs_actual", PVA_SQL + """
SELECT series_id, cutoff, CAST(forecast_total AS DOUBLE) AS forecast_total,
       CAST(actual_total AS DOUBLE) AS actual_total, actual_days, CAST(error AS DOUBLE) AS error, ape
FROM pva""")
def j7_predicted_vs_actual(spark, sf):
    """Forecast 30-day totals (drift table) against the actual totals."""
    return _money_out(_pva(spark, sf), {"forecast_total", "actual_total", "error"})


@query("m23_error_monitor", PVA_SQL + """,
mo AS (SELECT *,
         CAST(sum(abs(error)) OVER (PARTITION BY series_id ORDER BY cutoff ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS DOUBLE)
           / count(abs(error)) OVER (PARTITION BY series_id ORDER BY cutoff ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)
           AS rolling_mae,
         CAST(sum(abs(error)) OVER (PARTITION BY series_id ORDER BY cutoff ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING) AS DOUBLE)
           / nullif(count(abs(error)) OVER (PARTITION BY series_id ORDER BY cutoff ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING), 0)
           AS prev_rolling_mae
       FROM pva)
SELECT series_id, cutoff, CAST(forecast_total AS DOUBLE) AS forecast_total,
       CAST(actual_total AS DOUBLE) AS actual_total, actual_days, CAST(error AS DOUBLE) AS error, ape,
       rolling_mae, prev_rolling_mae, rolling_mae / nullif(prev_rolling_mae, 0.0) AS drift_ratio
FROM mo""")
def m23_error_monitor(spark, sf):
    """Rolling MAE of the last 4 forecasts and its drift against the 4 before."""
    m = mon.error_monitor(_pva(spark, sf), window=4)
    return _money_out(m, {"forecast_total", "actual_total", "error"})


# ------------------------------------------------------------------ model-based (rows-only)

@query("m1_fourier_forecast")
def m1_fourier_forecast(spark, sf):
    """M1 + M3 + M4 + M5: fit every series on its whole history (cutoff = last
    observed day); history plus 30 future days with trend/weekly/yearly."""
    s = series_y(spark, sf, checkpoint=True)
    cuts = s.where(F.col("y").isNotNull()).groupBy("series_id").agg(F.max("date").alias("cutoff"))
    coefs, layout = fc.fit_forecaster(s, cuts)
    frame = fc.future_frame(s, cuts, periods=30, include_history=True)
    return fc.predict(coefs, frame, layout)


@query("m6_model_cv")
def m6_model_cv(spark, sf):
    """M6: rolling-origin backtest of the forecaster (causal outlier mask)."""
    s = series_y(spark, sf, checkpoint=True)
    return bt.cross_validation(s, mask="causal")


@query("m8_model_metrics")
def m8_model_metrics(spark, sf):
    """M8: metrics of the forecaster backtest by horizon, with interval coverage."""
    s = series_y(spark, sf, checkpoint=True)
    return bt.performance_metrics(bt.cross_validation(s, mask="causal"))


@query("m25_masked_vs_raw")
def m25_masked_vs_raw(spark, sf):
    """Backtest MAE/MAPE per series without mask, causal mask, whole-series mask."""
    s = series_y(spark, sf, checkpoint=True)
    return bt.masked_vs_raw(s, masks=("none", "causal", "whole"))


def _thirty_day_answers(spark, sf):
    d = shared_daily(spark, sf)
    s = cut_lineage(y_from_daily(d))
    ft = fc.drift_forecast_table(s)
    ok = sv.validate_requests(requests_table(spark, sf, d), ft).where(F.col("status") == "ok")
    cuts = ok.select("series_id", F.date_sub("target_date", 1).alias("cutoff")).distinct()
    coefs, layout = fc.fit_forecaster(s, cuts, mask="causal")
    tot = fc.thirty_day_total(fc.forecast_horizon(coefs, layout, 30))
    fit_time = coefs.select("series_id", "cutoff", "fit_seconds")
    return (ok.join(tot.withColumn("target_date", F.date_add("cutoff", 1)),
                    on=["series_id", "target_date"], how="left")
            .join(fit_time, on=["series_id", "cutoff"], how="left"))


@query("m7_thirty_day_forecast")
def m7_thirty_day_forecast(spark, sf):
    """M7 + A11 + P7 + SD12: every valid request answered by a model fitted on
    the days before the requested date; Σ of the 30 daily predictions from it."""
    return _thirty_day_answers(spark, sf).select(
        "country", "year", "month", "day", "series_id", "target_date",
        "yhat_total", "yhat_lower_total", "yhat_upper_total")


@query("m24_predict_log")
def m24_predict_log(spark, sf):
    """M24 + F14: predict-log records of the answered requests (prediction,
    probability (none for a regressor), target date, runtime, version)."""
    a = _thirty_day_answers(spark, sf)
    return a.select("series_id", F.col("yhat_total").alias("y_pred"),
                    F.lit(None).cast("double").alias("y_proba"), "target_date",
                    F.col("fit_seconds").alias("runtime_s"),
                    sv.hms_duration("fit_seconds").alias("runtime"),
                    F.lit("0.1").alias("model_version"), F.lit(False).alias("is_test"))


@query("m22_weekly_replay")
def m22_weekly_replay(spark, sf):
    """Retrain weekly (every Monday of the calendar), answer every day of the
    series from the latest weekly model (J9), compare with the truth (J7).
    ``status`` says why a day has no forecast: before the first model, or the
    latest model had too few rows to be fitted."""
    s = series_y(spark, sf, checkpoint=True)
    cuts = sv.weekly_cutoffs(s, weekday=2)
    coefs, layout = fc.fit_forecaster(s, cuts, mask="causal")
    fc7 = fc.forecast_horizon(coefs, layout, 7)
    truth = s.select("series_id", F.col("date").alias("ds"), "y")
    status = (F.when(F.col("cutoff").isNull(), "before_first_model")
              .when(F.col("yhat").isNull(), "too_few_rows").otherwise("ok"))
    return (truth.join(fc7, on=["series_id", "ds"], how="left")
            .select("series_id", "cutoff", "ds", "y", "yhat", "yhat_lower", "yhat_upper", status.alias("status")))


@query("m24_train_log")
def m24_train_log(spark, sf):
    """M24 + F13 + F14 + F15: train-log records of the weekly fits, appended to a
    log table and read back: first/last day, hold-out RMSE (the days until the
    next fit, which the model has not seen; null where none of them has a
    value or the model could not be fitted, which ``note`` says), runtime as
    HHH:MM:SS, model version and name, test flag."""
    s = series_y(spark, sf, checkpoint=True)
    cuts = sv.weekly_cutoffs(s, weekday=2)
    coefs, layout = fc.fit_forecaster(s, cuts)
    truth = s.select("series_id", F.col("date").alias("ds"), "y")
    err = F.col("y") - F.col("yhat")
    held_out = (fc.forecast_horizon(coefs, layout, 7).join(truth, on=["series_id", "ds"])
                .groupBy("series_id", "cutoff").agg(rounded_rmse(F.avg(err * err)).alias("rmse")))
    first = s.where(F.col("y").isNotNull()).groupBy("series_id").agg(F.min("date").alias("first_date"))
    note = F.when(F.col("beta").isNull(), "too few rows").otherwise("additive trend + seasonality")
    records = (coefs.join(first, on="series_id").join(held_out, on=["series_id", "cutoff"], how="left")
               .select("series_id", "first_date", F.col("cutoff").alias("last_date"), "rmse",
                       F.col("fit_seconds").alias("runtime_s"), F.lit("0.1").alias("model_version"),
                       note.alias("note"), F.lit(False).alias("is_test")))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/logs/train-{uuid.uuid4().hex}"
    sv.append_log(records, path, sv.TRAIN_LOG_SCHEMA)
    return sv.read_log(spark, path).withColumn("model_name", sv.model_name("sl", "series_id", "0.1"))


@query("s8_models_by_series")
def s8_models_by_series(spark, sf):
    """S8 + M13 + M14: one model for each series and month, saved by series, loaded
    again, and every request answered by the latest model of its own series."""
    d = shared_daily(spark, sf)
    s = cut_lineage(y_from_daily(d))
    months = (s.groupBy("series_id", F.trunc("date", "month").alias("_m")).agg(F.max("date").alias("cutoff"))
              .select("series_id", "cutoff"))
    coefs, layout = fc.fit_forecaster(s, months, mask="causal")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    sv.save_models(coefs, path, layout, "0.1")
    return sv.predict_requests(sv.load_models(spark, path), requests_table(spark, sf, d), layout.spec)
