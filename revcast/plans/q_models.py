"""Queries: supervised model, candidate grids, recursive/direct forecasts,
streaming (steps 9, 10, 12). Rows-only checks (fitted models, streams),
except the test-mode sample, which has a DuckDB oracle."""

from __future__ import annotations

import hashlib
import uuid
from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import arima as ar
from ..operators import backtest as bt
from ..operators import clean_series as cs
from ..operators import features as fe
from ..operators import supervised as sup
from ..session import cut_lineage, ensure_checkpoint_dir
from ..streaming import stream as st
from .q_forecast import requests_table, series_y
from .q_series import FEATURE_INPUTS, filled, lines
from . import sql_fragments as q
from .registry import query


# Bump when a streaming query's definition changes: a checkpoint belongs to
# one query definition, and re-runs of the same definition are incremental.
STREAM_VERSION = "v2"


def _tag(sf: str) -> str:
    """A new checkpoint and sink for each run of a query: input that was replaced
    under the same path is read again, and two runs never share a sink."""
    return hashlib.sha1(f"{sf}|{STREAM_VERSION}".encode()).hexdigest()[:10] + "-" + uuid.uuid4().hex[:12]


def training_features(spark, sf, training=True):
    """The feature matrix, materialised once."""
    return cut_lineage(fe.revenue_features(filled(spark, sf, "zero", measures=FEATURE_INPUTS), training=training))


def interpolated_y(spark, sf):
    return cut_lineage(cs.interpolate_time(series_y(spark, sf), "y"))


# ------------------------------------------------------------------ supervised

@query("m10_rf_predictions")
def m10_rf_predictions(spark, sf):
    """M10 + M13: pooled scaler + random-forest pipeline trained on the training
    matrix of every series; predictions on the untrimmed feature table."""
    model = sup.fit_pooled(sup._double(training_features(spark, sf)))
    return sup.predict_supervised(model, training_features(spark, sf, training=False))


@query("m11_rf_grid_search")
def m11_rf_grid_search(spark, sf):
    """Forest size (10/15/20/25 trees) by 5-fold CV on contiguous time
    blocks (mean R²)."""
    _, scores = sup.grid_search(training_features(spark, sf))
    return spark.createDataFrame(scores, "num_trees int, mean_r2 double")


@query("m12_holdout_rmse")
def m12_holdout_rmse(spark, sf):
    """M12 + F13 + U4: time-ordered 75/25 split, hold-out RMSE per series
    (``round(sqrt(mse))``)."""
    f = sup._double(training_features(spark, sf))
    tr, te = sup.time_split(f)
    m = sup.fit_pooled(tr)
    p = m.transform(te)
    return (p.groupBy("series_id")
            .agg(F.round(F.sqrt(F.avg((F.col("target") - F.col("prediction")) ** 2))).alias("rmse"),
                 F.count(F.lit(1)).alias("n_test")))


@query("m13_models_by_series")
def m13_models_by_series(spark, sf):
    """M13 + M12: one model for each series, fitted side by side; hold-out RMSE of
    each against the mean of its training days."""
    return sup.holdout_by_series(training_features(spark, sf))


@query("m14_supervised_lookup")
def m14_supervised_lookup(spark, sf):
    """M14 + S8: model trained, saved to and re-loaded from shared storage,
    then requests answered from the untrimmed feature table (J6)."""
    model = sup.fit_pooled(sup._double(training_features(spark, sf)))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/sl-rf-0_1-{_tag(sf)}"
    sup.save_model(model, path)
    loaded = sup.load_model(spark, path)
    preds = sup.predict_supervised(loaded, training_features(spark, sf, training=False))
    ft = preds.select("series_id", "date", "y_pred")
    from ..operators import serve as sv
    return sv.lookup_requests(requests_table(spark, sf), ft, value="y_pred")


U3_SQL = q.with_(q.LINES, q.DAILY, q.filled("zero"), q.window_features()) + f""",
kept AS (SELECT * FROM feats WHERE {q.FEATURE_SUM} > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY "date" DESC) AS rn FROM kept),
train AS (SELECT * FROM ranked WHERE rn > 30),
s AS (SELECT *,
        row_number() OVER (PARTITION BY series_id
                           ORDER BY (CAST(datediff('day', DATE '1970-01-01', "date") AS BIGINT) * 2654435761 + 42)
                                    % 4294967296, "date") AS srn,
        count(*) OVER (PARTITION BY series_id) AS sn
      FROM train)
SELECT {q.FEATURES_OUT} FROM s WHERE srn <= round(sn * CAST(0.3 AS DOUBLE))"""


@query("u3_test_sample", U3_SQL)
def u3_test_sample(spark, sf):
    """Test-mode subsample, exactly 30 % of each series' training rows
    (seeded multiplicative-hash order of the days)."""
    return fe.features_to_double(sup.exact_sample(training_features(spark, sf), 0.3, seed=42))


U4_SQL = U3_SQL.split(",\ns AS (")[0] + f""",
s AS (SELECT *,
        row_number() OVER (PARTITION BY series_id
                           ORDER BY (CAST(datediff('day', DATE '1970-01-01', "date") AS BIGINT) * 2654435761 + 42)
                                    % 4294967296, "date") AS srn,
        count(*) OVER (PARTITION BY series_id) AS sn
      FROM train)
SELECT {q.FEATURES_OUT},
       CASE WHEN srn <= round(sn * CAST(0.75 AS DOUBLE)) THEN 'train' ELSE 'test' END AS split
FROM s"""


@query("u4_random_split", U4_SQL)
def u4_random_split(spark, sf):
    """U4: seeded shuffled 75/25 split of each series' training rows, tagged."""
    a, b = sup.random_split(training_features(spark, sf))
    out = a.withColumn("split", F.lit("train")).unionByName(b.withColumn("split", F.lit("test")))
    return fe.features_to_double(out)


# ------------------------------------------------------------------ grids

@query("m2_prior_grid")
def m2_prior_grid(spark, sf):
    """M2 + J8 + A12: changepoint prior scale .01/.05/.1/.15/.2 by backtest MAE per series."""
    return bt.prior_grid(series_y(spark, sf, checkpoint=True))


@query("m15_arima_grid")
def m15_arima_grid(spark, sf):
    """64 seasonal ARIMA candidates per series (season 7), AIC by
    two-stage least squares on the interpolated series."""
    g = ar.arima_grid(interpolated_y(spark, sf), season=7)
    return g.select("series_id", "spec", "aic", "n")


@query("m16_arima_best_terms")
def m16_arima_best_terms(spark, sf):
    """A12 + M16: the lowest-AIC candidate of every series and its coefficient table."""
    best = ar.best_candidate(ar.arima_grid(interpolated_y(spark, sf), season=7))
    return ar.coefficient_table(best)


# ------------------------------------------------------------------ multi-step

def _holdout_cutoffs(s):
    return (s.where(F.col("y").isNotNull()).groupBy("series_id")
            .agg(F.date_sub(F.max("date"), 30).alias("cutoff")))


@query("m19_recursive_forecast")
def m19_recursive_forecast(spark, sf):
    """AR(7) recursive 30-day forecast at every rolling-origin cutoff."""
    s = interpolated_y(spark, sf)
    out = ar.recursive_forecast(s, bt.cv_cutoffs(s), lags=7, horizon=30)
    truth = s.select("series_id", F.col("date").alias("ds"), "y")
    return out.join(truth, on=["series_id", "ds"], how="left")


@query("m20_direct_forecast")
def m20_direct_forecast(spark, sf):
    """One model per horizon step (1..30) at every rolling-origin cutoff."""
    s = interpolated_y(spark, sf)
    out = ar.direct_forecast(s, bt.cv_cutoffs(s), horizon=30)
    truth = s.select("series_id", F.col("date").alias("ds"), "y")
    return out.join(truth, on=["series_id", "ds"], how="left")


# ------------------------------------------------------------------ streaming (ST1-ST3, A13)

@query("st2_stream_daily_events")
def st2_stream_daily_events(spark, sf):
    """ST1 + ST2 + A13: events read as a file stream, daily tumbling windows per
    event type with a 1-day watermark (closed days only), HLL user counts."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = st.file_stream(spark, sf, schema, glob="events.parquet")
    d = st.daily_window_rollup(s, "ts", "event_type", "value", distinct="user_id")
    return st.run_available_now(d, f"events_daily-{_tag(sf)}")


@query("st2_stream_daily_exact", """
SELECT event_type AS series_id, CAST(ts AS DATE) AS "date", count(*) AS rows,
       CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS value
FROM events
WHERE CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)
GROUP BY event_type, CAST(ts AS DATE)""")
def st2_stream_daily_exact(spark, sf):
    """ST1 + ST2 (exact twin): the event stream's closed days with exact money
    sums; a day is emitted once the 1-day watermark (latest event - 1 day)
    has passed its window end."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = st.file_stream(spark, sf, schema, glob="events.parquet")
    d = st.daily_window_rollup(s, "ts", "event_type", "value", money=True)
    return st.run_available_now(d, f"events_daily_exact-{_tag(sf)}")


def invoice_stream_sums(spark, sf, folder, name, glob=None, max_files=None, distinct=None):
    """Daily lines and revenue per country of a stream of line-item files
    joined to the static order, customer and nation tables."""
    from ..functions.scalar import money
    from ..sources.tables import read_table
    schema = read_table(spark, sf, "lineitem").schema
    li = st.file_stream(spark, folder, schema, glob=glob, max_files=max_files)
    dims = (read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"))
            .join(read_table(spark, sf, "customer").select("c_custkey", "c_nationkey"),
                  F.col("o_custkey") == F.col("c_custkey"))
            .join(read_table(spark, sf, "nation").select("n_nationkey", "n_name"),
                  F.col("c_nationkey") == F.col("n_nationkey")))
    j = li.join(dims, li.l_orderkey == dims.o_orderkey).select(
        F.col("n_name").alias("country"), "date", money("l_extendedprice").alias("price"), "l_orderkey", "l_partkey")
    return st.additive_sums(j, ["country", "date"], {"revenue": "price"}, name, distinct)


@query("st1_stream_invoice_daily", """
SELECT n.n_name AS country, CAST(o.o_orderdate AS DATE) AS "date", count(*) AS rows,
       CAST(sum(CAST(l.l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name, CAST(o.o_orderdate AS DATE)""")
def st1_stream_invoice_daily(spark, sf):
    """ST1: line items as a file stream, exact daily revenue per country; files
    may bring any days in any order."""
    d = invoice_stream_sums(spark, sf, sf, f"invoice_daily-{_tag(sf)}", glob="lineitem.parquet")
    return d.withColumn("revenue", F.col("revenue").cast("double"))


@query("st1_stream_distinct_daily", """
SELECT n.n_name AS country, CAST(o.o_orderdate AS DATE) AS "date", count(*) AS rows,
       CAST(sum(CAST(l.l_extendedprice AS DECIMAL(28,6))) AS DOUBLE) AS revenue,
       count(DISTINCT l.l_orderkey) AS unique_invoices, count(DISTINCT l.l_partkey) AS unique_streams
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name, CAST(o.o_orderdate AS DATE)""")
def st1_stream_distinct_daily(spark, sf):
    """ST1: all measures of the daily roll-up from the stream of line items, exact
    distinct counts too; batch folders are merged level by level."""
    d = invoice_stream_sums(spark, sf, sf, f"invoice_distinct-{_tag(sf)}", glob="lineitem.parquet",
                            distinct={"unique_invoices": "l_orderkey", "unique_streams": "l_partkey"})
    return d.withColumn("revenue", F.col("revenue").cast("double"))


#: ST3: days that a forecast table is made from and days that it answers.
ISSUE_DAYS, ANSWER_DAYS = 28, 30


@query("st3_stream_scoring", f"""
WITH d AS (SELECT event_type AS series_id, CAST(ts AS DATE) AS "date", sum(CAST(value AS DECIMAL(28,6))) AS y
           FROM events GROUP BY event_type, CAST(ts AS DATE)),
c AS (SELECT min("date") + CAST((max("date") - min("date")) // 2 AS INTEGER) AS cutoff FROM d),
f AS (SELECT series_id, CAST(sum(y) AS DOUBLE) / count(*) AS yhat FROM d, c
      WHERE "date" <= cutoff AND "date" > cutoff - {ISSUE_DAYS} GROUP BY series_id)
SELECT d.series_id, d."date", CAST(y AS DOUBLE) AS actual, f.yhat AS forecast, CAST(y AS DOUBLE) - f.yhat AS error
FROM d CROSS JOIN c LEFT JOIN f ON f.series_id = d.series_id AND d."date" <= cutoff + {ANSWER_DAYS}
WHERE d."date" > cutoff AND CAST(d."date" AS TIMESTAMP) + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)""")
def st3_stream_scoring(spark, sf):
    """ST3: closed event days scored against a forecast table that was issued
    before them (mean of the last 28 days up to the middle of the calendar, for
    the 30 days after it); later days have no forecast. Idempotent per batch id."""
    from ..functions.scalar import money
    events = spark.read.parquet(f"{sf}/events.parquet")
    daily = (events.groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date"))
             .agg(F.sum(money("value")).alias("y")))
    first, last = events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    cutoff = F.lit(first and first + timedelta((last - first).days // 2)).cast("date")
    issued = (daily.where((F.col("date") <= cutoff) & (F.col("date") > F.date_sub(cutoff, ISSUE_DAYS)))
              .groupBy("series_id").agg((F.sum("y").cast("double") / F.count(F.lit(1))).alias("yhat"))
              .withColumn("date", F.explode(F.sequence(F.date_add(cutoff, 1), F.date_add(cutoff, ANSWER_DAYS)))))
    s = st.file_stream(spark, sf, events.schema, glob="events.parquet")
    d = st.daily_window_rollup(s, "ts", "event_type", "value", money=True).where(F.col("date") > cutoff)
    return st.score_stream(d, issued, f"events_scored-{_tag(sf)}").drop("batch")


# ------------------------------------------------------------------ approximate / drift

@query("a13_approx_daily")
def a13_approx_daily(spark, sf):
    """The grouping-sets daily roll-up with HyperLogLog++ distinct counts
    (no Expand of the input per distinct column; mergeable sketches)."""
    from ..operators import daily as dly
    return cal_double(dly.daily_grouping_sets(lines(spark, sf), exact_distinct=False))


def _sketch_sql() -> str:
    periods = " UNION ALL ".join(f"SELECT *, '{p}' AS period, CAST(date_trunc('{p}', \"date\") AS DATE) AS period_start FROM clines" for p in ("week", "month"))
    return q.with_(q.LINES) + f""",
p AS ({periods})
SELECT CASE WHEN grouping(country) = 1 THEN 'all' ELSE {q.SLUG_COUNTRY} END AS series_id, period, period_start,
       count(*) AS purchases, CAST(sum(times_viewed) AS BIGINT) AS total_views, CAST(sum(CAST(price AS DECIMAL(28,6))) AS DOUBLE) AS revenue,
       TRUE AS invoices_within, TRUE AS streams_within
FROM p GROUP BY GROUPING SETS ((period, period_start), (country, period, period_start))"""


@query("a13_sketch_rollups", _sketch_sql())
def a13_sketch_rollups(spark, sf):
    """Sketches kept by country and day, written once and united to weeks and
    months of every country and of the market; each estimate is held against the
    exact count (``*_within``: inside the stated error)."""
    from ..operators import daily as dly
    li = lines(spark, sf)
    kept = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sketches-{uuid.uuid4().hex}"
    dly.daily_sketches(li).write.parquet(kept)
    sketches = spark.read.parquet(kept)
    out = None
    for period in ("week", "month"):
        exact = dly.daily_grouping_sets(li.withColumn("date", F.to_date(F.date_trunc(period, "date"))), measures=list(dly.DISTINCT)).select(
            "series_id", F.col("date").alias("period_start"), *(F.col(m).alias(f"_{m}") for m in dly.DISTINCT))
        est = dly.sketch_rollup(sketches, period).unionByName(dly.sketch_rollup(sketches, period, None)).join(exact, ["series_id", "period_start"], "left")
        within = {m: F.coalesce(F.abs(F.col(m) - F.col(f"_{m}")) <= dly.sketch_error_bound(F.col(f"_{m}")), F.lit(False)) for m in dly.DISTINCT}
        rows = est.select("series_id", "period", "period_start", "purchases", "total_views", F.col("revenue").cast("double").alias("revenue"),
                          within["unique_invoices"].alias("invoices_within"), within["unique_streams"].alias("streams_within"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _drift_sql(digits: int = 8) -> str:
    def sig(x):
        return f"CAST(printf('%.{digits - 1}e', {x}) AS DOUBLE)"

    one = " UNION ALL ".join(
        f"SELECT series_id, '{c}' AS feature, \"date\" >= s AS after, CAST({c} AS DOUBLE) AS x FROM f" for c in fe.FEATURE_COLUMNS)
    return q.with_(q.LINES, q.DAILY, q.filled("zero"), q.window_features()) + f""",
kept AS (SELECT * FROM feats WHERE {q.FEATURE_SUM} > 0),
f AS (SELECT *, max("date") OVER (PARTITION BY series_id) - INTERVAL 365 DAY AS s FROM kept),
u AS ({one}),
g AS (SELECT series_id, feature, avg(x) FILTER (NOT after) AS m0, avg(x) FILTER (after) AS m1, stddev_samp(x) FILTER (NOT after) AS s0,
             list_sort(list(x) FILTER (NOT after)) AS a0, list_sort(list(x) FILTER (after)) AS a1
      FROM u GROUP BY series_id, feature),
r AS (SELECT series_id, feature, (m1 - m0) / nullif(s0, 0.0) AS shift,
             ({q.spark_percentile("a1", 0.5)} - {q.spark_percentile("a0", 0.5)})
               / nullif({q.spark_percentile("a0", 0.75)} - {q.spark_percentile("a0", 0.25)}, 0.0) AS percentile_shift FROM g)
SELECT series_id, feature, {sig("shift")} AS shift, {sig("percentile_shift")} AS percentile_shift FROM r"""


@query("m23_feature_drift", _drift_sql())
def m23_feature_drift(spark, sf):
    """M23 (data drift): shift of each feature's mean and median in the last year of
    each series against the years before, at 8 significant digits (reporting precision)."""
    from ..operators import monitor as mon
    f = fe.features_to_double(fe.revenue_features(filled(spark, sf, "zero", measures=FEATURE_INPUTS), training=False))
    last = F.max("date").over(Window.partitionBy("series_id"))
    g = f.withColumn("_after", F.col("date") >= F.date_sub(last, 365))
    return mon.feature_drift_flag(g, "_after", fe.FEATURE_COLUMNS).select(
        "series_id", "feature", *(F.when(F.col(c).isNotNull(), F.format_string("%.7e", c).cast("double")).alias(c)
                                 for c in ("shift", "percentile_shift")))


def cal_double(df):
    from ..operators import calendar as cal
    return cal.series_to_double(df)
