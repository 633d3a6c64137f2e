"""Interpolation and decomposition against independent pandas / numpy references."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from revcast.operators import clean_series as cs


def _series(spark, n=200, seed=4):
    rng = np.random.default_rng(seed)
    start = dt.date(2019, 3, 1)
    y = 1000 + 50 * np.sin(np.arange(n) * 2 * np.pi / 7) + rng.normal(0, 20, n)
    y[[0, 1, 10, 11, 12, 50, n - 2, n - 1]] = np.nan
    rows = [("s", start + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "series_id string, date date, y double")
    idx = pd.DatetimeIndex([start + dt.timedelta(days=i) for i in range(n)])
    return df, pd.Series(y, index=idx)


def test_time_interpolation_matches_pandas(spark):
    df, ps = _series(spark)
    got = cs.interpolate_time(df, "y", out="yi").orderBy("date").toPandas()["yi"].to_numpy(dtype=float)
    ref = ps.interpolate(method="time").to_numpy()
    assert np.allclose(got, ref, equal_nan=True, rtol=1e-12)
    assert np.isnan(got[:2]).all() and got[-1] == got[-3]   # leading stay null, trailing repeat


def test_inside_only_interpolation(spark):
    df, ps = _series(spark)
    got = (cs.interpolate_time(df, "y", out="yi", fill_trailing=False)
           .orderBy("date").toPandas()["yi"].to_numpy(dtype=float))
    ref = ps.interpolate(method="time", limit_area="inside").to_numpy()
    assert np.allclose(got, ref, equal_nan=True, rtol=1e-12)


def test_decomposition_matches_numpy(spark):
    df, ps = _series(spark)
    filled = cs.interpolate_time(df, "y", out="yi")
    got = cs.decompose_additive(filled, "yi", period=7).orderBy("date").toPandas()
    y = ps.interpolate(method="time").to_numpy()
    n, p = len(y), 7
    trend = np.full(n, np.nan)
    for i in range(3, n - 3):
        trend[i] = y[i - 3:i + 4].mean()
    detr = y - trend
    phase_means = np.array([np.nanmean(detr[k::p]) for k in range(p)])
    phase_means -= phase_means.mean()
    seasonal = np.tile(phase_means, n // p + 1)[:n]
    assert np.allclose(got["trend"].to_numpy(dtype=float), trend, equal_nan=True, rtol=1e-12)
    assert np.allclose(got["seasonal"].to_numpy(dtype=float), seasonal, rtol=1e-9, atol=1e-9)
    resid = y - trend - seasonal
    assert np.allclose(got["resid"].to_numpy(dtype=float), resid, equal_nan=True, rtol=1e-9, atol=1e-9)


def test_quantile_mask_matches_numpy(spark):
    df, ps = _series(spark)
    got = cs.quantile_mask(df, "y", out="ym").orderBy("date").toPandas()["ym"].to_numpy(dtype=float)
    v = ps.to_numpy()
    lo, hi = np.nanpercentile(v, [25, 75])
    ref = np.where((v >= lo) & (v <= hi), v, np.nan)
    assert np.array_equal(np.isnan(got), np.isnan(ref))
    assert np.allclose(got[~np.isnan(got)], ref[~np.isnan(ref)])


def test_even_period_decomposition(spark):
    df, ps = _series(spark, n=240)
    filled = cs.interpolate_time(df, "y", out="yi")
    got = cs.decompose_additive(filled, "yi", period=12).orderBy("date").toPandas()
    y = ps.interpolate(method="time").to_numpy()
    n, p, h = len(y), 12, 6
    w = np.r_[0.5, np.ones(2 * h - 1), 0.5] / p
    trend = np.full(n, np.nan)
    for i in range(h, n - h):
        trend[i] = w @ y[i - h:i + h + 1]
    detr = y - trend
    pm = np.array([np.nanmean(detr[k::p]) for k in range(p)])
    pm -= pm.mean()
    seasonal = np.tile(pm, n // p + 1)[:n]
    assert np.allclose(got["trend"].to_numpy(dtype=float), trend, equal_nan=True, rtol=1e-12)
    assert np.allclose(got["seasonal"].to_numpy(dtype=float), seasonal, rtol=1e-9, atol=1e-9)


def test_kept_sketches_stay_within_their_rank_error(spark):
    rng = np.random.default_rng(7)
    hot = [("hot", k % 9, float(v)) for k, v in enumerate(rng.lognormal(3, 1, 30_000))]
    rows = hot + [("few", 0, float(v)) for v in (5, 1, 4, 2, 3)] + [("ties", 1, 7.0)] * 50 + [("few", 1, None), ("none", 0, None), (None, 0, 2.0)]
    df = spark.createDataFrame(rows, "series_id string, month int, price double").repartition(6)
    kept = cs.quantile_sketches(df, "price", ["series_id", "month"])
    q = cs.sketched_quantiles(cs.merge_sketches(kept, ["series_id"]), (0.05, 0.5, 0.95))
    got = {r.series_id: r for r in q.collect()}
    assert set(got) == {"hot", "few", "ties", None} and got["hot"].n == 30_000 and got["few"].n == 5
    assert (got["few"].q05, got["few"].q50, got["few"].q95) == (1, 3, 5)  # few values are kept whole
    assert got["ties"].q05 == got["ties"].q95 == 7
    values = np.sort([v for _, _, v in hot])
    for name, p in (("q05", 0.05), ("q50", 0.5), ("q95", 0.95)):
        assert abs(np.searchsorted(values, got["hot"][name]) / len(values) - p) <= 3 * cs.KLL_ERROR
    within = cs.rank_within(df, "price", q, ["series_id"], (0.05, 0.5, 0.95), 3 * cs.KLL_ERROR).collect()
    assert all(r.q05_within and r.q50_within and r.q95_within for r in within if r.n > 5) and len(within) == 3
    wrong = cs.rank_within(df, "price", q.withColumn("q50", F.col("q50") * 1.1), ["series_id"], (0.5,), 3 * cs.KLL_ERROR)
    assert [r.q50_within for r in wrong.collect() if r.series_id in ("hot", "ties")] == [False, False]
    assert cs.quantile_sketches(df.limit(0), "price", ["series_id"]).count() == 0


def test_mask_by_kept_quantiles_is_the_exact_mask_but_for_the_rank_error(spark):
    df, _ = _series(spark, n=400)
    q = cs.sketched_quantiles(cs.quantile_sketches(df, "y", ["series_id"]))
    both = cs.sketched_mask(cs.quantile_mask(df, "y", out="exact"), q, "y", out="kept").toPandas()
    assert len(both) == 400 and (both["exact"].notna() != both["kept"].notna()).sum() <= 2 * (1 + 400 * cs.KLL_ERROR)
    none = cs.sketched_mask(df, q.where("series_id = 'x'"), "y", out="kept")
    assert none.where("kept IS NOT NULL").isEmpty() and none.count() == 400


def test_rows_of_one_key_are_ranked_where_they_lie(spark):
    df = spark.range(0, 2_000, numPartitions=4).selectExpr("IF(id < 0, 'cold', 'hot') AS series_id", "CAST(id AS DOUBLE) AS price")
    q = spark.createDataFrame([("hot", 999.0)], "series_id string, q50 double")
    # rows of unknown size on both sides: Spark by itself would send all of a key to one task
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        within = cs.rank_within(df, "price", q, ["series_id"], (0.5,))
        plan = within._jdf.queryExecution().sparkPlan().toString()
        assert within.collect() == [("hot", 2_000, True)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
