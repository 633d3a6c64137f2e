"""Forecaster: known coefficients, brute-force parity, no look-ahead, baselines."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from revcast.operators import backtest as bt
from revcast.operators import forecast as fc


def _synthetic(spark, days=730, noise=0.0, seed=1):
    rng = np.random.default_rng(seed)
    start = dt.date(2018, 1, 1)
    rows = []
    for i in range(days):
        d = start + dt.timedelta(days=i)
        dn = (d - dt.date(1970, 1, 1)).days
        y = 1000 + 2.0 * i + 150 * math.sin(2 * math.pi * dn / 7) + noise * rng.normal()
        rows.append(("s1", d, None if i % 11 == 5 else float(y)))
    return spark.createDataFrame(rows, "series_id string, date date, y double")


def test_recovers_trend_and_weekly(spark):
    s = _synthetic(spark)
    cuts = spark.createDataFrame([("s1", dt.date(2019, 12, 1))], "series_id string, cutoff date")
    spec = fc.ForecastSpec(changepoint_prior_scale=0.001)
    coefs, layout = fc.fit_forecaster(s, cuts, spec)
    out = fc.forecast_horizon(coefs, layout, 30).orderBy("ds").collect()
    for r in out:
        i = (r.ds - dt.date(2018, 1, 1)).days
        dn = (r.ds - dt.date(1970, 1, 1)).days
        truth = 1000 + 2.0 * i + 150 * math.sin(2 * math.pi * dn / 7)
        assert r.yhat == pytest.approx(truth, rel=2e-3)


def test_matches_brute_force_ridge(spark):
    s = _synthetic(spark, noise=50.0)
    cuts = spark.createDataFrame([("s1", dt.date(2018, 9, 30)), ("s1", dt.date(2019, 6, 30))],
                                 "series_id string, cutoff date")
    spec = fc.ForecastSpec()
    coefs, layout = fc.fit_forecaster(s, cuts, spec)
    got = {r.cutoff: np.array(r.beta) for r in coefs.collect()}
    pdf = s.toPandas()
    dn = (pdf["date"].astype("datetime64[ns]") - np.datetime64("1970-01-01")).dt.days.to_numpy()
    origin = dn.min()
    for cut, beta in got.items():
        cdn = (np.datetime64(cut) - np.datetime64("1970-01-01")).astype(int)
        m = (dn <= cdn) & pdf["y"].notna().to_numpy()
        X = fc.design_matrix(layout, dn[m].astype(float), float(origin))
        lam = layout.penalties()
        span = (cdn - origin) / fc.YEAR
        keep = np.ones(layout.p, dtype=bool)
        for j in range(layout.hinges):
            keep[2 + j] = layout.hinge_at(j) <= spec.changepoint_range * span
        Xk = X[:, keep]
        ref = np.linalg.solve(Xk.T @ Xk + np.diag(lam[keep]), Xk.T @ pdf["y"].to_numpy()[m])
        assert np.allclose(beta[keep], ref, rtol=1e-6, atol=1e-6)
        assert np.all(beta[~keep] == 0)


def test_no_look_ahead(spark):
    s = _synthetic(spark, noise=30.0)
    cut = dt.date(2019, 3, 1)
    cuts = spark.createDataFrame([("s1", cut)], "series_id string, cutoff date")
    a, lay = fc.fit_forecaster(s, cuts)
    s2 = s.withColumn("y", F.when(F.col("date") > F.lit(cut), F.col("y") * 10).otherwise(F.col("y")))
    b, _ = fc.fit_forecaster(s2, cuts, layout=lay)
    fa = fc.forecast_horizon(a, lay, 30).select("ds", "yhat").orderBy("ds").collect()
    fb = fc.forecast_horizon(b, lay, 30).select("ds", "yhat").orderBy("ds").collect()
    assert [r.yhat for r in fa] == pytest.approx([r.yhat for r in fb], rel=1e-12)


def test_beats_drift_on_seasonal_series(spark):
    s = _synthetic(spark, noise=20.0)
    cv = bt.cross_validation(s, horizon=30, initial=180)
    mae_model = cv.select(F.avg(F.abs(F.col("y") - F.col("yhat")))).first()[0]
    base = bt.baseline_cv(s, horizon=30, initial=180)
    mae_drift = base.select(F.avg(F.abs(F.col("y") - F.col("yhat_drift")))).first()[0]
    assert mae_model < 0.5 * mae_drift


def test_cutoffs_rule(spark):
    rows = [("a", dt.date(2017, 11, 28) + dt.timedelta(days=i), 1.0) for i in range(611)]
    s = spark.createDataFrame(rows, "series_id string, date date, y double")
    cuts = sorted(r.cutoff for r in bt.cv_cutoffs(s, 90, 30).collect())
    assert len(cuts) == 33
    assert cuts[0] == dt.date(2018, 3, 8) and cuts[-1] == dt.date(2019, 7, 1)


def test_causal_mask_matches_brute_force():
    rng = np.random.default_rng(5)
    y = rng.normal(size=300)
    y[[3, 50, 51]] = np.nan
    got = fc.causal_mask(y)
    seen = []
    for t, v in enumerate(y):
        if np.isnan(v):
            assert np.isnan(got[t])
            continue
        if seen:
            lo, hi = np.percentile(seen, [25, 75])
            keep = lo <= v <= hi
            assert (not np.isnan(got[t])) == keep
        else:
            assert got[t] == v
        seen.append(v)


def test_horizon_forecast_matches_jvm_predict(spark):
    s = _synthetic(spark, noise=10.0)
    cuts = spark.createDataFrame([("s1", dt.date(2019, 5, 1)), ("s1", dt.date(2019, 8, 1))],
                                 "series_id string, cutoff date")
    coefs, layout = fc.fit_forecaster(s, cuts)
    a = {(r.cutoff, r.ds): r for r in fc.forecast_horizon(coefs, layout, 10).collect()}
    frame = fc.future_frame(s, cuts, periods=10, include_history=False)
    b = {(r.cutoff, r.ds): r for r in fc.predict(coefs, frame, layout).collect()}
    assert a.keys() == b.keys() and len(a) == 20
    for k in a:
        for c in ("trend", "weekly", "yearly", "yhat", "yhat_lower", "yhat_upper"):
            assert a[k][c] == pytest.approx(b[k][c], rel=1e-9, abs=1e-6)


def test_baselines_match_brute_force(spark):
    s = _synthetic(spark, days=120, noise=5.0)
    rows = {r.date: r.y for r in s.collect()}
    cut = dt.date(2018, 3, 15)
    cuts = spark.createDataFrame([("s1", cut)], "series_id string, cutoff date")
    got = {r.h: r for r in fc.baseline_forecasts(s, cuts, horizon=10, season=7).collect()}
    obs = sorted(d for d, v in rows.items() if v is not None and d <= cut)
    d1, dT = obs[0], obs[-1]
    slope = (rows[dT] - rows[d1]) / (dT - d1).days
    for h in range(1, 11):
        ds = cut + dt.timedelta(days=h)
        sd = cut + dt.timedelta(days=h - 7 * math.ceil(h / 7))
        assert got[h].yhat_naive == rows[dT]
        assert got[h].yhat_snaive == rows.get(sd)
        assert got[h].yhat_drift == pytest.approx(rows[dT] + slope * (ds - dT).days, rel=1e-12)
