"""ARIMA grid, recursive/direct forecasts, as-of lookup, sampling, supervised smoke."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from revcast.operators import arima as ar
from revcast.operators import serve as sv
from revcast.operators import supervised as sup

from .least_squares import hannan_rissanen


def _ar1(spark, phi=0.7, n=600, seed=3, sid="s"):
    rng = np.random.default_rng(seed)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = phi * y[t - 1] + rng.normal()
    start = dt.date(2019, 1, 1)
    rows = [(sid, start + dt.timedelta(days=i), float(100 + y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, date date, y double"), y + 100


def test_hannan_rissanen_recovers_ar1():
    rng = np.random.default_rng(0)
    y = np.zeros(3000)
    for t in range(1, 3000):
        y[t] = 0.6 * y[t - 1] + rng.normal()
    aic, coefs, n = hannan_rissanen(y, (1, 0, 0, 0, 0, 0, 7))
    assert coefs["ar.L1"] == pytest.approx(0.6, abs=0.05)
    aic0, _, _ = hannan_rissanen(y, (0, 0, 0, 0, 0, 0, 7))
    assert aic < aic0


def test_grid_picks_an_ar_term(spark):
    s, _ = _ar1(spark)
    best = ar.best_candidate(ar.arima_grid(s)).first()
    terms = dict(best.terms)
    assert any(k.startswith("ar.L1") for k in terms) or any(k.startswith("ma.L1") for k in terms)
    assert ar.arima_grid(s).count() == 64


def test_grid_from_sums_equals_least_squares_on_the_days(spark):
    rng = np.random.default_rng(11)
    start, rows, values = dt.date(2019, 1, 1), [], {}
    for sid, n in (("long", 500), ("year", 365), ("short", 58), ("shorter", 41), ("tiny", 29), ("one", 1), ("flat", 200)):
        noise = rng.normal(size=n)
        y = 1e5 + 2e3 * np.sin(2 * np.pi * np.arange(n) / 7) + 1e3 * (noise + 0.6 * np.roll(noise, 1)) + 30 * np.arange(n)
        values[sid] = np.full(n, 7.0) if sid == "flat" else y
        rows += [(sid, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values[sid])]
    rows += [("long", start - dt.timedelta(days=1), None), ("long", start - dt.timedelta(days=2), float("nan"))]
    s = spark.createDataFrame(rows, "series_id string, date date, y double").repartition(5)
    got = {(r.series_id, r.spec): r for r in ar.arima_grid(s).collect()}
    assert len(got) == 7 * 64
    fitted = 0
    for sid, y in values.items():
        for o in ar.candidate_orders():
            r = got[sid, f"({o[0]},{o[1]},{o[2]})x({o[3]},{o[4]},{o[5]},{o[6]})"]
            aic, terms, n = hannan_rissanen(y, o)
            if sid == "flat":
                assert r.aic is None and r.terms == {}
                continue
            assert (r.aic is None) == (aic is None) and r.n == n, (sid, o)
            if aic is not None:
                fitted += 1
                assert r.aic == pytest.approx(aic, rel=1e-9)
                assert r.terms.keys() == terms.keys()
                assert all(r.terms[k] == pytest.approx(terms[k], rel=1e-6, abs=1e-8) for k in terms), (sid, o)
    assert fitted > 64 * 2
    assert ar.arima_grid(s.limit(0)).count() == 0


def test_grid_and_recursion_hold_no_days_in_python(spark):
    s, _ = _ar1(spark, n=100)
    cuts = s.groupBy("series_id").agg(F.max("date").alias("cutoff"))
    for df in (ar.arima_grid(s), ar.recursive_forecast(s, cuts)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInPandas") == 1


def test_recursion_over_many_cutoffs_equals_each_fit_alone(spark):
    rng = np.random.default_rng(2)
    start, lags, horizon, rows, values = dt.date(2019, 1, 1), 7, 12, [], {}
    for sid, n in (("a", 300), ("b", 45), ("c", 20)):
        values[sid] = 5e4 + 1e3 * np.sin(np.arange(n)) + 300 * rng.normal(size=n)
        rows += [(sid, start + dt.timedelta(days=i), float(v)) for i, v in enumerate(values[sid])]
    s = spark.createDataFrame(rows, "series_id string, date date, y double").repartition(3)
    marks = [("a", 10), ("a", 30), ("a", 31), ("a", 150), ("a", 299), ("a", 310), ("b", 44), ("c", 19), ("c", -5), ("none", 5)]
    cuts = spark.createDataFrame([(sid, start + dt.timedelta(days=i)) for sid, i in marks + marks[:1]], "series_id string, cutoff date")
    got = {}
    for r in ar.recursive_forecast(s, cuts, lags=lags, horizon=horizon).collect():
        assert (r.ds - r.cutoff).days == r.h
        got.setdefault((r.series_id, (r.cutoff - start).days), {})[r.h] = r
    assert set(got) == set(marks) and all(sorted(v) == list(range(1, horizon + 1)) for v in got.values())
    for (sid, i), steps in got.items():
        y = values.get(sid, np.array([]))[:max(i + 1, 0)]
        if len(y) < 3 * lags + 10:
            assert {(r.status, r.yhat) for r in steps.values()} == {("short history", None)}
            continue
        x = np.column_stack([np.ones(len(y) - lags)] + [y[lags - k:len(y) - k] for k in range(1, lags + 1)])
        beta = np.linalg.lstsq(x, y[lags:], rcond=None)[0]
        hist = list(y)
        for h in range(1, horizon + 1):
            hist.append(float(beta[0] + sum(beta[k] * hist[-k] for k in range(1, lags + 1))))
            assert steps[h].status == "ok" and steps[h].yhat == pytest.approx(hist[-1], rel=1e-9)


def test_recursive_matches_numpy(spark):
    s, y = _ar1(spark, n=300)
    cut = dt.date(2019, 1, 1) + dt.timedelta(days=249)
    cuts = spark.createDataFrame([("s", cut)], "series_id string, cutoff date")
    got = [r.yhat for r in ar.recursive_forecast(s, cuts, lags=3, horizon=5).orderBy("h").collect()]
    yt = y[:250]
    X = np.column_stack([np.ones(247), yt[2:249], yt[1:248], yt[0:247]])
    beta = np.linalg.lstsq(X, yt[3:], rcond=None)[0]
    hist = list(yt[-3:])
    ref = []
    for _ in range(5):
        p = beta @ np.array([1.0, hist[-1], hist[-2], hist[-3]])
        ref.append(p)
        hist.append(p)
    assert got == pytest.approx(ref, rel=1e-9)


def test_direct_matches_numpy(spark):
    s, y = _ar1(spark, n=200)
    cut = dt.date(2019, 1, 1) + dt.timedelta(days=149)
    cuts = spark.createDataFrame([("s", cut)], "series_id string, cutoff date")
    got = {r.h: r.yhat for r in ar.direct_forecast(s, cuts, horizon=3).collect()}
    lags = ar.DIRECT_LAGS
    for h in (1, 2, 3):
        rows, tg = [], []
        for d in range(max(lags), 150 - h):
            rows.append([1.0] + [y[d - L] for L in lags])
            tg.append(y[d + h])
        X, t = np.array(rows), np.array(tg)
        beta = np.linalg.solve(X.T @ X + 1e-6 * np.eye(X.shape[1]), X.T @ t)
        x = np.array([1.0] + [y[149 - L] for L in lags])
        assert got[h] == pytest.approx(float(beta @ x), rel=1e-6)


def test_asof_lookup_matches_brute_force(spark):
    issued = spark.createDataFrame(
        [("a", dt.date(2020, 1, 6), 1.0), ("a", dt.date(2020, 1, 13), 2.0), ("b", dt.date(2020, 1, 8), 5.0)],
        "series_id string, cutoff date, yhat_30d double")
    req = spark.createDataFrame(
        [("a", dt.date(2020, 1, 5)), ("a", dt.date(2020, 1, 6)), ("a", dt.date(2020, 1, 12)),
         ("a", dt.date(2020, 1, 20)), ("b", dt.date(2020, 1, 9)), ("c", dt.date(2020, 1, 9))],
        "series_id string, target_date date")
    got = {(r.series_id, r.target_date): (r.cutoff, r.yhat_30d)
           for r in sv.asof_lookup(req, issued).collect()}
    assert got[("a", dt.date(2020, 1, 5))] == (None, None)
    assert got[("a", dt.date(2020, 1, 6))] == (dt.date(2020, 1, 6), 1.0)
    assert got[("a", dt.date(2020, 1, 12))] == (dt.date(2020, 1, 6), 1.0)
    assert got[("a", dt.date(2020, 1, 20))] == (dt.date(2020, 1, 13), 2.0)
    assert got[("b", dt.date(2020, 1, 9))] == (dt.date(2020, 1, 8), 5.0)
    assert got[("c", dt.date(2020, 1, 9))] == (None, None)


def test_exact_sample_is_exact_and_seeded(spark):
    df = spark.range(0, 1000).select(
        (F.col("id") % 3).cast("string").alias("series_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") / 3).cast("int")).alias("date"))
    a = sup.exact_sample(df, 0.3, seed=7)
    counts = {r.series_id: r["count"] for r in a.groupBy("series_id").count().collect()}
    totals = {r.series_id: r["count"] for r in df.groupBy("series_id").count().collect()}
    for k, n in totals.items():
        assert counts[k] == round(0.3 * n)
    b = sup.exact_sample(df, 0.3, seed=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_supervised_pipeline_smoke(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        x = rng.normal(size=7)
        rows.append(("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), *map(float, x),
                     float(3 * x[0] + x[1])))
    cols = ", ".join(f"{c} double" for c in sup.FEATURE_COLUMNS)
    df = spark.createDataFrame(rows, f"series_id string, date date, {cols}, target double")
    model, rmse, scores = sup.train_supervised(df, num_trees=10)
    assert rmse is not None and rmse >= 0
    pred = sup.predict_supervised(model, df)
    assert pred.count() == 300


def test_arima_choice_does_not_depend_on_the_unit(spark):
    s, _ = _ar1(spark)
    picks = {ar.best_candidate(ar.arima_grid(s.withColumn("y", F.col("y") * unit))).first().spec for unit in (1e-3, 1.0, 1e6)}
    assert len(picks) == 1
    assert len({r.n for r in ar.arima_grid(s).where("aic IS NOT NULL").collect()}) == 1


def test_training_frame_does_not_depend_on_the_input_partitions(spark):
    rows = [(f"s{i % 5}", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i % 11), float(i % 7), float(3 * (i % 11) - i % 7)) for i in range(400)]
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    sums = set()
    for n in (1, 2, 4):
        df = spark.createDataFrame(rows, "series_id string, date date, a double, b double, target double").repartition(n)
        data = VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(sup.ml_ready(df))
        model = RandomForestRegressor(featuresCol="f", labelCol="target", numTrees=5, seed=1).fit(data)
        sums.add(round(model.transform(data).agg(F.sum("prediction")).first()[0], 6))
    assert len(sums) == 1


def test_training_rows_end_before_the_first_test_target(spark):
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=i)) for i in range(400)]
    train, test = sup.time_split(spark.createDataFrame(rows, "series_id string, date date"))
    last, first = train.agg(F.max("date")).first()[0], test.agg(F.min("date")).first()[0]
    assert (first - last).days == sup.TARGET_DAYS


def test_no_two_series_share_a_place(spark):
    ids = spark.range(10_000).select(F.concat(F.lit("s"), "id").alias("series_id"))
    index = sup.series_index(ids.unionByName(ids))
    digits = sup.index_digits(index)
    assert len(digits) == 14
    rows = sup.with_series_digits(ids, index, digits)
    assert rows.select(*digits).distinct().count() == 10_000
    unknown = sup.with_series_digits(spark.createDataFrame([("new",)], "series_id string"), index, digits).first()
    assert not any(unknown[d] for d in digits)
    assert rows.where(" AND ".join(f"{d} = 0" for d in digits)).isEmpty()  # a known series is never like an unknown one


def test_models_by_series_equal_least_squares(spark):
    import datetime as dt
    rng = np.random.default_rng(3)
    rows = []
    for s in range(5):
        w = rng.normal(size=len(sup.FEATURE_COLUMNS))
        for d in range(1 if s == 4 else 80):
            x = rng.normal(1e6 * (s + 1), 1e3, len(w))
            if s == 3:
                x[0] = 7.0  # does not vary
            rows.append((f"s{s}", dt.date(2020, 1, 1) + dt.timedelta(d), *map(float, x), float(5 + x @ w)))
    df = spark.createDataFrame(rows, "series_id string, date date, " + ", ".join(f"{c} double" for c in sup.FEATURE_COLUMNS) + ", target double")
    models = sup.fit_by_series(df, ridge=1e-12)
    got = {(r.series_id, r.date): r for r in sup.predict_by_series(models, df).collect()}
    assert len(got) == len(rows)
    assert max(abs(got[r[0], r[1]].prediction - r[-1]) for r in rows) < 1e-2
    held = {r.series_id: r for r in sup.holdout_by_series(df).collect()}
    assert all(held[f"s{s}"].rmse < held[f"s{s}"].rmse_mean for s in range(4))
    assert sup.predict_by_series(models, df.withColumn("series_id", F.lit("none"))).where("prediction IS NOT NULL").isEmpty()
    assert sup.fit_by_series(df.where("1 = 0")).collect() == []
