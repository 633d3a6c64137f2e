"""Request validation and lookup edge cases."""

import datetime as dt

from revcast.operators import serve as sv


def test_validation_statuses_and_lookup(spark):
    ft = spark.createDataFrame(
        [("all", dt.date(2018, 1, d), float(d)) for d in range(1, 32)]
        + [("united_kingdom", dt.date(2018, 1, d), 10.0 * d) for d in range(1, 32)],
        "series_id string, date date, yhat_30d double")
    req = spark.createDataFrame([
        ("all", "2018", "1", "5"),              # ok
        ("United Kingdom", "2018", "01", "7"),  # ok, display name slugged
        ("ALL", "2018", "1", "31"),             # ok, case-insensitive market key
        ("all", "2018", "ab", "1"),             # bad_date: not numeric
        ("all", "2018", "2", "30"),             # bad_date: no such day
        ("france", "2018", "1", "5"),           # unknown_series
        ("all", "2018", "2", "1"),              # out_of_range
    ], "country string, year string, month string, day string")
    got = {(r.country, r.month, r.day): (r.status, r.yhat_30d)
           for r in sv.lookup_requests(req, ft).collect()}
    assert got[("all", "1", "5")] == ("ok", 5.0)
    assert got[("United Kingdom", "01", "7")] == ("ok", 70.0)
    assert got[("ALL", "1", "31")] == ("ok", 31.0)
    assert got[("all", "ab", "1")] == ("bad_date", None)
    assert got[("all", "2", "30")] == ("bad_date", None)
    assert got[("france", "1", "5")] == ("unknown_series", None)
    assert got[("all", "2", "1")] == ("out_of_range", None)


def test_models_are_saved_and_answered_by_series(spark, tmpdir_path):
    import pytest
    from pyspark.sql import functions as F

    from revcast.operators import forecast as fc
    from revcast.operators.daily import UnknownSeriesError
    start = dt.date(2018, 1, 1)
    rows = [(sid, start + dt.timedelta(days=i), float(level + i % 7)) for sid, level in (("all", 900), ("eire", 10)) for i in range(400)]
    s = spark.createDataFrame(rows, "series_id string, date date, y double")
    cuts = spark.createDataFrame([(sid, start + dt.timedelta(days=n)) for sid in ("all", "eire") for n in (199, 299)],
                                 "series_id string, cutoff date")
    coefs, layout = fc.fit_forecaster(s, cuts)
    sv.save_models(coefs, tmpdir_path, layout, "0.1")
    sv.save_models(coefs.where("series_id = 'eire'"), tmpdir_path, layout, "0.1", is_test=True)
    one = sv.load_models(spark, tmpdir_path, "eire")
    assert {r.series_id for r in one.collect()} == {"eire"} and {r.model_name for r in one.collect()} == {"sl-eire-0_1"}
    assert all("series_id=eire" in f for f in one.select(F.input_file_name()).distinct().toPandas().iloc[:, 0])
    assert sv.load_models(spark, tmpdir_path, is_test=True).count() == 2 and sv.load_models(spark, tmpdir_path).count() == 4
    with pytest.raises(UnknownSeriesError):
        sv.load_models(spark, tmpdir_path, "france")
    day = start + dt.timedelta(days=300)
    req = spark.createDataFrame([("all", str(day.year), str(day.month), str(day.day)), ("Eire", str(day.year), str(day.month), str(day.day)),
                                 ("France", "2018", "5", "1"), ("all", "2018", "2", "31"), ("all", "2018", "1", "5")], sv.REQUEST_SCHEMA)
    got = {(r.country, r.month): r for r in sv.predict_requests(sv.load_models(spark, tmpdir_path), req, layout.spec).collect()}
    direct = {r.series_id: r.yhat_total for r in fc.thirty_day_total(fc.forecast_horizon(
        coefs.where(F.col("cutoff") == F.lit(day - dt.timedelta(days=1))), layout, 30)).collect()}
    assert got[("all", str(day.month))].yhat_total == pytest.approx(direct["all"]) and got[("Eire", str(day.month))].yhat_total == pytest.approx(direct["eire"])
    assert 25000 < direct["all"] < 28500 and 300 < direct["eire"] < 480
    assert {k[0] + k[1]: r.status for k, r in got.items() if r.status != "ok"} == {"France5": "unknown_series", "all2": "bad_date", "all1": "out_of_range"}
