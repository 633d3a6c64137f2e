"""Calendar and feature semantics against an independent brute force (pure Python)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from revcast.operators import calendar as cal
from revcast.operators import features as fe

START = dt.date(2018, 1, 15)


def _daily(spark):
    # observed days with gaps (every 3rd and 7th day missing), two series
    rows = []
    for sid, scale in (("a", 1), ("b", 3)):
        for i in range(0, 500):
            if i % 3 == 2 or i % 7 == 6:
                continue
            d = START + dt.timedelta(days=i)
            rows.append((sid, d, 10 + i % 5, 3 + i % 4, 2 + i % 3, 100 + i,
                         Decimal(f"{scale * (50 + (i * 37) % 400)}.{i % 100:02d}")))
    return spark.createDataFrame(
        rows, "series_id string, date date, purchases bigint, unique_invoices bigint, "
              "unique_streams bigint, total_views bigint, revenue decimal(28,6)")


def _brute(daily_rows, fill):
    by = {}
    for r in daily_rows:
        by.setdefault(r.series_id, {})[r.date] = r
    out = {}
    for sid, days in by.items():
        lo, hi = min(days), max(days)
        cal_days = [lo + dt.timedelta(days=i) for i in range((hi - lo).days + 1)]

        def rev(d):
            r = days.get(d)
            return r.revenue if r is not None else (Decimal(0) if fill == "zero" else None)

        def inv(d):
            r = days.get(d)
            return r.unique_invoices if r is not None else (0 if fill == "zero" else None)

        def s(vals):
            vals = [v for v in vals if v is not None]
            return float(sum(vals)) if vals else 0.0

        for d in cal_days:
            def win(a, b):  # days in [d+a, d+b] that are in the calendar
                return [d + dt.timedelta(days=k) for k in range(a, b + 1)
                        if lo <= d + dt.timedelta(days=k) <= hi]
            rec = {f"previous_{n}": s([rev(x) for x in win(-n, -1)]) for n in (7, 14, 28, 70)}
            rec["previous_year"] = s([rev(x) for x in win(-365, -336)])
            rec["target"] = s([rev(x) for x in win(0, 29)])
            vals = [inv(x) for x in win(-30, -1) if inv(x) is not None]
            rec["recent_invoices"] = (sum(vals) / len(vals)) if vals else 0.0
            out[(sid, d)] = rec
    return out


@pytest.mark.parametrize("fill", ["null", "zero"])
def test_features_match_brute_force(spark, fill):
    d = _daily(spark)
    got = {(r.series_id, r.date): r for r in
           fe.features_to_double(fe.with_window_features(cal.fill_calendar(d, fill))).collect()}
    ref = _brute(d.collect(), fill)
    assert got.keys() == ref.keys()
    for k, rec in ref.items():
        for c, v in rec.items():
            assert got[k][c] == pytest.approx(v, rel=1e-12, abs=1e-9), (k, c)


def test_gap_means_differ_by_fill(spark):
    d = _daily(spark)
    a = fe.with_window_features(cal.fill_calendar(d, "null")).where(F.col("date") == START + dt.timedelta(days=100))
    b = fe.with_window_features(cal.fill_calendar(d, "zero")).where(F.col("date") == START + dt.timedelta(days=100))
    ra, rb = a.orderBy("series_id").first(), b.orderBy("series_id").first()
    assert ra.recent_invoices > rb.recent_invoices > 0      # zeros pull the mean down
    assert ra.previous_28 == rb.previous_28                  # sums agree


def test_full_month_range(spark):
    d = _daily(spark)
    f = cal.fill_calendar(d, "zero", "full_months")
    b = f.groupBy("series_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"),
                                   F.count("*").alias("n")).orderBy("series_id").collect()
    last_obs = d.agg(F.max("date")).first()[0]
    for r in b:
        assert r.lo == dt.date(2018, 1, 1)
        assert r.hi == dt.date(last_obs.year, last_obs.month, 1) - dt.timedelta(days=1)
        assert r.n == (r.hi - r.lo).days + 1
    # days before the first observation are zero-filled
    early = f.where(F.col("date") < START).agg(F.sum("purchases")).first()[0]
    assert early == 0


def test_distinct_measures_with_nulls_and_any_measures(spark):
    from revcast.operators import daily as dly
    rows = [("A b", "2020-01-01", "1", "x", 2, 1.5), ("A b", "2020-01-01", "1", "y", 3, 2.5), ("A b", "2020-01-01", None, "x", None, 1.0),
            ("C", "2020-01-01", "1", "x", 1, None), (None, "2020-01-01", "2", None, 1, 1.0), ("C", None, None, None, None, None)]
    li = spark.createDataFrame(rows, "country string, date string, invoice_id string, stream_id string, times_viewed long, price double").withColumn(
        "date", F.to_date("date"))
    want = {("a_b", 3, 1, 2, 5, 5.0), ("c", 1, 1, 1, 1, None), (None, 1, 1, 0, 1, 1.0), ("all", 5, 2, 2, 7, 6.0)}
    got = dly.daily_grouping_sets(li).where("date IS NOT NULL").collect()
    assert {(r.series_id, r.purchases, r.unique_invoices, r.unique_streams, r.total_views, None if r.revenue is None else float(r.revenue)) for r in got} == want
    for some in (["revenue"], ["unique_streams"], ["unique_streams", "purchases"], dly.MEASURES):
        few = {tuple(r) for r in dly.daily_grouping_sets(li, measures=some).collect()}
        assert few == {tuple(r) for r in dly.daily_grouping_sets(li).select("series_id", "date", *some).collect()}


def test_smoothed_metrics_equal_a_plain_loop(spark):
    import datetime as dt

    import numpy as np

    from revcast.operators import backtest as bt
    rng = np.random.default_rng(4)
    rows = []
    for c in range(5):
        for h in range(1, 31):
            y = None if (c + h) % 7 == 0 else float(rng.integers(0, 5))
            p = None if (c * h) % 11 == 3 else float(rng.normal(2, 1))
            rows.append(("s", dt.date(2020, 1, 1 + c), dt.date(2020, 1, 1 + c) + dt.timedelta(h), y, p, None if p is None else p - 1, None if p is None else p + 1))
    cv = spark.createDataFrame(rows, "series_id string, cutoff date, ds date, y double, yhat double, yhat_lower double, yhat_upper double")
    for r in bt.smoothed_metrics(cv).collect():
        frame = [x for x in rows if r.horizon - 2 <= (x[2] - x[1]).days <= r.horizon]
        known = [x for x in frame if x[3] is not None and x[4] is not None]
        e = np.array([x[3] - x[4] for x in known])
        assert (r.n, r.unanswered) == (len(known), len(frame) - len(known))
        assert np.isclose(r.mse, (e * e).mean()) and np.isclose(r.mae, np.abs(e).mean())
        assert np.isclose(r.mape, np.mean([abs(x[3] - x[4]) / abs(x[3]) for x in known if x[3]]))
        assert np.isclose(r.coverage, np.mean([x[5] <= x[3] <= x[6] for x in known]))


def test_unknown_series_raises_before_aggregating(spark):
    from revcast.operators import daily as dly
    li = spark.createDataFrame([("United Kingdom", "2020-01-01", "1", "x", 2, 1.5)], "country string, date string, invoice_id string, stream_id string, times_viewed long, price double")
    assert dly.series_daily(li, "united_kingdom").count() == dly.series_daily(li, "United Kingdom").count() == dly.series_daily(li, "all").count() == 1
    with pytest.raises(dly.UnknownSeriesError):
        dly.series_daily(li, "atlantis")
