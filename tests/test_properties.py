"""Property checks on the driver tables (sf0.001)."""

from pyspark.sql import functions as F

from revcast.operators import calendar as cal
from revcast.operators import daily as dly
from revcast.operators import features as fe
from revcast.plans.q_series import lines

from .conftest import SF_SMALL


def test_calendar_is_complete(spark):
    d = dly.daily_grouping_sets(lines(spark, SF_SMALL))
    f = cal.fill_calendar(d)
    chk = f.groupBy("series_id").agg(F.count("*").alias("n"), F.min("date").alias("lo"),
                                     F.max("date").alias("hi"))
    for r in chk.collect():
        assert r.n == (r.hi - r.lo).days + 1


def test_totals_are_preserved(spark):
    li = lines(spark, SF_SMALL)
    d = dly.daily_grouping_sets(li)
    tot = li.agg(F.count("*").alias("n"), F.sum("times_viewed").alias("v"),
                 F.sum(F.col("price").cast("decimal(18,2)")).alias("r")).first()
    whole = d.where("series_id = 'all'").agg(F.sum("purchases"), F.sum("total_views"),
                                             F.sum("revenue")).first()
    parts = d.where("series_id <> 'all'").agg(F.sum("purchases"), F.sum("total_views"),
                                              F.sum("revenue")).first()
    assert tuple(whole) == (tot.n, tot.v, tot.r) == tuple(parts)


def test_features_are_monotone_and_causal(spark):
    d = dly.daily_grouping_sets(lines(spark, SF_SMALL))
    f = cal.fill_calendar(d, "zero")
    feats = fe.with_window_features(f)
    # revenue is non-negative in the driver data, so wider windows sum more
    assert feats.where("previous_14 < previous_7 OR previous_28 < previous_14").isEmpty()
    # changing revenue on or after a day leaves that day's lag features alone
    cut = "1996-06-01"
    g = f.withColumn("revenue", F.when(F.col("date") >= cut, F.col("revenue") * 3)
                     .otherwise(F.col("revenue")))
    a = feats.where(F.col("date") == cut).select("series_id", *fe.FEATURE_COLUMNS)
    b = fe.with_window_features(g).where(F.col("date") == cut).select("series_id", *fe.FEATURE_COLUMNS)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_training_trim_drops_last_30_rows(spark):
    d = dly.daily_grouping_sets(lines(spark, SF_SMALL))
    f = cal.fill_calendar(d, "zero")
    untrimmed = fe.revenue_features(f, training=False)
    trimmed = fe.revenue_features(f, training=True)
    a = {r.series_id: r["count"] for r in untrimmed.groupBy("series_id").count().collect()}
    b = {r.series_id: r["count"] for r in trimmed.groupBy("series_id").count().collect()}
    for k, n in a.items():
        assert b.get(k, 0) == max(n - 30, 0)
