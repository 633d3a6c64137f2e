"""Calendar-range window features of daily revenue.

Frames are in calendar days: ``RANGE`` over the integer day number, one
window partition per series. A partition holds one row per day of that
series, so its size is bounded by the calendar, not by the invoice volume;
every frame shares the same partitioning and order, so Spark sorts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day_number

# Trailing revenue windows (days), the target horizon (days),
# the year offset (days) and the trailing window of the activity means (days).
PREVIOUS_DAYS = [7, 14, 28, 70]
HORIZON_DAYS = 30
YEAR_DAYS = 365
RECENT_DAYS = 30
# rows trimmed from the end of each series for training (target incomplete)
TRAINING_TRIM_ROWS = 30

FEATURE_COLUMNS = [f"previous_{n}" for n in PREVIOUS_DAYS] + [
    "previous_year", "recent_invoices", "recent_views"]


def _sum_in(col: str, w, lo: int, hi: int) -> Column:
    return F.sum(col).over(w.rangeBetween(lo, hi))


def _mean_in(col: str, w, lo: int, hi: int) -> Column:
    # mean over non-null values; exact sum / count, never decimal division
    f = w.rangeBetween(lo, hi)
    return F.sum(col).over(f).cast("double") / F.nullif(F.count(col).over(f), F.lit(0))


def with_window_features(filled: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """W1-W4 on a calendar-completed daily frame.

    * ``previous_N`` = Σ revenue over ``[d-N, d)``                (W1)
    * ``target``     = Σ revenue over ``[d, d+horizon)``           (W2)
    * ``previous_year`` = Σ revenue over ``[d-365, d-365+horizon)`` (W3)
    * ``recent_invoices/views`` = mean over ``[d-30, d)``          (W4)

    Null sums and means (empty or all-gap frames) become 0, as the features
    are filled with zero before use. Money stays decimal here.
    """
    w = Window.partitionBy("series_id").orderBy(day_number("date"))
    zero = F.lit(0)
    cols = [F.coalesce(_sum_in("revenue", w, -n, -1), zero).alias(f"previous_{n}")
            for n in PREVIOUS_DAYS]
    cols.append(F.coalesce(_sum_in("revenue", w, -YEAR_DAYS, -YEAR_DAYS + horizon - 1), zero)
                .alias("previous_year"))
    cols.append(F.coalesce(_mean_in("unique_invoices", w, -RECENT_DAYS, -1), F.lit(0.0))
                .alias("recent_invoices"))
    cols.append(F.coalesce(_mean_in("total_views", w, -RECENT_DAYS, -1), F.lit(0.0))
                .alias("recent_views"))
    cols.append(F.coalesce(_sum_in("revenue", w, 0, horizon - 1), zero).alias("target"))
    return filled.select("series_id", "date", *cols)


def feature_sum(cols=FEATURE_COLUMNS) -> Column:
    """Row sum of the features in double, left to right (fixed order)."""
    out = None
    for c in cols:
        x = F.col(c).cast("double")
        out = x if out is None else out + x
    return out


def revenue_features(filled: DataFrame, training: bool = True,
                     horizon: int = HORIZON_DAYS) -> DataFrame:
    """DM5: the supervised feature matrix of every series.

    W1-W4, then P9 (drop rows whose feature sum is not positive), then W5
    when ``training``: drop the last 30 remaining rows of each series,
    counted after P9, because their target runs past the data.
    """
    feats = with_window_features(filled, horizon).where(feature_sum() > 0)
    if training:
        w = Window.partitionBy("series_id").orderBy(F.desc("date"))
        feats = (feats.withColumn("_rn", F.row_number().over(w))
                 .where(F.col("_rn") > TRAINING_TRIM_ROWS).drop("_rn"))
    return feats


def features_to_double(df: DataFrame) -> DataFrame:
    """Output projection: every feature and the target as double."""
    num = set(FEATURE_COLUMNS) | {"target"}
    return df.select(*[F.col(c).cast("double").alias(c) if c in num else F.col(c)
                       for c in df.columns])


def band_join_features(probe: DataFrame, filled: DataFrame, lo_days: int, hi_days: int,
                       value: str = "revenue", out: str = "band_sum") -> DataFrame:
    """J4, general path: Σ value over ``[d+lo, d+hi]`` for probe dates kept
    in a separate table (dates need not be in the series).

    Equi-join on ``series_id`` plus a date-band condition; each probe row
    meets at most ``hi-lo+1`` series rows (one per calendar day), so the
    join output is bounded by probes x band width, never all pairs.
    """
    p = probe.select("series_id", F.col("date").alias("probe_date"))
    s = filled.select("series_id", F.col("date").alias("_d"), F.col(value).alias("_v"))
    # bucket the band into whole-width day blocks so the join has an equi key
    width = hi_days - lo_days + 1
    p_b = p.withColumn("_blk", F.explode(F.sequence(
        F.floor((day_number("probe_date") + lo_days) / width).cast("bigint"),
        F.floor((day_number("probe_date") + hi_days) / width).cast("bigint"))))
    s_b = s.withColumn("_blk", F.floor(day_number("_d") / width).cast("bigint"))
    cond = ((p_b.series_id == s_b.series_id) & (p_b._blk == s_b._blk)
            & s_b._d.between(F.date_add(p_b.probe_date, lo_days),
                             F.date_add(p_b.probe_date, hi_days)))
    j = p_b.join(s_b, cond, how="left").select(p_b.series_id, p_b.probe_date, s_b._v)
    return (j.groupBy("series_id", "probe_date")
            .agg(F.coalesce(F.sum("_v"), F.lit(0)).alias(out))
            .withColumnRenamed("probe_date", "date"))
