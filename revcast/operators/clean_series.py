"""Robust cleaning of daily series: quantile mask, time interpolation,
additive decomposition (A7, P8, F11, F12, W8-W10, M17).

All steps are window expressions partitioned by ``series_id`` (plus
``cutoff`` for backtests). A partition holds one row per calendar day of
a series, so it is bounded by the calendar length, not the data volume.
Running frames (UNBOUNDED PRECEDING .. CURRENT ROW) and fixed offsets
(lag/lead) keep every window O(rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import day_number

# The outlier mask keeps values between these quantiles.
OUTLIER_MIN = 0.25
OUTLIER_MAX = 0.75


def _keys(df: DataFrame, keys) -> list[str]:
    return [k for k in (keys or ["series_id"]) if k in df.columns]


def series_quantiles(df: DataFrame, value: str = "revenue", probs=(OUTLIER_MIN, OUTLIER_MAX),
                     keys=None, exact: bool = True) -> DataFrame:
    """Per-series quantiles with linear interpolation, nulls skipped.

    ``exact`` uses ``percentile`` (holds one value per day of the series in
    the aggregation buffer, bounded by the calendar); ``exact=False`` uses
    ``percentile_approx`` (fixed-size sketch) for very long series.
    """
    k = _keys(df, keys)
    x = F.col(value).cast("double")
    cols = []
    for p in probs:
        agg = F.percentile(x, p) if exact else F.percentile_approx(x, p, 100000)
        cols.append(agg.alias(f"q{int(round(p * 100)):02d}"))
    return df.groupBy(*k).agg(*cols)


#: Size of a kept KLL sketch, and its one-sided rank error at 99 % confidence (fixed values of the published sketch).
KLL_K = 2_000
KLL_ERROR = 2.296 / KLL_K ** 0.9723


def quantile_sketches(rows: DataFrame, value: str, keys: list[str], k: int = KLL_K) -> DataFrame:
    """(keys, n, sketch): one KLL sketch of ``value`` for each key, nulls skipped.

    A sketch has a fixed size, is built with partial aggregation where the
    rows lie, and can be stored and merged, so a hot key is no hot task.
    """
    x = F.col(value).cast("double")
    return rows.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser ``keys`` (no keys: of all rows), from the kept ones alone."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, probs=(OUTLIER_MIN, OUTLIER_MAX)) -> DataFrame:
    """``q25``, ``q75``, ... of each kept sketch: values of the data whose rank is within the sketch's error."""
    rest = [c for c in sketches.columns if c != "sketch"]
    return sketches.select(*rest, *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"q{int(round(p * 100)):02d}") for p in probs])


def sketched_mask(df: DataFrame, quantiles: DataFrame, value: str = "revenue", lo: float = OUTLIER_MIN,
                  hi: float = OUTLIER_MAX, keys=None, out: str | None = None) -> DataFrame:
    """P8 by kept quantiles: null every value outside the band; a key without quantiles has no band, so none is kept."""
    k = _keys(df, keys)
    low, high = (F.col(f"q{int(round(p * 100)):02d}") for p in (lo, hi))
    x = F.col(value).cast("double")
    banded = df.join(quantiles.select(*k, low.alias("__lo"), high.alias("__hi")), k, "left")
    return banded.withColumn(out or value, F.when(x.between(F.col("__lo"), F.col("__hi")), x)).drop("__lo", "__hi")


def rank_within(rows: DataFrame, value: str, quantiles: DataFrame, keys: list[str], probs=(OUTLIER_MIN, OUTLIER_MAX),
                error: float = KLL_ERROR) -> DataFrame:
    """(keys, n, q25_within, ...): whether the exact rank of each sketched quantile is within ``error`` of its share.

    One pass over the rows, which are counted where they lie: the quantiles, one
    short row for each key, go to every executor. Equal values span a range of
    ranks, any of which counts.
    """
    x = F.col(value).cast("double")
    names = [f"q{int(round(p * 100)):02d}" for p in probs]
    marked = rows.where(x.isNotNull()).select(*keys, x.alias("__x")).join(F.broadcast(quantiles.select(*keys, *names)), keys)
    n = F.count(F.lit(1))
    return marked.groupBy(*keys).agg(n.alias("n"), *[
        ((F.count_if(F.col("__x") < F.col(c)) / n <= p + error) & (F.count_if(F.col("__x") <= F.col(c)) / n >= p - error)).alias(f"{c}_within")
        for c, p in zip(names, probs, strict=True)])


def quantile_mask(df: DataFrame, value: str = "revenue", lo: float = OUTLIER_MIN,
                  hi: float = OUTLIER_MAX, keys=None, fit_before: Column | None = None,
                  out: str | None = None) -> DataFrame:
    """Null every value outside the inclusive [q_lo, q_hi] band.

    Quantiles come from a window over the whole series (window aggregate,
    no join). ``fit_before`` (SD13) restricts the rows the quantiles are
    computed on, e.g. ``col('date') < col('cutoff')`` in a backtest, so the
    mask never looks past the forecast origin.
    """
    k = _keys(df, keys)
    w = Window.partitionBy(*k)
    x = F.col(value).cast("double")
    src = x if fit_before is None else F.when(fit_before, x)
    qlo = F.percentile(src, lo).over(w)
    qhi = F.percentile(src, hi).over(w)
    return df.withColumn(out or value, F.when(x.between(qlo, qhi), x))


def interpolate_time(df: DataFrame, value: str = "revenue", out: str | None = None,
                     keys=None, fill_trailing: bool = True) -> DataFrame:
    """F11 (+W10): linear interpolation in time of null values.

    For each gap, the last known value before and the first known value
    after (W10) are found with running ``last(ignorenulls)`` frames in both
    directions; the gap gets ``y0 + (y1 - y0) * (d - d0) / (d1 - d0)``.
    Leading gaps stay null; trailing gaps take the last known value
    (``fill_trailing``) or stay null (F12, piecewise linear inside the data).
    """
    k = _keys(df, keys)
    dn = day_number("date")
    x = F.col(value).cast("double")
    fwd = Window.partitionBy(*k).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    bwd = Window.partitionBy(*k).orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0)
    y0 = F.last(x, ignorenulls=True).over(fwd)
    d0 = F.last(F.when(x.isNotNull(), dn), ignorenulls=True).over(fwd)
    y1 = F.last(x, ignorenulls=True).over(bwd)
    d1 = F.last(F.when(x.isNotNull(), dn), ignorenulls=True).over(bwd)
    staged = df.select("*", y0.alias("_y0"), d0.alias("_d0"), y1.alias("_y1"), d1.alias("_d1"))
    y0, d0, y1, d1 = F.col("_y0"), F.col("_d0"), F.col("_y1"), F.col("_d1")
    inner = y0 + (y1 - y0) * (dn - d0) / (d1 - d0)
    res = (F.when(x.isNotNull(), x)
           .when(y0.isNull(), F.lit(None).cast("double"))
           .when(y1.isNull(), y0 if fill_trailing else F.lit(None).cast("double"))
           .otherwise(inner))
    return staged.withColumn(out or value, res).drop("_y0", "_d0", "_y1", "_d1")


def centred_moving_average(x: Column, period: int, order_keys, part_keys) -> Column:
    """Centred moving average over ``period`` rows (2 x m for even m).

    Written as an explicit sum of lag/lead terms so each row reads a fixed
    number of neighbours; null whenever any neighbour is missing (edges).
    """
    w = Window.partitionBy(*part_keys).orderBy(*order_keys)
    h = period // 2
    terms = []
    for off in range(-h, h + 1):
        t = x if off == 0 else (F.lag(x, -off).over(w) if off < 0 else F.lead(x, off).over(w))
        if period % 2 == 0 and abs(off) == h:
            t = t * F.lit(0.5)
        terms.append(t)
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / F.lit(float(period))


def decompose_additive(df: DataFrame, value: str = "revenue", period: int = 7,
                       keys=None) -> DataFrame:
    """M17 (W8 + W9): additive decomposition ``y = trend + seasonal + resid``.

    * trend: centred moving average (W8).
    * seasonal: mean of the detrended values per phase ``(row - 1) % period``
      counted from the first row of the series, centred so the phase means
      sum to zero (W9).

    Three chained windows, all on the series partitioning (one shuffle, no
    join, no second pass): the phase sums are running sums in date order
    within (series, phase), read at the phase's last row; the centring sums
    the phase means over the first row of each phase in phase order. Both
    are sequential folds, so the result does not depend on partitioning.
    Expects a gap-free (interpolated) input.
    """
    k = _keys(df, keys)
    x = F.col(value).cast("double")
    by_date = Window.partitionBy(*k).orderBy("date")
    base = df.select(*k, "date", x.alias("y"),
                     centred_moving_average(x, period, ["date"], k).alias("trend"),
                     ((F.row_number().over(by_date) - 1) % period).cast("bigint").alias("phase"))
    detr = F.col("y") - F.col("trend")
    ph = Window.partitionBy(*k, "phase")
    ph_run = ph.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ph_all = ph.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    staged = base.select(
        "*",
        F.coalesce(F.sum(detr).over(ph_run), F.lit(0.0)).alias("_run"),
        F.count(detr).over(ph_all).alias("_cnt"),
        F.row_number().over(ph.orderBy(F.desc("date"))).alias("_last"),
        F.row_number().over(ph.orderBy("date")).alias("_first"))
    # the phase mean sits on the last row of the phase (its full running sum)
    pm_last = F.when(F.col("_last") == 1, F.col("_run") / F.col("_cnt"))
    staged = staged.withColumn("_pm", F.max(pm_last).over(ph))
    by_phase = (Window.partitionBy(*k).orderBy("phase", "date")
                .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    first_pm = F.when(F.col("_first") == 1, F.col("_pm"))
    mean_pm = F.sum(first_pm).over(by_phase) / F.count(first_pm).over(by_phase)
    out = staged.withColumn("seasonal", F.col("_pm") - mean_pm)
    return (out.withColumn("resid", F.col("y") - F.col("trend") - F.col("seasonal"))
            .select(*k, "date", "y", "trend", "phase", "seasonal", "resid"))
