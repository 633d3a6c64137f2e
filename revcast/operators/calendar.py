"""Calendar completion of daily series.

The spine is generated per series from its own date bounds (SD3) with
``sequence`` + ``explode``: its size is series x days, independent of the
number of invoice lines, so it never grows with the raw data volume.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import date_spine
from .daily import MEASURES



def calendar_spine(daily: DataFrame, range_: str = "observed",
                   scope: str = "series") -> DataFrame:
    """Every (series_id, date) the completed series must contain.

    ``range_='observed'``: first..last observed day inclusive (SD2, A).
    ``range_='full_months'``: first day of the first month up to, but not
    including, the first day of the last month (SD2, B).
    ``scope='global'`` uses one range for all series (SD3 option).
    """
    if scope == "series":
        b = daily.groupBy("series_id").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    else:
        # global bounds enter as scalar subqueries: no join, no driver round trip
        lo_all = daily.agg(F.min("date")).scalar()
        hi_all = daily.agg(F.max("date")).scalar()
        b = daily.select("series_id").distinct().select(
            "series_id", lo_all.alias("lo"), hi_all.alias("hi"))
    if range_ == "full_months":
        lo = F.trunc("lo", "month")
        hi = F.date_sub(F.trunc("hi", "month"), 1)
    elif range_ == "observed":
        lo, hi = F.col("lo"), F.col("hi")
    else:
        raise ValueError(f"unknown range {range_!r}")
    return (b.select("series_id", lo.alias("lo"), hi.alias("hi"))
            .where(F.col("lo") <= F.col("hi"))
            .select("series_id", F.explode(date_spine("lo", "hi")).alias("date")))


def _expand_gaps(daily: DataFrame, range_: str = "observed") -> DataFrame:
    """Every observed day followed by the missing days up to the next one.

    One window pass per series (``lead(date)`` → ``sequence`` → ``explode``):
    no spine, no join, and the daily table is computed once. Adds ``_d``
    (the calendar day) and ``_obs`` (``_d`` is the observed day itself).
    """
    w = Window.partitionBy("series_id").orderBy("date")
    whole = Window.partitionBy("series_id")
    staged = daily.select("*", F.lead("date").over(w).alias("_next"),
                          F.min("date").over(whole).alias("_first"),
                          F.max("date").over(whole).alias("_last"))
    start = F.col("date")
    if range_ == "full_months":
        start = F.when(F.col("date") == F.col("_first"), F.trunc("date", "month")).otherwise(start)
    elif range_ != "observed":
        raise ValueError(f"unknown range {range_!r}")
    stop = F.coalesce(F.date_sub("_next", 1), F.col("date"))
    out = staged.select("*", F.explode(date_spine(start, stop)).alias("_d"))
    if range_ == "full_months":  # the last (partial) month is excluded
        out = out.where(F.col("_d") < F.trunc("_last", "month"))
    return out.withColumn("_obs", F.col("_d") == F.col("date"))


def fill_calendar(daily: DataFrame, fill: str = "null", range_: str = "observed",
                  scope: str = "series") -> DataFrame:
    """J1 (+P11): gap-complete series; missing days get null or zero measures.

    ``scope='series'`` (default) completes each series between its own
    bounds in a single window pass (:func:`_expand_gaps`); ``scope='global'``
    uses one range for all series via a spine and a left join. The frame may
    carry fewer measures (e.g. revenue alone); those it has are filled.
    """
    measures = [c for c in MEASURES if c in daily.columns]
    if fill not in ("null", "zero"):
        raise ValueError(f"unknown fill {fill!r}")
    if scope == "global":
        spine = calendar_spine(daily, range_, scope)
        out = spine.join(daily, on=["series_id", "date"], how="left")
        if fill == "zero":
            out = out.select("series_id", "date", *[
                F.coalesce(F.col(c), F.lit(0).cast(daily.schema[c].dataType)).alias(c) for c in measures])
        return out.select("series_id", "date", *measures)
    g = _expand_gaps(daily, range_)
    cols = []
    for c in measures:
        v = F.when(F.col("_obs"), F.col(c))
        if fill == "zero":
            v = F.coalesce(v, F.lit(0).cast(daily.schema[c].dataType))
        cols.append(v.alias(c))
    return g.select("series_id", F.col("_d").alias("date"), *cols)


def missing_days(daily: DataFrame, scope: str = "series") -> DataFrame:
    """Days inside a series' range that have no invoices.

    Per series this is the gap part of :func:`_expand_gaps` (no anti-join);
    the global scope anti-joins the global spine.
    """
    if scope == "global":
        spine = calendar_spine(daily, "observed", scope)
        return spine.join(daily.select("series_id", "date"), on=["series_id", "date"], how="left_anti")
    g = _expand_gaps(daily.select("series_id", "date"))
    return g.where(~F.col("_obs")).select("series_id", F.col("_d").alias("date"))


def month_end_resample(filled: DataFrame, value: str = "revenue") -> DataFrame:
    """A5: month-end totals; months whose days are all empty sum to 0.

    Works on a calendar-completed series, so every month of the range has
    at least one row and appears in the result.
    """
    return (filled.groupBy("series_id", F.last_day("date").alias("month_end"))
            .agg(F.coalesce(F.sum(value), F.lit(0).cast(filled.schema[value].dataType))
                 .alias(value)))


def series_to_double(df: DataFrame, cols=("revenue",)) -> DataFrame:
    """Output projection: exact decimal money columns become double."""
    return df.select(*[F.col(c).cast("double").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


__all__ = ["calendar_spine", "fill_calendar", "missing_days", "month_end_resample",
           "series_to_double"]
