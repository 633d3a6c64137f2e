"""Exploratory roll-ups and data-quality profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import money, month_label, year_month


def revenue_by_month_number(lines: DataFrame) -> DataFrame:
    """A4: revenue by calendar month number across all years, largest first."""
    return (lines.groupBy("month").agg(F.sum(money("price")).alias("revenue"))
            .orderBy(F.desc("revenue"), F.asc("month")))


def mean_price_by_year_month(lines: DataFrame) -> DataFrame:
    """Mean line price per (year, month); exact sum / count."""
    return lines.groupBy("year", "month").agg(
        (F.sum(money("price")).cast("double") / F.count("price")).alias("price"))


def monthly_lag_diff(lines: DataFrame) -> DataFrame:
    """A6 + W6 + P12: monthly mean price, previous month's value and the
    difference previous - current; the first month (no previous) is dropped.

    The window runs over one row per month (tiny), ordered by (year, month).
    """
    m = (lines.groupBy("year", "month")
         .agg((F.sum(money("price")).cast("double") / F.count("price")).alias("price")))
    w = Window.orderBy("year", "month")
    return (m.withColumn("last30", F.lag("price", 1).over(w))
            .where(F.col("last30").isNotNull())
            .withColumn("diff", F.col("last30") - F.col("price")))


def weekday_profile(daily: DataFrame) -> DataFrame:
    """Revenue and day count by day of week (1 = Sunday ... 7 = Saturday)."""
    return (daily.groupBy("series_id", F.dayofweek("date").cast("bigint").alias("day_of_week"))
            .agg(F.sum("revenue").alias("revenue"), F.count("revenue").alias("days")))


def monthday_profile(daily: DataFrame) -> DataFrame:
    """Revenue and day count by day of month."""
    return (daily.groupBy("series_id", F.dayofmonth("date").cast("bigint").alias("day_of_month"))
            .agg(F.sum("revenue").alias("revenue"), F.count("revenue").alias("days")))


def month_labels(monthly: DataFrame, date_col: str = "month_end") -> DataFrame:
    """F7 + F8: 'yyyy-MM' and 'November_2017' labels of month-end rows."""
    return monthly.withColumn("year_month", year_month(date_col)) \
                  .withColumn("mon_yr", month_label(date_col))


def month_range(year: str, month: str) -> tuple[str, str]:
    """First day of the month and of the next month (``yyyy-MM-dd``)."""
    y, m = int(year), int(month)
    ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
    return f"{y:04d}-{m:02d}-01", f"{ny:04d}-{nm:02d}-01"


def period_actuals(lines: DataFrame, year: str, month: str) -> DataFrame:
    """Total revenue of one (year, month): conjunctive filter, then sum.

    Pair it with a source restricted to :func:`month_range` so the date
    predicate is pushed to the scan; the string filter keeps it exact."""
    return (lines.where((F.col("year") == year) & (F.col("month") == month))
            .agg(F.sum(money("price")).alias("revenue")))


def invoice_profile(lines: DataFrame) -> DataFrame:
    """P14 + A9 + F6: one long table of data-quality facts from one scan.

    ``metric`` is one of ``null_customer_share`` (``value`` = share of lines
    without a customer), ``invoice_length`` (``key`` = length, ``value`` =
    lines), ``leading_char`` (``key`` = first character of 7-character
    invoices) and ``country_rows`` (``key`` = country). One grouping-sets
    aggregation computes all four, partially aggregated before the shuffle.
    """
    tagged = lines.select(
        F.col("customer_id").isNull().cast("int").alias("_null_cust"),
        F.length("invoice").cast("string").alias("_len"),
        F.when(F.length("invoice") == 7, F.substring("invoice", 1, 1)).alias("_lead"),
        F.col("country").alias("_country"))
    agg = (tagged.groupingSets([[], ["_len"], ["_lead"], ["_country"]], "_len", "_lead", "_country")
           .agg(F.count(F.lit(1)).alias("_n"), F.avg("_null_cust").alias("_share"),
                F.grouping_id().alias("_gid")))
    # grouping_id bits: _len=4, _lead=2, _country=1 (1 = rolled up)
    metric = (F.when(F.col("_gid") == 7, "null_customer_share")
              .when(F.col("_gid") == 3, "invoice_length")
              .when(F.col("_gid") == 5, "leading_char")
              .otherwise("country_rows"))
    key = (F.when(F.col("_gid") == 7, F.lit(""))
           .when(F.col("_gid") == 3, F.col("_len"))
           .when(F.col("_gid") == 5, F.col("_lead"))
           .otherwise(F.col("_country")))
    value = F.when(F.col("_gid") == 7, F.col("_share")).otherwise(F.col("_n").cast("double"))
    return (agg.where((F.col("_gid") != 5) | F.col("_lead").isNotNull())
            .select(metric.alias("metric"), key.alias("key"), value.alias("value")))
