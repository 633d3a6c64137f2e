"""Queries: profiling (step 5), cleaning of series (step 6), scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..operators import calendar as cal
from ..operators import clean_series as cs
from ..operators import daily as dly
from ..operators import profiling as pr
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.invoices import CANONICAL_COLUMNS, harmonise, union_sources
from ..sources.tables import read_table
from . import sql_fragments as q
from .q_series import filled, lines
from .registry import query

# ---------------------------------------------------------------- step 5: profiling


@query("a4_month_revenue", q.with_(q.LINES) + """
SELECT month, CAST(sum(CAST(price AS DECIMAL(28,6))) AS DOUBLE) AS revenue
FROM lines GROUP BY month ORDER BY revenue DESC, month""")
def a4_month_revenue(spark, sf):
    r = pr.revenue_by_month_number(lines(spark, sf))
    return r.select("month", F.col("revenue").cast("double").alias("revenue"))


@query("a6_mean_price_year_month", q.with_(q.LINES) + """
SELECT year, month, CAST(sum(CAST(price AS DECIMAL(28,6))) AS DOUBLE) / count(price) AS price
FROM lines GROUP BY year, month""")
def a6_mean_price_year_month(spark, sf):
    return pr.mean_price_by_year_month(lines(spark, sf))


@query("w6_monthly_lag_diff", q.with_(q.LINES) + """,
m AS (SELECT year, month, CAST(sum(CAST(price AS DECIMAL(28,6))) AS DOUBLE) / count(price) AS price
      FROM lines GROUP BY year, month),
l AS (SELECT *, lag(price, 1) OVER (ORDER BY year, month) AS last30 FROM m)
SELECT year, month, price, last30, last30 - price AS diff FROM l WHERE last30 IS NOT NULL""")
def w6_monthly_lag_diff(spark, sf):
    return pr.monthly_lag_diff(lines(spark, sf))


@query("a14_weekday_profile", q.with_(q.LINES, q.DAILY, q.filled("null")) + """
SELECT series_id, CAST(dayofweek("date") + 1 AS BIGINT) AS day_of_week,
       CAST(sum(revenue) AS DOUBLE) AS revenue, count(revenue) AS days
FROM filled GROUP BY series_id, dayofweek("date")""")
def a14_weekday_profile(spark, sf):
    r = pr.weekday_profile(filled(spark, sf, "null"))
    return cal.series_to_double(r)


@query("a14_monthday_profile", q.with_(q.LINES, q.DAILY, q.filled("null")) + """
SELECT series_id, CAST(dayofmonth("date") AS BIGINT) AS day_of_month,
       CAST(sum(revenue) AS DOUBLE) AS revenue, count(revenue) AS days
FROM filled GROUP BY series_id, dayofmonth("date")""")
def a14_monthday_profile(spark, sf):
    r = pr.monthday_profile(filled(spark, sf, "null"))
    return cal.series_to_double(r)


@query("f8_month_labels", q.with_(q.LINES, q.DAILY, q.filled("null")) + """,
m AS (SELECT series_id, last_day("date") AS month_end, coalesce(sum(revenue), 0) AS revenue
      FROM filled GROUP BY series_id, last_day("date"))
SELECT series_id, month_end, CAST(revenue AS DOUBLE) AS revenue,
       strftime(month_end, '%Y-%m') AS year_month, strftime(month_end, '%B_%Y') AS mon_yr
FROM m""")
def f8_month_labels(spark, sf):
    """F7 + F8 on the A5 month-end series."""
    m = cal.month_end_resample(filled(spark, sf, "null"))
    return cal.series_to_double(pr.month_labels(m))


@query("p6_period_actuals", q.with_(q.LINES) + """
SELECT CAST(sum(CAST(price AS DECIMAL(28,6))) AS DOUBLE) AS revenue
FROM lines WHERE year = '1998' AND month = '08'""")
def p6_period_actuals(spark, sf):
    """Actual revenue of one month (August 1998); the month's date range
    is pushed to the orders scan."""
    from ..sources.invoices import invoice_lines
    start, end = pr.month_range("1998", "08")
    r = pr.period_actuals(invoice_lines(spark, sf, start, end), "1998", "08")
    return r.select(F.col("revenue").cast("double").alias("revenue"))


@query("p14_invoice_profile", q.with_(q.LINES) + """
SELECT 'null_customer_share' AS metric, '' AS key, avg(CAST(customer_id IS NULL AS INTEGER)) AS value FROM lines
UNION ALL
SELECT 'invoice_length', CAST(length(invoice) AS VARCHAR), CAST(count(*) AS DOUBLE) FROM lines GROUP BY length(invoice)
UNION ALL
SELECT 'leading_char', substr(invoice, 1, 1), CAST(count(*) AS DOUBLE) FROM lines
WHERE length(invoice) = 7 GROUP BY substr(invoice, 1, 1)
UNION ALL
SELECT 'country_rows', country, CAST(count(*) AS DOUBLE) FROM lines GROUP BY country""")
def p14_invoice_profile(spark, sf):
    return pr.invoice_profile(lines(spark, sf))


# ---------------------------------------------------------------- scalar functions

@query("f1_parse_date_parts", q.with_(q.LINES) + """,
parts AS (SELECT DISTINCT year, CAST(CAST(month AS INTEGER) AS VARCHAR) AS month_raw,
                 CAST(CAST(day AS INTEGER) AS VARCHAR) AS day_raw FROM lines)
SELECT year, month_raw, day_raw, lpad(month_raw, 2, '0') AS month_padded,
       CAST(strptime(year || '-' || lpad(month_raw, 2, '0') || '-' || lpad(day_raw, 2, '0'), '%Y-%m-%d') AS DATE)
         AS parsed_date
FROM parts""")
def f1_parse_date_parts(spark, sf):
    """F1 + F2: un-padded string parts ('1998', '8', '3') zero-padded and parsed."""
    parts = lines(spark, sf).select(
        "year",
        F.col("month").cast("int").cast("string").alias("month_raw"),
        F.col("day").cast("int").cast("string").alias("day_raw")).distinct()
    return parts.select("year", "month_raw", "day_raw",
                        fx.zero_pad("month_raw").alias("month_padded"),
                        fx.date_from_parts("year", "month_raw", "day_raw").alias("parsed_date"))


@query("f13_f15_formats", """
SELECT o_orderkey, round(sqrt(CAST(o_totalprice AS DOUBLE))) AS rounded_rmse,
       lpad(CAST(o_orderkey // 3600 AS VARCHAR), 3, '0') || ':' || lpad(CAST((o_orderkey % 3600) // 60 AS VARCHAR), 2, '0')
         || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS runtime,
       'sl-' || o_orderstatus || '-' || replace(CAST(o_custkey AS VARCHAR) || '.1', '.', '_') AS model_name
FROM orders""")
def f13_f15_formats(spark, sf):
    """F13 + F14 + F15: rounded root of a mean square, seconds as HHH:MM:SS and a
    model name with the version's dots replaced, over the orders table."""
    return read_table(spark, sf, "orders").select(
        "o_orderkey", fx.rounded_rmse(F.col("o_totalprice").cast("double")).alias("rounded_rmse"),
        fx.hms_duration("o_orderkey").alias("runtime"),
        F.concat_ws("-", F.lit("sl"), "o_orderstatus",
                    fx.version_tag(F.concat(F.col("o_custkey").cast("string"), F.lit(".1")))).alias("model_name"))


@query("f3_f6_invoice_strings", q.with_(q.LINES) + """
SELECT DISTINCT invoice,
       regexp_replace(invoice, '\\D+', '', 'g') AS invoice_id,
       trim(invoice, 'AC') AS invoice_stripped,
       CAST(length(invoice) AS BIGINT) AS invoice_length,
       substr(invoice, 1, 1) AS first_char
FROM lines""")
def f3_f6_invoice_strings(spark, sf):
    """F3 (digits only), F4 (strip A/C at both ends), F6 (length, first char)."""
    inv = lines(spark, sf).select("invoice").distinct()
    return inv.select("invoice",
                      fx.clean_invoice("invoice").alias("invoice_id"),
                      fx.strip_invoice_letters("invoice").alias("invoice_stripped"),
                      F.length("invoice").cast("bigint").alias("invoice_length"),
                      F.substring("invoice", 1, 1).alias("first_char"))


@query("f5_slug_country", q.with_(q.LINES) + f"""
SELECT DISTINCT country, {q.SLUG_COUNTRY} AS series_id,
       'ts-' || {q.SLUG_COUNTRY} || '.csv' AS file_name
FROM lines""")
def f5_slug_country(spark, sf):
    """country slug, and the per-series file name built from it."""
    c = lines(spark, sf).select("country").distinct()
    return c.select("country", fx.slug("country").alias("series_id"),
                    F.concat(F.lit("ts-"), fx.slug("country"), F.lit(".csv")).alias("file_name"))


# ---------------------------------------------------------------- sources, projections

def _variant_frames(lines_df):
    """Three month-file spellings of the same invoice lines (P1 input)."""
    base = lines_df.select(*CANONICAL_COLUMNS)
    yr = F.col("year").cast("int") % 3
    v0 = base.where(yr == 0)
    v1 = base.where(yr == 1).withColumnsRenamed(
        {"price": "total_price", "stream_id": "StreamID", "times_viewed": "TimesViewed"})
    v2 = base.where(yr == 2).withColumnsRenamed({"stream_id": "StreamID"})
    return v0, v1, v2


@query("p1_harmonise_spellings", q.with_(q.LINES) + """
SELECT country, customer_id, day, invoice, month, price, stream_id, times_viewed, year,
       "date", regexp_replace(invoice, '\\D+', '', 'g') AS invoice_id
FROM lines""")
def p1_harmonise_spellings(spark, sf):
    """P1 + U1: lines split into three spelling variants (by year), unioned by
    name with missing columns, then harmonised back to canonical columns."""
    v0, v1, v2 = _variant_frames(lines(spark, sf))
    return harmonise(union_sources(v0, v1, v2))


@query("p4_training_frame", q.with_(q.LINES, q.DAILY, q.filled("null")) + """
SELECT series_id, "date" AS ds, CAST(revenue AS DOUBLE) AS y FROM filled""")
def p4_training_frame(spark, sf):
    """P4 (DM6): keep (ds, y) of every series."""
    f = filled(spark, sf, "null")
    return f.select("series_id", F.col("date").alias("ds"), F.col("revenue").cast("double").alias("y"))


@query("p5_country_filter", q.with_(q.LINES, q.DAILY) + f"""
SELECT {q.DAILY_OUT} FROM daily WHERE series_id = 'nation_3'""")
def p5_country_filter(spark, sf):
    """P5 + J5: the daily series of one country, which must be there."""
    return cal.series_to_double(dly.series_daily(lines(spark, sf), "nation_3"))


@query("p7_time_cut", q.with_(q.LINES, q.DAILY, q.filled("null")) + """
SELECT series_id, "date" AS ds, CAST(revenue AS DOUBLE) AS y FROM filled WHERE "date" < DATE '2000-01-01'""")
def p7_time_cut(spark, sf):
    """Training rows strictly before the forecast origin."""
    f = filled(spark, sf, "null").where(F.col("date") < F.lit("2000-01-01").cast("date"))
    return f.select("series_id", F.col("date").alias("ds"), F.col("revenue").cast("double").alias("y"))


@query("p10_head_rows", q.with_(q.LINES, q.DAILY, q.filled("null")) + """
SELECT "date" AS ds, CAST(revenue AS DOUBLE) AS y FROM filled WHERE series_id = 'all'
ORDER BY "date" LIMIT 11""")
def p10_head_rows(spark, sf):
    """P10: the label slice ``.loc[:10]`` of the market series (11 rows)."""
    f = filled(spark, sf, "null").where(F.col("series_id") == "all")
    return f.orderBy("date").limit(11).select(F.col("date").alias("ds"),
                                              F.col("revenue").cast("double").alias("y"))


@query("o4_last_30_rows", q.with_(q.LINES, q.DAILY, q.filled("null")) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY "date" DESC) AS rn FROM filled)
SELECT series_id, "date", CAST(revenue AS DOUBLE) AS revenue FROM r WHERE rn <= 30""")
def o4_last_30_rows(spark, sf):
    """``tail(30)`` of every series (top-k per series by date)."""
    w = Window.partitionBy("series_id").orderBy(F.desc("date"))
    f = filled(spark, sf, "null").withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= 30)
    return f.select("series_id", "date", F.col("revenue").cast("double").alias("revenue"))


@query("u1_union_by_name", q.with_(q.LINES) + f"""
SELECT 'all' AS series_id, "date",""" + q.MEASURES.replace(
    "sum(CAST(price AS DECIMAL(28,6))) AS revenue",
    "CAST(sum(CAST(price AS DECIMAL(28,6))) AS DOUBLE) AS revenue") + """
FROM clines GROUP BY "date" """)
def u1_union_by_name(spark, sf):
    """Credit-note lines and sale lines read as two sources with different
    column order, unioned by name (duplicates kept), rolled up per day."""
    li = lines(spark, sf)
    credit = li.where(F.col("invoice").startswith("C")).select(*reversed(li.columns))
    sales = li.where(~F.col("invoice").startswith("C"))
    return cal.series_to_double(dly.daily_rollup(union_sources(sales, credit)))


# ---------------------------------------------------------------- step 6: cleaning

@query("a7_series_quantiles", q.with_(q.LINES, q.DAILY, q.filled("null")) + f""",
a AS (SELECT series_id, list_sort(list(CAST(revenue AS DOUBLE)) FILTER (WHERE revenue IS NOT NULL)) AS _a
      FROM filled GROUP BY series_id)
SELECT series_id, {q.spark_percentile('_a', 0.25)} AS q25, {q.spark_percentile('_a', 0.75)} AS q75 FROM a""")
def a7_series_quantiles(spark, sf):
    """Exact 25 % / 75 % quantiles of daily revenue per series, gaps skipped."""
    return cs.series_quantiles(filled(spark, sf, "null"))


#: Shares that the kept sketches are asked for, and the error allowed: three times that of 99 % confidence.
PRICE_SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)
_WITHIN = ", ".join(f"TRUE AS q{int(p * 100):02d}_within" for p in PRICE_SHARES)


@query("a7_kept_sketches", q.with_(q.LINES) + f"""
SELECT {q.SLUG_COUNTRY} AS series_id, count(price) AS n, {_WITHIN} FROM clines WHERE price IS NOT NULL GROUP BY country
UNION ALL SELECT 'all', count(price), {_WITHIN} FROM clines WHERE price IS NOT NULL""")
def a7_kept_sketches(spark, sf):
    """A7 at scale: KLL sketches of line prices kept by country and month, written
    once and merged to countries and the market; the exact rank of every
    quantile is held against its share (``*_within``: inside the error)."""
    named = cut_lineage(lines(spark, sf).select(fx.slug("country").alias("series_id"), F.trunc("date", "month").alias("month"), "price"))
    kept = f"{ensure_checkpoint_dir(spark).rstrip('/')}/price-sketches-{uuid.uuid4().hex}"
    cs.quantile_sketches(named, "price", ["series_id", "month"]).write.parquet(kept)
    sketches = spark.read.parquet(kept)
    both = F.explode(F.array("series_id", F.lit("all"))).alias("series_id")
    merged = cs.merge_sketches(sketches.select(both, "n", "sketch"), ["series_id"])
    return cs.rank_within(named.select(both, "price"), "price", cs.sketched_quantiles(merged, PRICE_SHARES), ["series_id"],
                          PRICE_SHARES, 3 * cs.KLL_ERROR)


@query("p8_quantile_mask", q.with_(q.LINES, q.DAILY, q.filled("null"), q.masked()) + """
SELECT series_id, "date", CAST(revenue AS DOUBLE) AS revenue, y_masked FROM masked""")
def p8_quantile_mask(spark, sf):
    """Revenue outside the inclusive [q25, q75] band becomes null."""
    f = cal.series_to_double(filled(spark, sf, "null"))
    return cs.quantile_mask(f, out="y_masked").select("series_id", "date", "revenue", "y_masked")


@query("f11_interpolate_time", q.with_(q.LINES, q.DAILY, q.filled("null"), q.interpolated()) + """
SELECT series_id, "date", CAST(revenue AS DOUBLE) AS revenue, y_interp FROM interp""")
def f11_interpolate_time(spark, sf):
    """F11 + W10: time interpolation of the gap days of every series."""
    f = cal.series_to_double(filled(spark, sf, "null"))
    return cs.interpolate_time(f, out="y_interp").select("series_id", "date", "revenue", "y_interp")


@query("f12_interpolate_masked_inside", q.with_(
        q.LINES, q.DAILY, q.filled("null"), q.masked(),
        q.interpolated("masked", "y_masked", fill_trailing=False)) + """
SELECT series_id, "date", y_masked, y_interp FROM interp""")
def f12_interpolate_masked_inside(spark, sf):
    """piecewise-linear fill of the masked series inside the data only
    (leading and trailing gaps stay null)."""
    f = cal.series_to_double(filled(spark, sf, "null"))
    m = cs.quantile_mask(f, out="y_masked")
    return (cs.interpolate_time(m, "y_masked", out="y_interp", fill_trailing=False)
            .select("series_id", "date", "y_masked", "y_interp"))


DECOMP_SQL = q.with_(q.LINES, q.DAILY, q.filled("null"), q.interpolated()) + """,
base AS (
  SELECT series_id, "date", y_interp AS y,
    (lag(y_interp, 3) OVER w + lag(y_interp, 2) OVER w + lag(y_interp, 1) OVER w + y_interp
     + lead(y_interp, 1) OVER w + lead(y_interp, 2) OVER w + lead(y_interp, 3) OVER w) / 7.0 AS trend,
    CAST((row_number() OVER w - 1) % 7 AS BIGINT) AS phase
  FROM interp WINDOW w AS (PARTITION BY series_id ORDER BY "date")
),
pm AS (
  SELECT series_id, phase,
         list_reduce(list(y - trend ORDER BY "date") FILTER (WHERE y - trend IS NOT NULL),
                     lambda a, b: a + b) / count(y - trend) AS _pm
  FROM base GROUP BY series_id, phase
),
centre AS (
  SELECT series_id, list_reduce(list(_pm ORDER BY phase), lambda a, b: a + b) / count(_pm) AS _mean_pm
  FROM pm GROUP BY series_id
),
cen AS (
  SELECT pm.series_id, pm.phase, pm._pm - centre._mean_pm AS seasonal
  FROM pm JOIN centre ON pm.series_id = centre.series_id
)
SELECT b.series_id, b."date", b.y, b.trend, b.phase, c.seasonal, b.y - b.trend - c.seasonal AS resid
FROM base b LEFT JOIN cen c ON b.series_id = c.series_id AND b.phase = c.phase"""


@query("m17_decompose_additive", DECOMP_SQL)
def m17_decompose_additive(spark, sf):
    """M17 (F11 → W8 → W9): additive weekly decomposition of every series."""
    f = cal.series_to_double(filled(spark, sf, "null"))
    i = cs.interpolate_time(f, out="y_interp")
    return cs.decompose_additive(i, "y_interp", period=7)
