"""Queries: invoice lines, daily roll-ups, calendar completion, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import ALL_SERIES
from ..operators import calendar as cal
from ..operators import daily as dly
from ..operators import features as fe
from ..session import cut_lineage
from ..sources.invoices import invoice_lines
from . import sql_fragments as q
from .registry import query


def lines(spark, sf):
    return invoice_lines(spark, sf)


def daily(spark, sf, measures=dly.MEASURES):
    return dly.daily_grouping_sets(lines(spark, sf), measures=measures)


def filled(spark, sf, fill="null", range_="observed", measures=dly.MEASURES):
    return cal.fill_calendar(daily(spark, sf, measures), fill=fill, range_=range_)


#: What the window features read.
FEATURE_INPUTS = ["unique_invoices", "total_views", "revenue"]


def _daily_out(df):
    return cal.series_to_double(df)


# ---------------------------------------------------------------- flagship

FLAGSHIP_SQL = q.with_(q.LINES, q.DAILY, q.filled("zero"), q.window_features()) + f""",
kept AS (SELECT * FROM feats WHERE {q.FEATURE_SUM} > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY "date" DESC) AS rn FROM kept)
SELECT {q.FEATURES_OUT} FROM ranked WHERE rn > 30"""


@query("w5_training_matrix", FLAGSHIP_SQL)
def training_matrix(spark, sf):
    """Flagship: 30-day forward revenue and its lag features per series per day.

    lines → A2 → J1 (zero fill) → W1-W4 → P9 → W5.
    """
    return fe.features_to_double(fe.revenue_features(filled(spark, sf, "zero", measures=FEATURE_INPUTS), training=True))


# ---------------------------------------------------------------- step 2: daily

@query("a1_daily_rollup_all", q.with_(q.LINES) + """
SELECT 'all' AS series_id, "date",""" + q.MEASURES.replace(
    "sum(CAST(price AS DECIMAL(28,6))) AS revenue",
    "CAST(sum(CAST(price AS DECIMAL(28,6))) AS DOUBLE) AS revenue") + """
FROM clines GROUP BY "date" """)
def a1_daily_rollup_all(spark, sf):
    return _daily_out(dly.daily_rollup(lines(spark, sf)))


@query("a1_daily_rollup_country", q.with_(q.LINES) + f"""
SELECT {q.SLUG_COUNTRY} AS series_id, "date",""" + q.MEASURES.replace(
    "sum(CAST(price AS DECIMAL(28,6))) AS revenue",
    "CAST(sum(CAST(price AS DECIMAL(28,6))) AS DOUBLE) AS revenue") + f"""
FROM clines GROUP BY {q.SLUG_COUNTRY}, "date" """)
def a1_daily_rollup_country(spark, sf):
    return _daily_out(dly.daily_rollup(lines(spark, sf), "country"))


@query("a2_daily_grouping_sets", q.with_(q.LINES, q.DAILY) + f"""
SELECT {q.DAILY_OUT} FROM daily""")
def a2_daily_grouping_sets(spark, sf):
    return _daily_out(daily(spark, sf))


@query("a3_country_revenue", q.with_(q.LINES) + """
SELECT country, CAST(sum(CAST(price AS DECIMAL(28,6))) AS DOUBLE) AS total_revenue
FROM lines GROUP BY country""")
def a3_country_revenue(spark, sf):
    r = dly.series_revenue(lines(spark, sf))
    return r.select("country", F.col("total_revenue").cast("double").alias("total_revenue"))


TOP10_SQL = q.with_(q.LINES) + """,
rev AS (SELECT country, sum(CAST(price AS DECIMAL(28,6))) AS total_revenue FROM lines GROUP BY country),
ranked AS (SELECT country, total_revenue,
                  CAST(row_number() OVER (ORDER BY total_revenue DESC, country ASC) AS BIGINT) AS revenue_rank
           FROM rev)"""


@query("o3_top10_countries", TOP10_SQL + """
SELECT country, CAST(total_revenue AS DOUBLE) AS total_revenue, revenue_rank
FROM ranked WHERE revenue_rank <= 10""")
def o3_top10_countries(spark, sf):
    t = dly.top_series(lines(spark, sf), 10)
    return t.select("country", F.col("total_revenue").cast("double").alias("total_revenue"),
                    "revenue_rank")


@query("j3_top10_daily", q.with_(q.LINES, q.DAILY) + f""",
totals AS (SELECT series_id, sum(revenue) AS total FROM daily WHERE series_id <> 'all' GROUP BY series_id),
top AS (SELECT series_id FROM (SELECT series_id, row_number() OVER (ORDER BY total DESC, series_id ASC) AS rk
                               FROM totals) t WHERE rk <= 10)
SELECT {q.DAILY_OUT} FROM daily
WHERE series_id = 'all' OR series_id IN (SELECT series_id FROM top)""")
def j3_top10_daily(spark, sf):
    """SD9 + J3: ``all`` plus the top-10 countries by revenue, from one pass
    over the lines (the daily table is materialised once, then ranked and
    filtered)."""
    return _daily_out(dly.restrict_top(cut_lineage(daily(spark, sf)), 10))


@query("u5_test_mode_series", q.with_(q.LINES, q.DAILY) + f"""
SELECT {q.DAILY_OUT} FROM daily WHERE series_id IN ('all', 'nation_1')""")
def u5_test_mode_series(spark, sf):
    """Test mode keeps ``all`` and one country (here nation_1)."""
    return _daily_out(dly.restrict_series(daily(spark, sf), [ALL_SERIES, "nation_1"]))


@query("a8_distinct_countries", q.with_(q.LINES) + """
SELECT DISTINCT country FROM lines""")
def a8_distinct_countries(spark, sf):
    return dly.distinct_series(lines(spark, sf))


@query("a10_series_date_bounds", q.with_(q.LINES, q.DAILY) + """
SELECT series_id, min("date") AS first_date, max("date") AS last_date FROM daily GROUP BY series_id""")
def a10_series_date_bounds(spark, sf):
    return dly.date_bounds(daily(spark, sf, ["revenue"]))


@query("o1_all_series_sorted", q.with_(q.LINES, q.DAILY) + f"""
SELECT {q.DAILY_OUT} FROM daily WHERE series_id = 'all' ORDER BY "date" """)
def o1_all_series_sorted(spark, sf):
    """O1: the market series ordered by date (order only at the output)."""
    d = daily(spark, sf).where(F.col("series_id") == ALL_SERIES).orderBy("date")
    return _daily_out(d)


# ---------------------------------------------------------------- step 3: calendar

@query("j1_gap_fill_null", q.with_(q.LINES, q.DAILY, q.filled("null")) + f"""
SELECT {q.DAILY_OUT} FROM filled""")
def j1_gap_fill_null(spark, sf):
    return _daily_out(filled(spark, sf, "null"))


@query("p11_gap_fill_zero", q.with_(q.LINES, q.DAILY, q.filled("zero")) + f"""
SELECT {q.DAILY_OUT} FROM filled""")
def p11_gap_fill_zero(spark, sf):
    return _daily_out(filled(spark, sf, "zero"))


@query("sd2_full_month_calendar", q.with_(q.LINES, q.DAILY, q.filled("zero", "full_months")) + f"""
SELECT {q.DAILY_OUT} FROM filled""")
def sd2_full_month_calendar(spark, sf):
    """SD2 variant B: whole months from the first, the last month excluded."""
    return _daily_out(filled(spark, sf, "zero", "full_months"))


@query("j2_missing_days", q.with_(q.LINES, q.DAILY, q.filled("null")) + """
SELECT s.series_id, s."date" FROM filled_spine s
WHERE NOT EXISTS (SELECT 1 FROM daily d WHERE d.series_id = s.series_id AND d."date" = s."date")""")
def j2_missing_days(spark, sf):
    return cal.missing_days(daily(spark, sf, ["revenue"]))


@query("a5_month_end_resample", q.with_(q.LINES, q.DAILY, q.filled("null")) + """
SELECT series_id, last_day("date") AS month_end,
       CAST(coalesce(sum(revenue), 0) AS DOUBLE) AS revenue
FROM filled GROUP BY series_id, last_day("date")""")
def a5_month_end_resample(spark, sf):
    return _daily_out(cal.month_end_resample(filled(spark, sf, "null", measures=["revenue"])))


@query("p12_drop_gap_rows", q.with_(q.LINES, q.DAILY, q.filled("null")) + f"""
SELECT {q.DAILY_OUT} FROM filled
WHERE purchases IS NOT NULL AND unique_invoices IS NOT NULL AND unique_streams IS NOT NULL
  AND total_views IS NOT NULL AND revenue IS NOT NULL""")
def p12_drop_gap_rows(spark, sf):
    """``dropna()`` on the null-filled series gives back the observed days."""
    return _daily_out(filled(spark, sf, "null").na.drop())


# ---------------------------------------------------------------- step 4: features

def _feature_sql(fill: str, extra: str = "", training: bool = False) -> str:
    base = q.with_(q.LINES, q.DAILY, q.filled(fill), q.window_features())
    if training:
        return base + f""",
kept AS (SELECT * FROM feats WHERE {q.FEATURE_SUM} > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY "date" DESC) AS rn FROM kept)
SELECT {q.FEATURES_OUT} FROM ranked WHERE rn > 30"""
    return base + f"""
SELECT {q.FEATURES_OUT} FROM feats {extra}"""


@query("w1_w4_window_features_null", _feature_sql("null"))
def w1_w4_window_features_null(spark, sf):
    """W1-W4 + W2 target on the null-gap series (SD10: means skip gaps)."""
    return fe.features_to_double(fe.with_window_features(filled(spark, sf, "null", measures=FEATURE_INPUTS)))


@query("w1_w4_window_features_zero", _feature_sql("zero"))
def w1_w4_window_features_zero(spark, sf):
    """W1-W4 + W2 target on the zero-gap series (SD10: means count gaps as 0)."""
    return fe.features_to_double(fe.with_window_features(filled(spark, sf, "zero", measures=FEATURE_INPUTS)))


@query("p9_positive_feature_rows", _feature_sql("zero", f"WHERE {q.FEATURE_SUM} > 0"))
def p9_positive_feature_rows(spark, sf):
    """P9 without the W5 trim: the prediction-time (``training=False``) matrix."""
    return fe.features_to_double(fe.revenue_features(filled(spark, sf, "zero", measures=FEATURE_INPUTS), training=False))


@query("w5_training_matrix_null", _feature_sql("null", training=True))
def w5_training_matrix_null(spark, sf):
    """Variant-A gaps (null) through the same P9 + W5 pipeline."""
    return fe.features_to_double(fe.revenue_features(filled(spark, sf, "null", measures=FEATURE_INPUTS), training=True))


@query("j4_band_join_previous_year", q.with_(q.LINES, q.DAILY, q.filled("zero")) + """,
probes AS (SELECT series_id, "date" FROM daily)
SELECT p.series_id, p."date",
       CAST(coalesce(sum(f.revenue), 0) AS DOUBLE) AS band_sum
FROM probes p LEFT JOIN filled f
  ON f.series_id = p.series_id
 AND f."date" BETWEEN p."date" - INTERVAL 365 DAY AND p."date" - INTERVAL 336 DAY
GROUP BY p.series_id, p."date" """)
def j4_band_join_previous_year(spark, sf):
    """J4 general path: probe table joined to the series on a date band.

    Probes are the observed days; the band [d-365, d-336] is W3's frame.
    """
    # probes and series from one pass over the lines; only the revenue is read
    d = cut_lineage(daily(spark, sf, ["revenue"]))
    out = fe.band_join_features(d.select("series_id", "date"), cal.fill_calendar(d, "zero"),
                                -365, -336)
    return out.select("series_id", "date", F.col("band_sum").cast("double").alias("band_sum"))
