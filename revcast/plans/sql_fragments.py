"""DuckDB oracle SQL building blocks (common table expressions).

Each registered query's oracle is an independent ANSI/DuckDB statement over
the driver tables; these fragments keep the shared stages (invoice lines,
daily roll-up, calendar fill, window features) written once.
"""

# invoice lines from the star schema (mirrors sources.invoices.invoice_lines)
LINES = r"""
lines AS (
  SELECT n.n_name AS country,
         o.o_custkey AS customer_id,
         (CASE l.l_returnflag WHEN 'R' THEN 'C' WHEN 'A' THEN 'A' ELSE '' END)
           || lpad(CAST(o.o_orderkey AS VARCHAR),
                   CAST(greatest(6, length(CAST(o.o_orderkey AS VARCHAR))) AS INTEGER), '0') AS invoice,
         l.l_extendedprice AS price,
         CAST(l.l_partkey AS VARCHAR) AS stream_id,
         CAST(l.l_quantity AS BIGINT) AS times_viewed,
         CAST(o.o_orderdate AS DATE) AS "date",
         strftime(CAST(o.o_orderdate AS DATE), '%Y') AS year,
         strftime(CAST(o.o_orderdate AS DATE), '%m') AS month,
         strftime(CAST(o.o_orderdate AS DATE), '%d') AS day
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
),
clines AS (
  SELECT *, regexp_replace(invoice, '\D+', '', 'g') AS invoice_id FROM lines
)"""

SLUG_COUNTRY = r"regexp_replace(lower(country), '\s+', '_', 'g')"

MEASURES = """
         count(*) AS purchases,
         count(DISTINCT invoice_id) AS unique_invoices,
         count(DISTINCT stream_id) AS unique_streams,
         CAST(sum(times_viewed) AS BIGINT) AS total_views,
         sum(CAST(price AS DECIMAL(28,6))) AS revenue"""

# A2: all + every country in one grouping-sets aggregation
DAILY = f"""
daily AS (
  SELECT CASE WHEN grouping(country) = 1 THEN 'all' ELSE {SLUG_COUNTRY} END AS series_id,
         "date",{MEASURES}
  FROM clines
  GROUP BY GROUPING SETS (("date"), (country, "date"))
)"""


def filled(fill: str = "null", range_: str = "observed", src: str = "daily",
           name: str = "filled") -> str:
    """J1 calendar completion of ``src`` (series_id, date, measures)."""
    if range_ == "observed":
        lo, hi = "min(\"date\")", "max(\"date\")"
    else:  # full months, last month excluded
        lo = "date_trunc('month', min(\"date\"))"
        hi = "date_trunc('month', max(\"date\")) - INTERVAL 1 DAY"
    if fill == "zero":
        m = """coalesce(d.purchases, 0) AS purchases,
               coalesce(d.unique_invoices, 0) AS unique_invoices,
               coalesce(d.unique_streams, 0) AS unique_streams,
               coalesce(d.total_views, 0) AS total_views,
               coalesce(d.revenue, 0) AS revenue"""
    else:
        m = "d.purchases, d.unique_invoices, d.unique_streams, d.total_views, d.revenue"
    return f"""
{name}_bounds AS (
  SELECT series_id, CAST({lo} AS DATE) AS lo, CAST({hi} AS DATE) AS hi
  FROM {src} GROUP BY series_id
),
{name}_spine AS (
  SELECT series_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS "date"
  FROM {name}_bounds WHERE lo <= hi
),
{name} AS (
  SELECT s.series_id, s."date", {m}
  FROM {name}_spine s LEFT JOIN {src} d ON s.series_id = d.series_id AND s."date" = d."date"
)"""


DAYNUM = "datediff('day', DATE '1970-01-01', \"date\")"


def window_features(src: str = "filled", name: str = "feats") -> str:
    """W1-W4 (+ target) over calendar-day RANGE frames."""
    w = "PARTITION BY series_id ORDER BY dn"
    prev = ",\n".join(
        f"    coalesce(sum(revenue) OVER ({w} RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING), 0) AS previous_{n}"
        for n in (7, 14, 28, 70))
    return f"""
{name} AS (
  SELECT series_id, "date",
{prev},
    coalesce(sum(revenue) OVER ({w} RANGE BETWEEN 365 PRECEDING AND 336 PRECEDING), 0) AS previous_year,
    coalesce(CAST(sum(unique_invoices) OVER ({w} RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS DOUBLE)
             / nullif(count(unique_invoices) OVER ({w} RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING), 0), 0.0)
             AS recent_invoices,
    coalesce(CAST(sum(total_views) OVER ({w} RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS DOUBLE)
             / nullif(count(total_views) OVER ({w} RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING), 0), 0.0)
             AS recent_views,
    coalesce(sum(revenue) OVER ({w} RANGE BETWEEN CURRENT ROW AND 29 FOLLOWING), 0) AS target
  FROM (SELECT *, {DAYNUM} AS dn FROM {src}) t
)"""


FEATURE_SUM = ("CAST(previous_7 AS DOUBLE) + CAST(previous_14 AS DOUBLE) + CAST(previous_28 AS DOUBLE)"
               " + CAST(previous_70 AS DOUBLE) + CAST(previous_year AS DOUBLE)"
               " + CAST(recent_invoices AS DOUBLE) + CAST(recent_views AS DOUBLE)")

FEATURES_OUT = """series_id, "date",
       CAST(previous_7 AS DOUBLE) AS previous_7, CAST(previous_14 AS DOUBLE) AS previous_14,
       CAST(previous_28 AS DOUBLE) AS previous_28, CAST(previous_70 AS DOUBLE) AS previous_70,
       CAST(previous_year AS DOUBLE) AS previous_year,
       CAST(recent_invoices AS DOUBLE) AS recent_invoices, CAST(recent_views AS DOUBLE) AS recent_views,
       CAST(target AS DOUBLE) AS target"""

DAILY_OUT = """series_id, "date", purchases, unique_invoices, unique_streams, total_views,
       CAST(revenue AS DOUBLE) AS revenue"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def spark_percentile(arr: str, p: float) -> str:
    """Exact percentile with the interpolation Spark's ``percentile`` uses:
    position = (n - 1) * p; (hi - pos) * x[lo] + (pos - lo) * x[hi]."""
    pos = f"((len({arr}) - 1) * {p})"
    lo = f"{arr}[CAST(floor({pos}) AS BIGINT) + 1]"
    hi = f"{arr}[CAST(ceil({pos}) AS BIGINT) + 1]"
    return (f"(CASE WHEN floor({pos}) = ceil({pos}) OR {lo} = {hi} THEN {lo} "
            f"ELSE (ceil({pos}) - {pos}) * {lo} + ({pos} - floor({pos})) * {hi} END)")


def interpolated(src: str = "filled", value: str = "revenue", name: str = "interp",
                 fill_trailing: bool = True, keys: str = "series_id") -> str:
    """F11/F12 over ``src``: adds column ``y_interp``."""
    trailing = "_y0" if fill_trailing else "CAST(NULL AS DOUBLE)"
    return f"""
{name}_k AS (
  SELECT *, CAST({value} AS DOUBLE) AS _x, {DAYNUM} AS _dn FROM {src}
),
{name}_s AS (
  SELECT *,
    last_value(_x IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY "date"
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _y0,
    last_value(CASE WHEN _x IS NOT NULL THEN _dn END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY "date"
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _d0,
    last_value(_x IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY "date" DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _y1,
    last_value(CASE WHEN _x IS NOT NULL THEN _dn END IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY "date" DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _d1
  FROM {name}_k
),
{name} AS (
  SELECT *, CASE WHEN _x IS NOT NULL THEN _x
                 WHEN _y0 IS NULL THEN CAST(NULL AS DOUBLE)
                 WHEN _y1 IS NULL THEN {trailing}
                 ELSE _y0 + (_y1 - _y0) * (_dn - _d0) / (_d1 - _d0) END AS y_interp
  FROM {name}_s
)"""


def masked(src: str = "filled", value: str = "revenue", name: str = "masked",
           lo: float = 0.25, hi: float = 0.75, keys: str = "series_id") -> str:
    """P8 over ``src``: adds ``y_masked`` (values outside [q_lo, q_hi] nulled)."""
    return f"""
{name}_q AS (
  SELECT {keys}, list_sort(list(CAST({value} AS DOUBLE)) FILTER (WHERE {value} IS NOT NULL)) AS _a
  FROM {src} GROUP BY {keys}
),
{name}_b AS (
  SELECT {keys}, {spark_percentile('_a', lo)} AS _qlo, {spark_percentile('_a', hi)} AS _qhi FROM {name}_q
),
{name} AS (
  SELECT s.*, CASE WHEN CAST(s.{value} AS DOUBLE) BETWEEN b._qlo AND b._qhi
                   THEN CAST(s.{value} AS DOUBLE) END AS y_masked
  FROM {src} s JOIN {name}_b b USING ({keys})
)"""
