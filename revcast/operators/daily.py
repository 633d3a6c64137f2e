"""Daily roll-ups of invoice lines.

The daily series frame (DM2/DM3) is keyed ``(series_id, date)`` and holds
``purchases, unique_invoices, unique_streams, total_views`` (bigint) and
``revenue`` (exact decimal; cast to double at the output of a query).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ALL_SERIES, MONEY_TYPE, money, slug

MEASURES = ["purchases", "unique_invoices", "unique_streams", "total_views", "revenue"]


class UnknownSeriesError(KeyError):
    """A requested series (country) is not present in the data."""


#: Measures that count distinct values, and the column of the lines they count.
DISTINCT = {"unique_invoices": "invoice_id", "unique_streams": "stream_id"}


def _additive(measures) -> list[Column]:
    """Measures of the lines that add up over any grouping."""
    every = {
        "purchases": F.count(F.lit(1)),
        "total_views": F.sum("times_viewed").cast("bigint"),
        "revenue": F.sum(money("price")),
    }
    return [every[m].alias(m) for m in measures if m in every]


def _merged(measures) -> list[Column]:
    """The same measures, added up from rows that hold parts of them."""
    return [F.sum(m).alias(m) for m in measures if m not in DISTINCT]


def distinct_values(lines: DataFrame, keys: list[str], measures=MEASURES) -> DataFrame:
    """One row per (keys, kind, value): ``kind`` 0 are the values of the first
    distinct measure, which also carry the additive measures, 1 those of the next.

    Such rows can be merged exactly over any subset of the keys and over input
    files (S7). A line becomes one row per distinct measure, whatever the
    number of groupings made from them; equal values of a partition meet before
    the shuffle, and a key's values are spread over all tasks.
    """
    kinds = [m for m in measures if m in DISTINCT]
    sums = [m for m in measures if m not in DISTINCT]
    parts = {"purchases": F.lit(1).cast("bigint"), "total_views": F.col("times_viewed").cast("bigint"), "revenue": money("price")}
    rows = F.array(*[
        F.struct(F.lit(k).cast("tinyint").alias("kind"), F.col(DISTINCT[m]).cast("string").alias("value"),
                 *[(parts[x] if k == 0 else F.lit(None).cast("bigint" if x != "revenue" else MONEY_TYPE)).alias(x) for x in sums])
        for k, m in enumerate(kinds)])
    return regroup_values(lines.select(*keys, F.inline(rows)), [*keys, "kind", "value"], measures)


def regroup_values(values: DataFrame, keys: list[str], measures=MEASURES) -> DataFrame:
    """Rows of ``distinct_values`` merged to fewer keys, or over several inputs."""
    sums = _merged(measures)
    return values.groupBy(*keys).agg(*sums) if sums else values.select(*keys).distinct()


def count_values(values: DataFrame, keys: list[str], measures=MEASURES) -> DataFrame:
    """The measures of ``distinct_values`` rows (distinct by keys, kind, value)."""
    kinds = [m for m in measures if m in DISTINCT]
    counts = [F.count(F.when(F.col("kind") == k, F.col("value"))).alias(m) for k, m in enumerate(kinds)]
    return values.groupBy(*keys).agg(*_merged(measures), *counts).select(*keys, *measures)


def daily_rollup(lines: DataFrame, series: str | None = None,
                 exact_distinct: bool = True) -> DataFrame:
    """A1: one row per day (whole market) or per (series, day).

    ``series`` names a column of ``lines`` (e.g. ``country``); its slug (F5)
    becomes ``series_id``. Without it the single series is ``all``.
    """
    keys = ["date"] if series is None else ["series_id", "date"]
    if series is not None:
        lines = lines.withColumn("series_id", slug(series))
    if exact_distinct:
        out = count_values(distinct_values(lines, keys), keys)
    else:  # A13: HyperLogLog++ sketches
        out = lines.groupBy(*keys).agg(*_additive(MEASURES), *[F.approx_count_distinct(c).alias(m) for m, c in DISTINCT.items()])
    return out.withColumn("series_id", F.lit(ALL_SERIES) if series is None else F.col("series_id")).select("series_id", "date", *MEASURES)


def daily_grouping_sets(lines: DataFrame, series: str = "country",
                        exact_distinct: bool = True, measures=MEASURES) -> DataFrame:
    """A2: the ``all`` series and every per-country series in one pass over the lines.

    The lines are reduced once, to the distinct values of each (country, day);
    ``all`` is merged from those rows, not from the lines. Name the ``measures``
    that are needed: without a distinct one, only sums are shuffled.
    """
    keys = [series, "date"]
    if not exact_distinct:
        agg = (lines.groupingSets([["date"], keys], series, "date")
               .agg(*_additive(measures), *[F.approx_count_distinct(DISTINCT[m]).alias(m) for m in measures if m in DISTINCT],
                    F.grouping(series).alias("_g")))
        sid = F.when(F.col("_g") == 1, F.lit(ALL_SERIES)).otherwise(slug(series))
        return agg.select(sid.alias("series_id"), "date", *measures)
    if any(m in DISTINCT for m in measures):
        return merge_values(distinct_values(lines, keys, measures), series, measures)
    each = lines.groupBy(*keys).agg(*_additive(measures))
    return _with_market(each, each.groupBy("date").agg(*_merged(measures)), series, measures)


def merge_values(values: DataFrame, series: str = "country", measures=MEASURES) -> DataFrame:
    """``all`` and every country from the distinct values of each (country, day)."""
    market = regroup_values(values, ["date", "kind", "value"], measures)
    return _with_market(count_values(values, [series, "date"], measures), count_values(market, ["date"], measures), series, measures)


def _with_market(each: DataFrame, market: DataFrame, series: str, measures) -> DataFrame:
    return each.select(slug(series).alias("series_id"), "date", *measures).unionByName(
        market.select(F.lit(ALL_SERIES).alias("series_id"), "date", *measures))


# ---- A13: kept sketches

#: log2 of the registers of a kept sketch: relative standard error 1.04 / sqrt(2^12) = 1.6 %.
SKETCH_LOG2 = 12
#: Standard errors that an estimate may be off by (tests and ``a13_sketch_rollups`` hold them against exact counts).
SKETCH_ERRORS = 5


def daily_sketches(lines: DataFrame, series: str = "country") -> DataFrame:
    """Per (country, day) the additive measures and an HLL sketch of the
    invoices and of the streams; a sketch has a fixed size, whatever it counts."""
    return lines.groupBy(series, "date").agg(
        *_additive(MEASURES), *[F.hll_sketch_agg(F.col(c).cast("string"), SKETCH_LOG2).alias(f"{m}_sketch") for m, c in DISTINCT.items()])


def sketch_rollup(sketches: DataFrame, period: str, series: str | None = "country") -> DataFrame:
    """Kept sketches united to weeks, months, ... (``date_trunc`` units) of every
    country or (``series=None``) of the whole market; no line is read again."""
    keys = [*([series] if series else []), "period_start"]
    united = sketches.withColumn("period_start", F.to_date(F.date_trunc(period, "date"))).groupBy(*keys).agg(
        *_merged(MEASURES), *[F.hll_sketch_estimate(F.hll_union_agg(f"{m}_sketch")).alias(m) for m in DISTINCT])
    sid = slug(series) if series else F.lit(ALL_SERIES)
    return united.select(sid.alias("series_id"), F.lit(period).alias("period"), "period_start", *MEASURES)


def sketch_error_bound(exact) -> Column:
    """How far an estimate may be from an exact count."""
    return F.ceil(F.lit(SKETCH_ERRORS * 1.04 / 2 ** (SKETCH_LOG2 / 2)) * exact)


def series_revenue(lines: DataFrame, series: str = "country") -> DataFrame:
    """A3: total revenue per country (``pivot_table(index=country, sum)``)."""
    return lines.groupBy(series).agg(F.sum(money("price")).alias("total_revenue"))


def top_series(lines: DataFrame, k: int = 10, series: str = "country") -> DataFrame:
    """W7 + O2 + O3: the k countries with the highest revenue.

    Ties broken by name so the list is deterministic. The per-country totals
    are one row per country, so the global order runs on a tiny frame.
    """
    rev = series_revenue(lines, series)
    w = Window.orderBy(F.desc("total_revenue"), F.asc(series))
    return (rev.withColumn("revenue_rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("revenue_rank") <= k))


def build_series(lines: DataFrame, top_k: int | None = 10, series: str = "country",
                 exact_distinct: bool = True) -> DataFrame:
    """``all`` plus the top-k countries by revenue (SD9), one frame (DM4).

    One grouping-sets pass over the lines; the ranking uses the per-country
    daily rows of that same aggregation (revenue is exact, so the totals
    equal the line totals), ties broken by ``series_id``. J3: the kept
    series are a broadcast semi-join with at most ``top_k`` rows.
    ``top_k=None`` keeps every country.
    """
    d = daily_grouping_sets(lines, series, exact_distinct)
    if top_k is None:
        return d
    return restrict_top(d, top_k)


def restrict_top(d: DataFrame, top_k: int = 10) -> DataFrame:
    """J3 + W7 on a daily frame: keep ``all`` and the ``top_k`` series with
    the largest total revenue (ties by ``series_id``)."""
    totals = (d.where(F.col("series_id") != ALL_SERIES)
              .groupBy("series_id").agg(F.sum("revenue").alias("_total")))
    w = Window.orderBy(F.desc("_total"), F.asc("series_id"))
    keep = (totals.withColumn("_rank", F.row_number().over(w))
            .where(F.col("_rank") <= top_k).select("series_id")
            .unionByName(d.sparkSession.range(1).select(F.lit(ALL_SERIES).alias("series_id"))))
    # keep holds at most top_k + 1 rows by construction: a bounded broadcast
    return d.join(F.broadcast(keep), on="series_id", how="left_semi")


def restrict_series(df: DataFrame, ids: list[str]) -> DataFrame:
    """Keep the listed series (test mode keeps ``all`` and one country)."""
    return df.where(F.col("series_id").isin(ids))


def distinct_series(lines: DataFrame, series: str = "country") -> DataFrame:
    """The distinct countries."""
    return lines.select(series).distinct()


def require_series(lines: DataFrame, name: str, series: str = "country") -> None:
    """J5 / SD8 (API helper): raise if ``name`` is neither ``all`` nor present."""
    if name == ALL_SERIES:
        return
    if lines.where(slug(series) == slug(F.lit(name))).limit(1).isEmpty():
        raise UnknownSeriesError(f"series {name!r} not found")


def series_daily(lines: DataFrame, name: str, series: str = "country") -> DataFrame:
    """J5 + P5: the daily roll-up of one country (or ``all``), by its name or
    slug; an unknown one raises before anything is aggregated. Only its lines
    are grouped."""
    require_series(lines, name, series)
    if name == ALL_SERIES:
        return daily_rollup(lines)
    return daily_rollup(lines.where(slug(series) == slug(F.lit(name))), series)


def date_bounds(daily: DataFrame) -> DataFrame:
    """A10: first and last date of every series."""
    return daily.groupBy("series_id").agg(F.min("date").alias("first_date"),
                                          F.max("date").alias("last_date"))
