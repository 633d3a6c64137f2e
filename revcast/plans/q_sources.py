"""Queries: sources and sinks on data derived from the driver tables
(S1-S7, P2, P3). Files are written under the shared checkpoint directory."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from ..operators import calendar as cal
from ..session import ensure_checkpoint_dir
from ..sources.invoices import CANONICAL_COLUMNS, incremental_daily, invoice_rejects, read_invoices
from ..sources.tables import read_daily_csv, save_table, snapshot, write_csv
from . import sql_fragments as q
from .q_explore import _variant_frames
from .q_series import daily, lines
from .registry import query


def _export_dir(spark, name: str, sf: str) -> str:
    """A new folder for each run, so that runs never overwrite each other's files."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/exports/{name}-{uuid.uuid4().hex}"


LINES_OUT = """
SELECT country, customer_id, day, invoice, month, price, stream_id, times_viewed, year,
       "date", regexp_replace(invoice, '\\D+', '', 'g') AS invoice_id, year || '-' || month AS source_month
FROM lines"""


@query("s1_json_month_files", q.with_(q.LINES) + LINES_OUT)
def s1_json_month_files(spark, sf):
    """S1 + S2 + S4 + P1-P3: invoice lines written as JSON files, one directory
    per month, each year in one of the three column spellings; read back
    through the validating JSON reader (schema check, spellings harmonised)."""
    out = _export_dir(spark, "json_months", sf)
    v0, v1, v2 = _variant_frames(lines(spark, sf))
    for i, v in enumerate((v0, v1, v2)):
        (v.withColumn("_ym", F.concat_ws("-", "year", "month"))
         .write.mode("overwrite").partitionBy("_ym").json(f"{out}/spelling={i}"))
    back = read_invoices(spark, out, validate=True, json_lines=True)
    # the month folder of each line's own file
    return back.select(*CANONICAL_COLUMNS, "date", "invoice_id",
                       F.regexp_extract("source_file", r"_ym=(\d{4}-\d{2})/", 1).alias("source_month"))


@query("p2_rejects", q.with_(q.LINES) + """
SELECT reason, count(*) AS records FROM (
  SELECT CASE WHEN times_viewed % 7 = 0 THEN 'malformed record' WHEN times_viewed % 5 = 0 THEN 'invalid date' END AS reason FROM lines)
WHERE reason IS NOT NULL GROUP BY reason""")
def p2_rejects(spark, sf):
    """P2 + P14: invoice lines written as JSON, every line with a multiple of 7
    views with a price that is no number and of 5 with a day that no month
    has; the rejects by reason, as the reader reports them."""
    out = _export_dir(spark, "json_rejects", sf)
    views = F.col("times_viewed")
    broken = lines(spark, sf).select(
        *[c for c in CANONICAL_COLUMNS if c not in ("price", "day")],
        F.when(views % 7 == 0, F.lit("abc")).otherwise(F.col("price").cast("string")).alias("_p"),
        F.when(views % 5 == 0, F.lit("32")).otherwise(F.col("day")).alias("day"))
    text = F.to_json(F.struct(*[c for c in broken.columns if c != "_p"]))
    price = F.when(views % 7 == 0, F.concat(F.lit('"'), "_p", F.lit('"'))).otherwise(F.col("_p"))
    (broken.select(F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"price":'), price, F.lit("}")).alias("value"))
     .write.text(out))
    return (invoice_rejects(spark, out, json_lines=True, glob="*.txt").groupBy("reason")
            .agg(F.count(F.lit(1)).alias("records")))


@query("s3_csv_daily_roundtrip", q.with_(q.LINES, q.DAILY) + f"""
SELECT {q.DAILY_OUT} FROM daily""")
def s3_csv_daily_roundtrip(spark, sf):
    """S3 + S4: daily series written as CSV (one directory per series), read
    back with the date re-parsed and counts re-typed."""
    out = _export_dir(spark, "daily_csv", sf)
    d = daily(spark, sf)
    write_csv(d.select(F.col("series_id"), F.col("date").cast("string").alias("date"),
                       "purchases", "unique_invoices", F.col("unique_streams").alias("streams"),
                       "total_views", F.col("revenue").cast("string").alias("revenue")), out)
    return cal.series_to_double(read_daily_csv(spark, out))


@query("s5_sql_daily_agg", q.with_(q.LINES, q.DAILY) + f"""
SELECT {q.DAILY_OUT} FROM daily""")
def s5_sql_daily_agg(spark, sf):
    """S5 + S6: the daily table published as a view and read by SQL
    (``SELECT * FROM daily_agg``)."""
    daily(spark, sf).createOrReplaceTempView("daily_agg")
    return cal.series_to_double(spark.sql("SELECT * FROM daily_agg"))


@query("s7_snapshot_reuse", q.with_(q.LINES, q.DAILY) + f"""
SELECT {q.DAILY_OUT} FROM daily""")
def s7_snapshot_reuse(spark, sf):
    """The daily table materialised once per input fingerprint and
    reused (``rebuild=True`` would force a rewrite)."""
    tag = hashlib.sha1(sf.encode()).hexdigest()[:10]
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshots/{tag}"
    return cal.series_to_double(snapshot(daily(spark, sf), root, "daily"))


@query("s6_table_replace", q.with_(q.LINES, q.DAILY) + f"""
SELECT {q.DAILY_OUT} FROM daily WHERE series_id <> 'all'""")
def s6_table_replace(spark, sf):
    """A catalog table written, then replaced by another result under the same
    name (``if_exists='replace'``) and read by SQL."""
    name, path = f"daily_table_{uuid.uuid4().hex[:12]}", _export_dir(spark, "daily_table", sf)
    d = daily(spark, sf)
    save_table(d.where(F.col("series_id") == "all"), name, path=f"{path}/1")
    save_table(d.where(F.col("series_id") != "all"), name, path=f"{path}/2")
    return cal.series_to_double(spark.sql(f"SELECT * FROM {name}"))


@query("s7_incremental_daily", q.with_(q.LINES, q.DAILY) + f"""
SELECT {q.DAILY_OUT} FROM daily""")
def s7_incremental_daily(spark, sf):
    """Month files (compressed JSON) that arrive in two deliveries; the second
    call reads and rolls up the new files only and merges them with what is kept."""
    out, root = _export_dir(spark, "json_deliveries", sf), _export_dir(spark, "daily_parts", sf)
    first, *rest = _variant_frames(lines(spark, sf))
    first.write.option("compression", "gzip").json(f"{out}/delivery=0")
    incremental_daily(spark, out, root, json_lines=True, glob="*.json.gz")
    for i, v in enumerate(rest, 1):
        v.write.option("compression", "gzip").json(f"{out}/delivery={i}")
    return cal.series_to_double(incremental_daily(spark, out, root, json_lines=True, glob="*.json.gz"))
