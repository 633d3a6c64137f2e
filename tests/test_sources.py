"""JSON month files with every column spelling, schema checks, CSV, snapshots."""

import datetime as dt
import json
import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from revcast.operators import daily as dly
from revcast.functions.scalar import money
from revcast.sources.invoices import (BadRecordsError, SchemaMismatchError, SourceNotFoundError, invoice_rejects, parse_records,
                                      read_invoices, schema_violations)
from revcast.sources.tables import read_daily_csv, snapshot, write_csv

# hand-made invoice lines (values invented); three spellings across files
M1 = [
    {"country": "United Kingdom", "customer_id": 13085, "day": "28", "invoice": "489434",
     "month": "11", "price": 6.95, "stream_id": "85048", "times_viewed": 12, "year": "2017"},
    {"country": "United Kingdom", "customer_id": 13085, "day": "28", "invoice": "489434",
     "month": "11", "price": 3.5, "stream_id": "22041", "times_viewed": 2, "year": "2017"},
    {"country": "France", "customer_id": 12583, "day": "30", "invoice": "489436",
     "month": "11", "price": 10.0, "stream_id": "85048", "times_viewed": 1, "year": "2017"},
]
M2 = [
    {"country": "United Kingdom", "customer_id": None, "day": "28", "invoice": "C489449",
     "month": "11", "total_price": -12.5, "StreamID": "85048", "TimesViewed": 4, "year": "2017"},
]
M3 = [
    {"country": "EIRE", "customer_id": 14911, "day": "3", "invoice": "A506401", "month": "2",
     "price": 100.25, "StreamID": "47566", "times_viewed": 7, "year": "2018"},
]
BAD = [{"country": "France", "customer_id": 1, "day": "1", "invoice": "1", "month": "1",
        "amount": 1.0, "stream_id": "1", "times_viewed": 1, "year": "2018"}]


def _write(d, name, rows):
    with open(os.path.join(d, name), "w") as f:
        json.dump(rows, f)


@pytest.fixture()
def json_dir(tmpdir_path):
    _write(tmpdir_path, "m1.json", M1)
    _write(tmpdir_path, "m2.json", M2)
    _write(tmpdir_path, "m3.json", M3)
    return tmpdir_path


def test_read_harmonises_all_spellings(spark, json_dir):
    df = read_invoices(spark, json_dir)
    rows = {(r.invoice, r.stream_id): r for r in df.collect()}
    assert len(rows) == 5
    credit = rows[("C489449", "85048")]
    assert credit.price == -12.5 and credit.times_viewed == 4 and credit.customer_id is None
    assert credit.invoice_id == "489449" and credit.source_file.endswith("/m2.json")
    eire = rows[("A506401", "47566")]
    assert eire.date == dt.date(2018, 2, 3) and eire.invoice_id == "506401"
    assert set(df.columns) >= {"country", "customer_id", "day", "invoice", "month", "price",
                               "stream_id", "times_viewed", "year", "date", "invoice_id"}


def test_daily_rollup_on_json(spark, json_dir):
    df = read_invoices(spark, json_dir)
    d = {(r.series_id, r.date): r for r in dly.daily_grouping_sets(df).collect()}
    uk = d[("united_kingdom", dt.date(2017, 11, 28))]
    assert uk.purchases == 3 and uk.unique_invoices == 2 and uk.unique_streams == 2
    assert float(uk.revenue) == pytest.approx(6.95 + 3.5 - 12.5)
    whole = d[("all", dt.date(2017, 11, 28))]
    assert whole.purchases == 3
    assert d[("all", dt.date(2017, 11, 30))].unique_streams == 1


def test_schema_mismatch_is_reported(spark, json_dir):
    _write(json_dir, "bad.json", BAD)
    problems = {(r.source_file.rsplit("/", 1)[1], r.problem) for r in schema_violations(spark, json_dir).collect()}
    assert ("bad.json", "unknown column amount") in problems
    assert ("bad.json", "missing column price") in problems
    assert not [p for p in problems if p[0] != "bad.json"]
    with pytest.raises(SchemaMismatchError):
        read_invoices(spark, json_dir)


def test_missing_or_empty_source(spark, tmpdir_path):
    with pytest.raises(SourceNotFoundError):
        read_invoices(spark, os.path.join(tmpdir_path, "nope"))
    with pytest.raises(SourceNotFoundError):
        read_invoices(spark, tmpdir_path)


def test_daily_csv_roundtrip_and_snapshot(spark, json_dir, tmpdir_path):
    df = read_invoices(spark, json_dir)
    daily = dly.daily_rollup(df)
    out = os.path.join(tmpdir_path, "csv")
    write_csv(daily.select(F.col("date").cast("string").alias("date"), "purchases",
                           "unique_invoices", F.col("unique_streams").alias("streams"),
                           "total_views", F.col("revenue").cast("double").alias("revenue")), out)
    back = read_daily_csv(spark, out)
    assert back.count() == daily.count()
    assert {r.date for r in back.collect()} == {r.date for r in daily.collect()}
    root = os.path.join(tmpdir_path, "snap")
    s1 = snapshot(daily, root, "daily")
    s2 = snapshot(daily, root, "daily")
    assert s1.inputFiles() == s2.inputFiles()
    assert sorted(map(tuple, s2.collect())) == sorted(map(tuple, daily.collect()))


def test_rejects_are_counted_and_left_out(spark, tmpdir_path):
    lines = [json.dumps(dict(M2[0])), '{"country": "X", "price": ', json.dumps(dict(M2[0], day="32"))]
    price = "price" if "price" in M2[0] else "total_price"
    lines.append(json.dumps(dict(M2[0], **{price: "abc"})))
    with open(os.path.join(tmpdir_path, "x.json"), "w") as f:
        f.write("\n".join(lines))
    reasons = sorted(r.reason for r in invoice_rejects(spark, tmpdir_path, json_lines=True).collect())
    assert reasons == ["invalid date", "malformed record", "malformed record"]
    with pytest.raises(BadRecordsError, match="3 records"):
        read_invoices(spark, tmpdir_path, json_lines=True)
    left = read_invoices(spark, tmpdir_path, validate=False, json_lines=True)
    assert left.where("date IS NOT NULL").count() == 1


def test_snapshot_follows_content_and_plan(spark, tmpdir_path):
    src, root = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "snap")
    spark.range(3).write.parquet(src)
    assert snapshot(spark.read.parquet(src), root, "n").count() == 3
    assert snapshot(spark.read.parquet(src).where("id > 0"), root, "n").count() == 2
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(src)
    assert snapshot(spark.read.parquet(src), root, "n").count() == 5


def test_money_keeps_the_scale_of_the_source(spark):
    from decimal import Decimal
    df = spark.createDataFrame([(0.004,), (0.004,), (3.131,), (-44990.049,)], "price double")
    assert df.agg(F.sum(money("price"))).first()[0] == Decimal("-44986.910000")


def test_only_new_files_are_read(spark, json_dir, tmpdir_path, monkeypatch):
    from revcast.sources import invoices

    root, read = os.path.join(tmpdir_path, "parts"), []
    whole = invoices.parse_records
    monkeypatch.setattr(invoices, "parse_records", lambda s, path, *a, **k: (read.append(path), whole(s, path, *a, **k))[1])
    src = os.path.join(json_dir, "in")
    os.mkdir(src)
    _write(src, "a 1.json", M1)
    _write(src, "b.json", M2)

    def rows():
        return sorted(tuple(r) for r in invoices.incremental_daily(spark, src, root).collect())

    def want(*parts):
        d = tempfile.mkdtemp(dir=tmpdir_path)
        for k, p in enumerate(parts):
            _write(d, f"{k}.json", p)
        return sorted(tuple(r) for r in dly.daily_grouping_sets(read_invoices(spark, d)).collect())

    assert rows() == want(M1, M2)
    read.clear()
    _write(src, "c.json", M3 + M1[:1])  # its line is also in another file: distinct counts stay exact
    got = rows()
    assert [[os.path.basename(p) for p in r] for r in read] == [["c.json"]]
    assert got == want(M1, M2, M3 + M1[:1])
    read.clear()
    assert rows() == got and read == []
    _write(src, "b.json", M3)  # rewritten
    os.remove(os.path.join(src, "c.json"))
    got = rows()
    assert len(read) == 1 and [os.path.basename(p) for p in read[0]] == ["b.json"]
    assert got == want(M1, M3)


def test_json_is_scanned_once(spark, json_dir):
    plan = read_invoices(spark, json_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan json" not in plan and "parsed-" in plan


def test_table_is_replaced(spark, tmpdir_path):
    from revcast.sources.tables import save_table
    save_table(spark.range(3).toDF("a"), "replaced_table", path=os.path.join(tmpdir_path, "t1"))
    save_table(spark.createDataFrame([("x", 1)], "b string, c int"), "replaced_table", path=os.path.join(tmpdir_path, "t2"))
    assert [tuple(r) for r in spark.sql("SELECT * FROM replaced_table").collect()] == [("x", 1)]
    save_table(spark.createDataFrame([("y", 2)], "b string, c int"), "replaced_table", mode="append")
    assert spark.table("replaced_table").count() == 2
    spark.sql("DROP TABLE replaced_table")


def test_a_filter_on_parsed_records_does_not_parse_them_again(spark, tmpdir_path):
    rows = [dict(M2[0]), dict(M1[0], price="7"), dict(M1[0], price=None, customer_id=2.5), dict(M1[0], day="32"), [1], "text", {},
            dict(M3[0], country=5, invoice=True, month={"a": 1}), dict(M1[0], price=7, times_viewed="1"), dict(M3[0], TimesViewed=[])]
    with open(os.path.join(tmpdir_path, "x.json"), "w") as f:
        f.write("\n".join([*map(json.dumps, rows), "{broken", ""]))
    found = invoice_rejects(spark, tmpdir_path, json_lines=True)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1 and plan.count("$.") == 0
    got = {r.record: r.reason for r in found.collect()}
    bad, day = "malformed record", "invalid date"
    reasons = [None, bad, bad, day, bad, bad, day, day, bad, bad]
    assert got == {**{json.dumps(r): why for r, why in zip(rows, reasons, strict=True) if why}, "{broken": bad}
    line = {r.record: r for r in parse_records(spark, tmpdir_path, json_lines=True).collect()}[json.dumps(rows[7])]
    assert (line.country, line.invoice, line.month, line.stream_id, line.price) == ("5", "true", '{"a":1}', "47566", 100.25)


def test_compressed_files_are_rolled_up_with_one_exchange_of_their_values(spark, tmpdir_path):
    from revcast.sources.invoices import incremental_daily

    src, root = os.path.join(tmpdir_path, "in"), os.path.join(tmpdir_path, "parts")
    lines = spark.createDataFrame([json.dumps(r) for r in M1 + M2 + M3], "string").coalesce(1)
    lines.write.option("compression", "gzip").text(src)
    name = next(n for n in os.listdir(src) if n.endswith(".gz"))
    os.rename(os.path.join(src, name), os.path.join(src, "a.json.gz"))
    daily = incremental_daily(spark, src, root, json_lines=True, glob="*.json.gz")
    plan = daily._jdf.queryExecution().executedPlan().toString()
    keys = {re.sub(r"#\d+", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*value#\d+)", plan)}
    assert keys == {"date, kind, value"}  # the same for a country and for all: Spark makes it once
    _write(tmpdir_path, "plain.json", M1 + M2 + M3)
    want = dly.daily_grouping_sets(read_invoices(spark, os.path.join(tmpdir_path, "plain.json")))
    assert sorted(map(tuple, daily.collect())) == sorted(map(tuple, want.collect()))
