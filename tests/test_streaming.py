"""Streaming daily windows equal the batch roll-up on closed days."""

from pyspark.sql import functions as F

from revcast.streaming import stream as st

from .conftest import SF_SMALL


def test_stream_equals_batch_on_closed_days(spark):
    schema = spark.read.parquet(f"{SF_SMALL}/events.parquet").schema
    s = st.file_stream(spark, SF_SMALL, schema, glob="events.parquet")
    d = st.daily_window_rollup(s, "ts", "event_type", "value", distinct="user_id")
    import uuid
    out = st.run_available_now(d, f"test-events-{uuid.uuid4().hex[:8]}")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    batch = ev.groupBy(F.col("event_type").alias("series_id"), F.to_date("ts").alias("date")).agg(
        F.count("*").alias("b_rows"), F.sum("value").alias("b_value"))
    j = out.join(batch, ["series_id", "date"])
    assert j.count() == out.count() > 0
    assert j.where((F.col("rows") != F.col("b_rows"))
                   | (F.abs(F.col("value") - F.col("b_value")) > 1e-6)).isEmpty()
    # only days before the watermark are emitted (closed windows)
    last = ev.agg(F.max(F.to_date("ts"))).first()[0]
    assert out.agg(F.max("date")).first()[0] < last


def test_files_in_any_order_lose_no_line(spark, tmpdir_path):
    import uuid

    from revcast.plans.q_models import invoice_stream_sums
    files = f"{tmpdir_path}/lines"
    spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").repartition(4, "l_orderkey").write.parquet(files)
    want = {(r.country, r.date): (r["rows"], r.revenue) for r in invoice_stream_sums(
        spark, SF_SMALL, files, f"t-{uuid.uuid4().hex}").collect()}
    got = {(r.country, r.date): (r["rows"], r.revenue) for r in invoice_stream_sums(
        spark, SF_SMALL, files, f"t-{uuid.uuid4().hex}", max_files=1).collect()}
    assert got == want
    assert sum(n for n, _ in got.values()) == spark.read.parquet(files).count()


def test_json_invoice_files_as_a_stream(spark, tmpdir_path):
    import json
    import uuid

    from revcast.sources.invoices import RAW_SCHEMA, harmonise
    from revcast.streaming import stream as st
    line = {"country": "EIRE", "customer_id": 1, "invoice": "C5", "month": "2", "year": "2018", "StreamID": "9", "TimesViewed": 2}
    for k, day in enumerate(("28", "3", "28")):
        with open(f"{tmpdir_path}/m{k}.json", "w") as f:
            json.dump([dict(line, day=day, total_price=1.125)], f)
    s = harmonise(st.file_stream(spark, tmpdir_path, RAW_SCHEMA, fmt="json", max_files=1))
    got = st.additive_sums(s, ["country", "date"], {"price": "price", "views": "times_viewed"}, f"t-{uuid.uuid4().hex}").collect()
    assert {(str(r.date), r["rows"], r.price, r["views"]) for r in got} == {("2018-02-28", 2, 2.25, 4), ("2018-02-03", 1, 1.125, 2)}


def test_folders_are_merged_level_by_level_and_replayed(spark, tmpdir_path, monkeypatch):
    import uuid

    monkeypatch.setattr(st, "FAN", 2)
    rows = [(f"k{i % 3}" if i % 5 else None, i % 4, i, f"v{i % 7}" if i % 6 else None) for i in range(110)]
    for k in range(11):
        spark.createDataFrame(rows[10 * k:10 * k + 10], "a string, b int, x long, v string").coalesce(1).write.mode("append").parquet(f"{tmpdir_path}/in")
    table = spark.read.parquet(f"{tmpdir_path}/in")
    s = st.file_stream(spark, f"{tmpdir_path}/in", table.schema, max_files=1)
    name = f"t-{uuid.uuid4().hex}"
    want = {tuple(r) for r in table.groupBy("a", "b").agg(F.count("*"), F.sum("x"), F.count_distinct("v")).collect()}

    def answer():
        return {tuple(r) for r in st.additive_sums(s, ["a", "b"], {"x": "x"}, name, {"values": "v"}).collect()}

    assert answer() == want
    out = f"{st.stream_dir(spark, name)}/sums"
    live, merged = st.sink_folders(spark, out)
    assert live == [(3, 7), (1, 9), (0, 10)] and not merged  # 8 + 2 + 1 batches
    # a replayed batch: its folders are written again, what was merged is not read twice
    again = st.read_sink(spark, out)
    st.write_and_merge(again.limit(3), out, 7, lambda d: d)
    assert st.sink_folders(spark, out) == (live, [])
    assert answer() == want
    # a run that died before it marked a merged folder as finished leaves its parts to be read
    st.write_and_merge(again.limit(0), out, 11, lambda d: d)
    p, fs = st._file_system(spark, f"{out}/L2-11/_SUCCESS")
    fs.delete(p, False)
    assert (2, 11) not in st.sink_folders(spark, out)[0]


def test_forecasts_are_issued_before_the_days_they_are_scored_on(spark):
    from revcast.plans import QUERIES
    rows = QUERIES["st3_stream_scoring"](spark, SF_SMALL).collect()
    days = [r.date for r in spark.read.parquet(f"{SF_SMALL}/events.parquet").select(F.to_date("ts").alias("date")).distinct().collect()]
    cutoff = min(days) + (max(days) - min(days)) // 2
    assert rows and min(r.date for r in rows) > cutoff
    assert all((r.forecast is None) == ((r.date - cutoff).days > 30) for r in rows)
