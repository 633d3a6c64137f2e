"""Structured Streaming jobs (ST1-ST3, A13).

* ST1: a directory of arriving files read as a stream (fixed schema,
  incremental through the checkpoint; ``availableNow`` processes what is
  there and stops, replacing the "if processed, load, else compute" cache).
* ST2: daily tumbling roll-up with a watermark; distinct counts with
  HyperLogLog++ (exact distincts are not allowed on streams). Append mode
  emits a day once the watermark has passed it.
* ST3: stream–static scoring: each micro-batch of closed days is joined to
  a forecast table and its error rows written idempotently (keyed by batch
  id), so a replayed batch after a failure overwrites instead of duplicating.

Checkpoints and sinks live under the cluster's ``spark.checkpoint.dir``
(shared storage), never on a machine-local disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.scalar import MONEY_TYPE
from ..session import ensure_checkpoint_dir


def stream_dir(spark: SparkSession, name: str) -> str:
    """A sub-directory of the shared checkpoint directory for one job."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/streams/{name}"


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                glob: str | None = None, max_files: int | None = None) -> DataFrame:
    """ST1: a file-source stream over ``path`` with a fixed schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if fmt == "json":
        r = r.option("multiLine", True)
    return r.load(path)


def daily_window_rollup(stream: DataFrame, ts: str, key: str, value: str,
                        distinct: str | None = None, watermark: str = "1 day",
                        money: bool = False) -> DataFrame:
    """ST2 + A13: per (day, key): rows, Σ value, approximate distinct count.

    ``money=True`` sums the value as an exact decimal at its own scale (output double).

    ``timestamp_ntz`` event times are cast to ``timestamp`` (watermarks need
    it); rows later than the watermark are dropped by the engine, state for
    closed days is evicted, so state stays bounded by the watermark span.
    """
    ev = stream.withColumn("_ts", F.col(ts).cast("timestamp"))
    v = F.col(value).cast(MONEY_TYPE) if money else F.col(value)
    aggs = [F.count(F.lit(1)).alias("rows"), F.sum(v).alias(value)]
    if distinct:
        aggs.append(F.approx_count_distinct(distinct).alias(f"approx_distinct_{distinct}"))
    out = (ev.withWatermark("_ts", watermark)
           .groupBy(F.window("_ts", "1 day").alias("w"), F.col(key).alias("series_id"))
           .agg(*aggs))
    rest = [F.col(c).cast("double").alias(c) if (money and c == value) else F.col(c)
            for c in out.columns if c not in ("w", "series_id")]
    return out.select("series_id", F.to_date(F.col("w.start")).alias("date"), *rest)


def run_available_now(df: DataFrame, name: str, mode: str = "append",
                      partition_by: str | None = None) -> DataFrame:
    """Run a streaming frame to completion (``availableNow``) into a Parquet
    sink under the shared checkpoint directory; return the sink as a table."""
    spark = df.sparkSession
    base = stream_dir(spark, name)
    w = (df.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", f"{base}/_checkpoint")
         .option("path", f"{base}/out")
         .trigger(availableNow=True))
    if partition_by:
        w = w.partitionBy(partition_by)
    q = w.start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


#: Finished folders of a sink that are merged into one folder of the next level.
FAN = 16


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def sink_folders(spark: SparkSession, out: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(live, merged) folders of a sink, as (level, last batch).

    A folder of level L holds the ``FAN ** L`` batches up to its last one; it
    counts once Spark's committer has marked it finished. A folder whose
    batches lie in a finished folder of a higher level is merged: no reader
    takes it, and it may be deleted.
    """
    p, fs = _file_system(spark, out)
    if not fs.exists(p):
        return [], []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    found = sorted((tuple(int(x) for x in n[1:].split("-")) for n in names
                    if n.startswith("L") and fs.exists(_file_system(spark, f"{out}/{n}/_SUCCESS")[0])), reverse=True)
    live, merged = [], []
    for level, last in found:
        inside = any(high > level and end - FAN ** high < last <= end for high, end in live)
        (merged if inside else live).append((level, last))
    return live, merged


def read_sink(spark: SparkSession, out: str) -> DataFrame:
    """All rows of a sink's live folders (the rows of one key may lie in several)."""
    return spark.read.parquet(*[f"{out}/L{level}-{last}" for level, last in sink_folders(spark, out)[0]])


def write_and_merge(rows: DataFrame, out: str, batch_id: int, merge) -> None:
    """Write a batch as a folder of level 0; each ``FAN`` folders of a level become one of the next by ``merge``.

    Every row is written again once a level, and a sink of n batches has at
    most ``FAN`` folders a level, log n levels. What is merged follows from the
    batch id alone, and folders are deleted only after the merged one is
    finished, so a batch may be replayed after any failure.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{out}/L0-{batch_id}")
    # a replayed batch goes on above the highest folder that it had finished
    finished = [have for have, last in sink_folders(spark, out)[0] if last == batch_id]
    level = max(finished, default=0) + 1
    while finished and (batch_id + 1) % FAN ** level == 0:
        step = FAN ** (level - 1)
        parts = [f"{out}/L{level - 1}-{k}" for k in range(batch_id - FAN ** level + step, batch_id + 1, step)]
        merge(spark.read.parquet(*parts)).write.mode("overwrite").parquet(f"{out}/L{level}-{batch_id}")
        level += 1
    for old, last in sink_folders(spark, out)[1]:
        p, fs = _file_system(spark, f"{out}/L{old}-{last}")
        fs.delete(p, True)


def additive_sums(stream: DataFrame, keys: list[str], sums: dict, name: str, distinct: dict | None = None) -> DataFrame:
    """ST1: exact sums and distinct counts over everything that arrives, in whatever order.

    Files of line items are not sorted by date, so a watermark would drop the
    old days of a later file. Counts, sums and the distinct values of each
    micro-batch are written as a folder instead (a replayed batch overwrites
    its own), folders are merged level by level, and what is left is added up
    when read. No state is kept, however long it runs.

    ``sums`` maps an output name to the column that is summed, ``distinct`` one
    to the column whose distinct values (null: none) are counted.
    """
    spark = stream.sparkSession
    base = stream_dir(spark, name)
    out, values = f"{base}/sums", f"{base}/values"
    distinct = distinct or {}

    def added(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*keys).agg(F.sum("rows").alias("rows"), *[F.sum(n).alias(n) for n in sums])

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        write_and_merge(batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(n) for n, c in sums.items()]),
                        out, batch_id, added)
        if distinct:
            each = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(c).cast("string").alias("value")) for n, c in distinct.items()]))
            write_and_merge(batch.select(*keys, each.alias("__v")).select(*keys, "__v.*").where("value IS NOT NULL").distinct(),
                            values, batch_id, lambda parts: parts.distinct())

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    total = added(read_sink(spark, out))
    if not distinct:
        return total
    counts = read_sink(spark, values).distinct().groupBy(*keys).agg(
        *[F.count_if(F.col("measure") == n).alias(n) for n in distinct])
    both = total.alias("t").join(counts.alias("c"), F.expr(" AND ".join(f"t.`{k}` <=> c.`{k}`" for k in keys)), "left")
    return both.select("t.*", *[F.coalesce(F.col(f"c.{n}"), F.lit(0)).alias(n) for n in distinct])


def score_stream(daily_stream: DataFrame, forecasts: DataFrame, name: str,
                 value: str = "value", pred: str = "yhat") -> DataFrame:
    """ST3: micro-batches of closed days joined to a static forecast table
    (keys ``series_id, date``); error rows land in ``<sink>/batch=<id>``.

    Each batch overwrites only its own partition, so a batch replayed after
    a failure replaces its earlier output (exactly-once result).
    """
    spark = daily_stream.sparkSession
    base = stream_dir(spark, name)
    out = f"{base}/scored"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        scored = (batch.join(forecasts, on=["series_id", "date"], how="left")
                  .select("series_id", "date", F.col(value).cast("double").alias("actual"),
                          F.col(pred).cast("double").alias("forecast"))
                  .withColumn("error", F.col("actual") - F.col("forecast")))
        scored.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (daily_stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    try:
        return spark.read.parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # no batch produced output
        return spark.createDataFrame([], "series_id string, date date, actual double, "
                                         "forecast double, error double, batch int")
