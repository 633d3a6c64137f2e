"""Table sources and sinks: Parquet tables, daily-series CSV, snapshots."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.scalar import money

# The driver tables (TESTDATA.md) used by this engine.
DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Parquet keeps filter and column push-down."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Temp views for SQL use (S5): ``SELECT * FROM daily_agg`` etc."""
    for n in names or DRIVER_TABLES:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


# Daily series file layout (DM2 / DM3); either spelling of the stream column.
DAILY_CSV_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("purchases", T.DoubleType()),
    T.StructField("unique_invoices", T.DoubleType()),
    T.StructField("streams", T.DoubleType()),
    T.StructField("total_views", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
])


def read_daily_csv(spark: SparkSession, path: str, series_id: str = "all") -> DataFrame:
    """S3: a daily-series CSV (header row), dates re-parsed, counts re-typed.

    A ``series_id`` column is kept when the file has one; otherwise every
    row gets ``series_id``."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    cols = set(df.columns)
    streams = "unique_streams" if "unique_streams" in cols else "streams"

    def num(c, t):
        return F.col(c).cast("double").cast(t) if c in cols else F.lit(None).cast(t)

    sid = F.col("series_id") if "series_id" in cols else F.lit(series_id)
    return df.select(
        sid.alias("series_id"),
        F.try_to_date(F.col("date"), "yyyy-MM-dd").alias("date"),
        num("purchases", "bigint").alias("purchases"),
        num("unique_invoices", "bigint").alias("unique_invoices"),
        num(streams, "bigint").alias("unique_streams"),
        num("total_views", "bigint").alias("total_views"),
        money("revenue").alias("revenue"),
    )


def write_parquet(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    """Write a result as Parquet, optionally partitioned (e.g. by series)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S4 (CSV flavour): header row, one directory of part files."""
    df.write.mode(mode).option("header", True).csv(path)


def save_table(df: DataFrame, name: str, mode: str = "overwrite", path: str | None = None) -> None:
    """Replace a catalog table (``to_sql(if_exists='replace')``), schema and
    rows. With ``path`` its files go there, else into the warehouse; a result
    that reads the old table needs another path than it."""
    w = df.write.mode(mode)
    (w.option("path", path) if path else w).saveAsTable(name)


def _input_roots(df: DataFrame) -> list[tuple[str, str]]:
    """(path, file pattern) that the plan's file scans were given (not their files)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    roots = set()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths, pattern = leaf.relation().location().rootPaths(), leaf.relation().options().get("pathGlobFilter")
            roots |= {(paths.apply(i).toString(), pattern.get() if pattern.isDefined() else "*") for i in range(paths.size())}
    return sorted(roots)


def input_fingerprint(df: DataFrame) -> str:
    """Fingerprint of a frame's plan and input files (for S7 snapshots).

    The files count with path, length and modification time, hashed in a
    Spark job over their listing; the plan counts in its canonical form, so
    another filter or measure gives another snapshot.
    """
    spark = df.sparkSession
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    h = hashlib.sha256(plan.encode())
    h.update(df.schema.json().encode())
    for root, pattern in _input_roots(df):
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", pattern).load(root)
                 .select("path", "length", "modificationTime"))
        n, size, print_ = files.agg(F.count(F.lit(1)), F.sum("length"),
                                    F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first()
        h.update(f"{root}|{n}|{size}|{print_}".encode())
    return h.hexdigest()[:16]


def snapshot(df: DataFrame, root: str, name: str, rebuild: bool = False) -> DataFrame:
    """Reuse a materialised result if its inputs are unchanged, else build it.

    The snapshot path carries the fingerprint, so new or rewritten input files
    and another plan give a new snapshot; ``rebuild=True`` forces a rewrite
    (``clean=True``).
    """
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/{name}-{input_fingerprint(df)}"
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
