"""Invoice-line sources: raw JSON month files and the driver's star schema.

Invoice lines (DM1) have the canonical columns
``country, customer_id, day, invoice, month, price, stream_id, times_viewed, year``
plus the derived ``date`` and ``invoice_id`` (digits only).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..functions.scalar import clean_invoice, date_from_parts
from ..operators.daily import distinct_values, merge_values, regroup_values
from ..session import ensure_checkpoint_dir
from .tables import read_table


class SchemaMismatchError(ValueError):
    """A source file's columns cannot be matched to the canonical columns."""


class BadRecordsError(ValueError):
    """Source files hold records that are no invoice lines."""


class SourceNotFoundError(FileNotFoundError):
    """The source directory does not exist or holds no input files."""


# The canonical column set and the alternative spellings
# that month files use for three of the columns.
CANONICAL_COLUMNS = ["country", "customer_id", "day", "invoice", "month",
                     "price", "stream_id", "times_viewed", "year"]
SPELLINGS = {
    "price": ["price", "total_price"],
    "stream_id": ["stream_id", "StreamID"],
    "times_viewed": ["times_viewed", "TimesViewed"],
}

_TYPES = {
    "country": T.StringType(), "customer_id": T.LongType(), "day": T.StringType(),
    "invoice": T.StringType(), "month": T.StringType(), "price": T.DoubleType(),
    "stream_id": T.StringType(), "times_viewed": T.LongType(), "year": T.StringType(),
}

# Read schema: the union of every spelling, so one scan covers mixed files.
RAW_SCHEMA = T.StructType(
    [T.StructField(name, _TYPES[canon], True)
     for canon in CANONICAL_COLUMNS
     for name in SPELLINGS.get(canon, [canon])]
)

INVOICE_SCHEMA = T.StructType(
    [T.StructField(c, _TYPES[c], True) for c in CANONICAL_COLUMNS]
    + [T.StructField("date", T.DateType(), True),
       T.StructField("invoice_id", T.StringType(), True)]
)


def harmonise(raw: DataFrame) -> DataFrame:
    """P1 + F1 + F3: canonical names, parsed date and digits-only invoice id.

    Works on a frame that carries any subset of the spellings; columns it
    does not carry are treated as null.
    """
    present = set(raw.columns)

    def pick(canon: str):
        names = [n for n in SPELLINGS.get(canon, [canon]) if n in present]
        if not names:
            return F.lit(None).cast(_TYPES[canon])
        cols = [F.col(n).cast(_TYPES[canon]) for n in names]
        return cols[0] if len(cols) == 1 else F.coalesce(*cols)

    extra = [c for c in raw.columns if c in ("source_file",)]
    out = raw.select(*[pick(c).alias(c) for c in CANONICAL_COLUMNS], *extra)
    return (out
            .withColumn("date", date_from_parts("year", "month", "day"))
            .withColumn("invoice_id", clean_invoice("invoice")))


def _check_exists(spark: SparkSession, path: str, glob: str = "*.json") -> None:
    """The source must exist and hold at least one input file."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob) \
            .option("recursiveFileLookup", "true").load(path).select("path")
    except AnalysisException as e:  # PATH_NOT_FOUND and friends
        raise SourceNotFoundError(f"source {path!r} does not exist") from e
    if files.isEmpty():
        raise SourceNotFoundError(f"source {path!r} holds no {glob.lstrip('*')} files")


def parse_records(spark: SparkSession, path, json_lines: bool = False, glob: str = "*.json") -> DataFrame:
    """Every record of the JSON files, parsed once: ``source_file``, the typed
    canonical columns, ``fields`` (its fields and their JSON types), ``reason``
    (null for an invoice line) and, with a reason, the ``record`` itself.

    Files are JSON arrays of records (``json_lines=True``: one record per line)
    in any spelling. A record is malformed if it is no JSON object or a field
    has another type; broken JSON of a whole file is one malformed record.
    Number columns take JSON numbers only, text columns any value. Of a record
    all columns are taken at once, and filters on them stay above the parsing.
    """
    text = (spark.read.option("wholetext", not json_lines).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
            .text(path).select("value", F.col("_metadata.file_path").alias("source_file")).where(F.trim("value") != ""))
    if json_lines:
        rec = text.select("source_file", F.col("value").alias("_text"), F.try_parse_json("value").alias("_r"))
    else:
        whole = text.select("source_file", F.col("value").alias("_text"), F.try_parse_json("value").alias("_v"))
        rec = whole.select("source_file", "_text", F.explode(F.coalesce(
            F.try_variant_get("_v", "$", "array<variant>"), F.array("_v"))).alias("_r"))
        rec = rec.select("source_file", F.coalesce(F.to_json("_r"), "_text").alias("_text"), "_r")
    taken = {n: "variant" if _TYPES[c].simpleString() in _JSON_NUMBERS else "string" for c in CANONICAL_COLUMNS for n in SPELLINGS.get(c, [c])}
    struct = f"struct<{', '.join(f'{n}: {kind}' for n, kind in taken.items())}>"
    rec = rec.select("source_file", "_text", F.schema_of_variant("_r").alias("fields"), F.try_variant_get("_r", "$", struct).alias("_c"))
    numbers = [n for n, kind in taken.items() if kind == "variant"]
    rec = rec.select("source_file", "_text", "fields", *[F.col(f"_c.{n}").alias(n) for n in taken],
                     *[F.schema_of_variant(f"_c.{n}").alias(f"_type_{n}") for n in numbers])
    values, wrong = {}, F.lit(False)
    for canon in CANONICAL_COLUMNS:
        kind, found = _TYPES[canon].simpleString(), []
        for name in SPELLINGS.get(canon, [canon]):
            value = F.col(name)
            if kind in _JSON_NUMBERS:
                json_type = F.col(f"_type_{name}")
                value = F.when(json_type.rlike(_JSON_NUMBERS[kind]), F.try_variant_get(name, "$", kind))
                wrong = wrong | F.coalesce((json_type != "VOID") & value.isNull(), F.lit(False))
            found.append(value)
        values[canon] = F.coalesce(*found)
    out = rec.select("source_file", "fields", *[v.alias(c) for c, v in values.items()],
                     (~F.coalesce(F.col("fields").startswith("OBJECT<"), F.lit(False)) | wrong).alias("_wrong"), "_text")
    reason = F.when(F.col("_wrong"), "malformed record").when(
        date_from_parts("year", "month", "day").isNull(), "invalid date")
    out = out.withColumn("reason", reason).select(
        "source_file", "fields", *CANONICAL_COLUMNS, "reason", F.when(F.col("reason").isNotNull(), F.col("_text")).alias("record"))
    # unpacking a list of one: a filter pushed below it would parse a record again for each of its uses
    return out.select(F.inline(F.array(F.struct(*out.columns))))


#: JSON types (of ``schema_of_variant``) that a number column takes.
_JSON_NUMBERS = {"bigint": "^BIGINT", "double": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"}


def _violations(parsed: DataFrame) -> DataFrame:
    known = [n for c in CANONICAL_COLUMNS for n in SPELLINGS.get(c, [c])]
    # fields that a file fills at least once; records of a file share few field lists
    pairs = parsed.where(F.col("fields").startswith("OBJECT<")).select("source_file", "fields").distinct().select(
        "source_file", F.explode(F.regexp_extract_all("fields", F.lit("[<,] ?`?([^`:<>,]+)`?: (?!VOID)"), F.lit(1))).alias("name"))
    found = pairs.groupBy("source_file").agg(F.collect_set("name").alias("names"))
    files = parsed.select("source_file").distinct().join(found, "source_file", "left").withColumn("names", F.coalesce("names", F.array()))
    missing = [F.when(~F.arrays_overlap("names", F.array(*map(F.lit, SPELLINGS.get(c, [c])))), F.lit(f"missing column {c}"))
               for c in CANONICAL_COLUMNS if c != "customer_id"]  # customer_id may be null on every line of a file
    unknown = F.transform(F.array_except("names", F.array(*map(F.lit, known))), lambda n: F.concat(F.lit("unknown column "), n))
    return files.select("source_file", F.explode(F.concat(unknown, F.array_compact(F.array(*missing)))).alias("problem"))


def schema_violations(spark: SparkSession, path, json_lines: bool = False, glob: str = "*.json") -> DataFrame:
    """One row per (file, problem) whose columns do not map to the canonical set.

    Problems are ``unknown column <name>`` and ``missing column <canonical>``; a
    column that a file never fills is missing.
    """
    return _violations(parse_records(spark, path, json_lines, glob))


def invoice_rejects(spark: SparkSession, path, json_lines: bool = False, glob: str = "*.json") -> DataFrame:
    """P2 + P14: ``(source_file, reason, record)`` of every record that cannot be
    an invoice line: broken JSON or a value of another type, or no valid date."""
    return parse_records(spark, path, json_lines, glob).where("reason IS NOT NULL").select("source_file", "reason", "record")


def read_invoices(spark: SparkSession, path, validate: bool = True, json_lines: bool = False, glob: str = "*.json") -> DataFrame:
    """S1 + S2 + P1-P3: read JSON month files (a directory, or files) as invoice lines.

    ``source_file`` is the full path of the file a line came from. Validation
    raises on columns that do not match and on records that cannot be read;
    without it malformed records (:func:`invoice_rejects`) are left out. The
    files are read and parsed once: columns, rejects and lines all come from
    the parsed records, which are kept in the checkpoint folder.
    """
    if isinstance(path, str):
        _check_exists(spark, path, glob)
    parsed = parse_records(spark, path, json_lines, glob)
    if validate:
        kept = f"{ensure_checkpoint_dir(spark).rstrip('/')}/parsed-{uuid.uuid4().hex}"
        parsed.write.parquet(kept)
        parsed = spark.read.schema(parsed.schema).parquet(kept)
        total, named = _violations(parsed).agg(F.count(F.lit(1)), F.min(F.struct("source_file", "problem"))).first()
        if total:
            raise SchemaMismatchError(f"columns could not be matched: {total} problems, the first in "
                                      f"{named.source_file}: {named.problem} (schema_violations() has all)")
        total, named = parsed.where("reason IS NOT NULL").agg(F.count(F.lit(1)), F.min(F.struct("source_file", "reason"))).first()
        if total:
            raise BadRecordsError(f"{total} records could not be read, the first in {named.source_file}: "
                                  f"{named.reason} (invoice_rejects() has all)")
    lines = parsed.where(F.coalesce(F.col("reason") != "malformed record", F.lit(True)))
    return harmonise(lines.select("source_file", *CANONICAL_COLUMNS))


# ---- S7: roll up only what is new


def _files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(file, path, source_file): a key of every input file, from its path, size
    and time; its path, and the path as the reader's metadata spell it."""
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return meta.select(F.sha2(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")), 256).alias("file"), "path",
                       F.col("_metadata.file_path").alias("source_file"))


def _kept(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def incremental_daily(spark: SparkSession, source: str, root: str, json_lines: bool = False, glob: str = "*.json",
                      series: str = "country") -> DataFrame:
    """The daily roll-up of a folder of month files, reading only files that
    are new or changed since the last call.

    Every file is reduced to its distinct values by country and day (exact under
    merging, :func:`distinct_values`) and kept below ``root``; the answer is
    merged from the parts of the files that are there now, so a file that is
    gone or rewritten no longer counts. Files may be compressed (``glob`` with
    their ending); while lines are dealt out a file is known by a number. A part counts only once its batch stands
    in the manifest: what a failed run leaves behind is never read.
    """
    _check_exists(spark, source, glob)
    root = root.rstrip("/")
    now = _files(spark, source, glob)
    done = _kept(spark, f"{root}/manifest", "file string, path string, batch string")
    new = [tuple(r) for r in now.join(done, "file", "left_anti").collect()]  # the paths that the next read is given
    if new:
        batch = uuid.uuid4().hex
        named = spark.createDataFrame([(k, *f) for k, f in enumerate(new)], "no int, file string, path string, source_file string")
        # one row for each file, which the driver holds already
        lines = read_invoices(spark, [p for _, p, _ in new], json_lines=json_lines, glob=glob).join(F.broadcast(named.select("no", "source_file")), "source_file")
        parts = distinct_values(lines, ["no", series, "date"]).join(F.broadcast(named.select("no", "file")), "no").drop("no")
        parts.withColumn("batch", F.lit(batch)).write.partitionBy("batch", "file").mode("append").parquet(f"{root}/parts")
        named.select("file", "path", F.lit(batch).alias("batch")).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    valid = _kept(spark, f"{root}/manifest", "file string, path string, batch string").join(now.select("file"), "file", "left_semi")
    parts = spark.read.parquet(f"{root}/parts").join(valid.select("file", "batch"), ["file", "batch"], "left_semi")
    # dealt so that a country's values and those of all countries meet in the same tasks: one exchange of the parts
    dealt = parts.repartition("date", "kind", "value")
    return merge_values(regroup_values(dealt, [series, "date", "kind", "value"]), series)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Union of invoice frames with columns aligned by name (duplicates kept)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# Fixed value: TPC-H return flags map onto invoice letters
# 'R' (returned) -> 'C' (credit note), 'A' -> 'A', anything else -> no letter.
RETURN_FLAG_LETTER = {"R": "C", "A": "A"}


def invoice_lines(spark: SparkSession, sf_dir: str, start: str | None = None,
                  end: str | None = None) -> DataFrame:
    """Invoice lines derived from the driver's star schema.

    ``lineitem ⋈ orders ⋈ customer ⋈ nation``: country = nation name,
    customer = order customer, invoice = order key (with a C/A letter from
    the return flag), stream = part, views = quantity, price = extended price,
    date = order date. Orders are joined to their dimensions first so the
    big lineitem side is shuffled once, on the order key.

    ``start``/``end`` (``yyyy-MM-dd``, end exclusive) restrict the order date
    on the raw timestamp column, so the predicate reaches the Parquet scan of
    ``orders`` (row-group statistics) and the join only sees those orders.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if start is not None:
        orders = orders.where(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    dims = (orders.join(cust, orders.o_custkey == cust.c_custkey)
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", "o_custkey", "o_orderdate", "n_name"))
    letter = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in RETURN_FLAG_LETTER.items() for x in kv]),
                     F.col("l_returnflag")),
        F.lit(""))
    key = F.col("o_orderkey").cast("string")
    digits = F.lpad(key, F.greatest(F.lit(6), F.length(key)), "0")
    d = F.to_date("o_orderdate")
    # the lines must never be the broadcast side, however small their file is after pruning
    return (li.hint("merge").join(dims, li.l_orderkey == dims.o_orderkey)
            .select(
                F.col("n_name").alias("country"),
                F.col("o_custkey").alias("customer_id"),
                F.date_format(d, "dd").alias("day"),
                F.concat(letter, digits).alias("invoice"),
                F.date_format(d, "MM").alias("month"),
                F.col("l_extendedprice").alias("price"),
                F.col("l_partkey").cast("string").alias("stream_id"),
                F.col("l_quantity").cast("bigint").alias("times_viewed"),
                F.date_format(d, "yyyy").alias("year"),
                d.alias("date"),
                digits.alias("invoice_id"),  # what clean_invoice leaves of the invoice
            ))
