"""Helpers shared by the training-data operators.

Word rules (both lower-case A-Z only, so they can run on UTF-8 bytes):

* ``alnum_words``: maximal runs of ASCII letters, digits and non-ASCII
  characters, i.e. ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``;
* ``space_words``: maximal runs of anything but ``[\\x20\\x09-\\x0D]``.

A null text has no words.
"""

from __future__ import annotations

import uuid
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast.session import ensure_checkpoint_dir, ship_code

#: Every byte that belongs to no alnum word becomes a blank; A-Z become a-z.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90
    else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
    else 32
    for c in range(256)
)

_U64 = np.uint64


def alnum_words(raw: bytes) -> list[bytes]:
    return raw.translate(_ALNUM).split()


def alnum_bytes(raw: bytes) -> bytes:
    """The normalised text, byte for byte as long as ``raw``."""
    return raw.translate(_ALNUM)


def space_words(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads sums of hashes over all 64 bits."""
    x = x ^ (x >> _U64(30))
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def prepare(spark: SparkSession) -> None:
    """Name the checkpoint folder if the cluster has not, and make this package importable on the executors."""
    ensure_checkpoint_dir(spark)
    ship_code(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the checkpoint folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def via_table(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage as ``checkpoint`` does, but compressed and by column.
    """
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Return what a finished task has freed to the system, since workers are
    used again and what one stage held would count while the next one runs."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library keeps its own rule
        pass
