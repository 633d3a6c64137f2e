"""Token ids in Huffman-coded block files.

1. Every text is encoded with the ``tokenizers`` library and ended with id
   ``end_id``; ids are written once to the shared folder.
2. The counts of all ids are summed in Spark (a vocabulary's worth of rows);
   ``code_lengths`` makes an optimal code of at most ``MAX_BITS`` bits from
   them (package-merge), ``CodeBook`` the canonical codes.
3. Documents are dealt by ranges of doc_id and sorted (``repartitionByRange``),
   then coded and packed in id order into blocks of about ``BLOCK_TOKENS`` ids.
4. Each block stands alone: its documents' ids and lengths, the code stream
   (each document begins on a byte) and a checkpoint, a bit offset, every
   ``LANE`` ids. Decoding looks codes up in a table of 2**MAX_BITS entries,
   all lanes of a block side by side.

A file is a folder: ``blocks/`` (Parquet rows, one for each block, written by
Spark's committer, so lost executors leave no partial files) and ``codebook/``
(code lengths; the codes follow from them).

Defined results: a null or empty text is the end id alone; documents are in
ascending doc_id order, null ids first, repeated ids next to each other by
length, then a hash of their ids; an empty table gives an empty file and no rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, via_table
from .pieces import PieceEncoder, steps

MAX_BITS = 18
BLOCK_TOKENS = 1 << 18
LANE = 256
#: Bytes of ids in one range, and so of one file part before coding, about.
RANGE_BYTES = 256 << 20

_MADE: dict[str, PieceEncoder] = {}


def _encoder(path: str) -> PieceEncoder:
    if path not in _MADE:
        _MADE[path] = PieceEncoder(path)
    return _MADE[path]


def _path(vocabulary: str) -> str:
    if os.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def encode_ids(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """(doc_id, ids): little-endian ids as bytes, ``end_id`` last."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(_path(vocabulary))
        for whole in batches:
            for k, stop, data, ends in steps(whole.column("__text")):
                ids, sizes = enc.encode(data, ends)
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype(enc.dtype)
                at = np.append(0, np.cumsum(sizes + 1) * enc.dtype.itemsize).astype(np.int64)
                coded = pa.Array.from_buffers(pa.large_binary(), stop - k, [None, pa.py_buffer(at), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(k, stop - k), coded], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text")).mapInArrow(
        run, f"doc_id {kind}, ids binary")


def id_counts(ids: DataFrame, width: int) -> DataFrame:
    """(id, n) over all ids; each task sends one row for each id it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            raw = b"".join(batch.column("ids").to_pylist())
            n = np.bincount(np.frombuffer(raw, f"<u{width}"))
            if len(n) > len(total):
                n[: len(total)] += total
                total = n
            else:
                total[: len(n)] += n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return ids.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for positive counts (package-merge)."""
    n = len(counts)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols do not fit codes of {max_bits} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    weights, is_leaf = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by_weight = np.argsort(both, kind="stable")
        weights = both[by_weight]
        is_leaf.append(by_weight < n)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for flags in reversed(is_leaf):
        chosen = int(flags[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


class CodeBook:
    """Canonical codes: by length, then id. Made from (ids, lengths) alone."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, max_bits: int = MAX_BITS):
        self.max_bits = max_bits
        top = int(ids.max()) + 1 if len(ids) else 1
        self.length = np.zeros(top, np.uint8)
        self.code = np.zeros(top, np.uint64)
        self.symbol = np.zeros(1 << max_bits, np.uint32)
        self.taken = np.ones(1 << max_bits, np.uint8)
        order = np.lexsort((ids, lengths))
        spans = (1 << (max_bits - lengths[order])).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(spans)[:-1]]) if len(spans) else spans
        self.length[ids[order]] = lengths[order]
        self.code[ids[order]] = starts >> (max_bits - lengths[order])
        filled = int(spans.sum())
        self.symbol[:filled] = np.repeat(ids[order], spans)
        self.taken[:filled] = np.repeat(lengths[order], spans)

    def pack(self, docs: list[np.ndarray]) -> tuple[list[bytes], list[np.ndarray]]:
        """The code stream of each document, and the bit offset of every LANE-th id in it."""
        sizes = np.array([len(d) for d in docs], np.int64)
        if not sizes.sum():
            return [b""] * len(docs), [np.zeros(0, np.int64)] * len(docs)
        ids = np.concatenate(docs)
        bits = self.length[ids].astype(np.int64)
        ends = np.cumsum(bits)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        before = np.where(first > 0, ends[first - 1], 0)
        total = np.concatenate([before[1:], ends[-1:]]) - before
        n_bytes = (total + 7) // 8
        base = np.concatenate([[0], np.cumsum(n_bytes)])
        pos = ends - bits + np.repeat(base[:-1] * 8 - before, sizes)
        word, off = pos >> 5, pos & 31
        value = self.code[ids] << (64 - off - bits).astype(np.uint64)
        n_words = int(base[-1]) // 4 + 2
        stream = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n_words + 1)
        stream[1:] += np.bincount(word, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n_words)
        raw = stream.astype(">u4").tobytes()
        payload = [raw[a:b] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]
        marks = [pos[f : f + s : LANE] - 8 * b for f, s, b in zip(first.tolist(), sizes.tolist(), base[:-1].tolist(), strict=True)]
        return payload, marks

    def unpack(self, payload: bytes, marks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The ids of a block: lanes begin at bit offsets ``marks`` and hold ``counts`` ids."""
        raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
        at = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out = np.empty(int(counts.sum()), np.uint32)
        lane_order = np.argsort(-counts, kind="stable")
        pos = marks[lane_order].astype(np.int64)
        left = counts[lane_order]
        to = (np.cumsum(counts) - counts)[lane_order]
        shift, mask = 32 - self.max_bits, np.uint32((1 << self.max_bits) - 1)
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))  # lanes with more than ``step`` ids
            p = pos[:live]
            key = (at[p >> 3] >> (shift - (p & 7)).astype(np.uint32)) & mask
            out[to[:live] + step] = self.symbol[key]
            pos[:live] += self.taken[key]
        return out


def _coded(ids: DataFrame, book, width: int, kind: str) -> DataFrame:
    shipped = ids.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = CodeBook(*shipped.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                docs = [np.frombuffer(b, f"<u{width}") for b in batch.column("ids").to_pylist()]
                payload, marks = codes.pack(docs)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(d) for d in docs], pa.int64()), pa.array(payload, pa.large_binary()),
                     pa.array([m.astype("<i8").tobytes() for m in marks], pa.large_binary())],
                    ["doc_id", "n_tokens", "payload", "marks"])

    return ids.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, payload binary, marks binary")


_BLOCK = ["range_no", "block_no", "before", "n_tokens", "doc_tokens", "payload", "marks", "doc_ids"]


def _blocks(coded: DataFrame, kind: str) -> DataFrame:
    """Blocks of consecutive documents; the input lies sorted by range and id within its partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_type = None
        rows: list[tuple] = []
        held = last = number = before = 0

        def close():
            nonlocal rows, held, number, before
            base, payload, marks = 0, [], []
            for _, _, p, m in rows:
                marks.append(np.frombuffer(m, "<i8") + 8 * base)
                payload.append(p)
                base += len(p)
            out = pa.RecordBatch.from_arrays(
                [pa.array([last], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([[r[1] for r in rows]], pa.list_(pa.int64())), pa.array([b"".join(payload)], pa.large_binary()),
                 pa.array([np.concatenate(marks)], pa.list_(pa.int64())), pa.array([[r[0] for r in rows]], pa.list_(doc_type))],
                _BLOCK)
            rows, held, number, before = [], 0, number + 1, before + held
            return out

        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for r, *row in zip(*(batch.column(c).to_pylist() for c in ("range_no", "doc_id", "n_tokens", "payload", "marks")), strict=True):
                if rows and (r != last or held >= BLOCK_TOKENS):
                    yield close()
                if r != last:
                    last, number, before = r, 0, 0
                rows.append(tuple(row))
                held += row[1]
        if rows:
            yield close()

    return coded.mapInArrow(run, "range_no int, block_no int, before bigint, n_tokens bigint, doc_tokens array<bigint>, payload binary, "
                                 f"marks array<bigint>, doc_ids array<{kind}>")


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> None:
    """Encode every text and write the block file ``path``."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    width = _encoder(_path(vocabulary)).dtype.itemsize
    ids = via_table(encode_ids(docs, id_col, text_col, vocabulary, end_id), "token-ids")
    counts = id_counts(ids, width).orderBy("id").collect()  # at most one row for each id of the vocabulary
    symbols = np.array([r[0] for r in counts], np.int64)
    lengths = code_lengths(np.array([r[1] for r in counts], np.int64))
    spark.createDataFrame([(int(i), int(n)) for i, n in zip(symbols, lengths, strict=True)], "id bigint, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    # ranges of ids: equal shares of the rows, so a repeated id may lie in several; what tells its rows apart is sorted too
    volume = sum(r[1] for r in counts) * width
    parts = max(-(-volume // RANGE_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("__length"), F.col("__hash"), F.col("__row")]
    keyed = ids.select("doc_id", "ids", F.length("ids").alias("__length"), F.xxhash64("ids").alias("__hash"),
                       F.monotonically_increasing_id().alias("__row"))
    dealt = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    coded = _coded(dealt, (symbols, lengths), width, kind).withColumn("range_no", F.spark_partition_id())
    _blocks(coded, kind).write.option("compression", "none").parquet(f"{path}/blocks")


#: Ranges of ids that are shipped to all executors when a file is read (16 bytes each); more are joined by shuffle.
MAX_SHIPPED_RANGES = 1_000_000


def range_starts(spark: SparkSession, path: str) -> DataFrame:
    """(range_no, range_start): ids before each range; one row for about RANGE_BYTES of ids."""
    ranges = spark.read.parquet(f"{path}/blocks").groupBy("range_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_start"))
    return F.broadcast(starts) if ranges.count() <= MAX_SHIPPED_RANGES else starts


def read_tokens(spark: SparkSession, path: str, digests_only: bool = False) -> DataFrame:
    """Per document, from the file alone: doc_id, start, n_tokens, ids_crc32 and (unless ``digests_only``) ids."""
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").collect()
    shipped = spark.sparkContext.broadcast((np.array([r[0] for r in book], np.int64), np.array([r[1] for r in book], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = CodeBook(*shipped.value)
        for batch in batches:
            doc_type = batch.schema.field("doc_ids").type.value_type
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("start", "doc_tokens", "payload", "marks", "doc_ids")}
                sizes = np.array(row["doc_tokens"], np.int64)
                lanes = -(-sizes // LANE)
                counts = np.full(int(lanes.sum()), LANE, np.int64)
                counts[np.cumsum(lanes) - 1] = sizes - (lanes - 1) * LANE  # each document has its end id at least
                ids = codes.unpack(row["payload"], np.array(row["marks"], np.int64), counts).astype("<u4")
                ends = np.cumsum(sizes)
                raw = ids.tobytes()
                begin = (ends - sizes).tolist()
                parts = [raw[4 * a : 4 * b] for a, b in zip(begin, ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], doc_type), pa.array([row["start"] + a for a in begin], pa.int64()),
                           pa.array(sizes), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                if not digests_only:
                    columns.append(pa.array([np.frombuffer(p, "<i4") for p in parts], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ("" if digests_only else ", ids array<int>")
    placed = blocks.join(range_starts(spark, path), "range_no").select(
        (F.col("range_start") + F.col("before")).alias("start"), "doc_tokens", "payload", "marks", "doc_ids")
    return placed.mapInArrow(run, schema)


def token_file_report(docs: DataFrame) -> DataFrame:
    """Write the documents' token file to the shared folder and read it back."""
    path = shared_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return read_tokens(docs.sparkSession, path, digests_only=True)
