"""Order MinHash: fingerprints whose likeness follows the edit distance.

A text's elements are its k-mers of ``K`` code points, each with its occurrence
number (the first "th" is another element than the second). Each of
``FUNCTIONS`` hash functions selects the ``TUPLE`` elements of the smallest
values; their k-mers, in the order of the text, are hashed to 32 bits. Texts
with the same k-mers in another order so differ, unlike with plain MinHash.
The fingerprint is the row of these hashes, eight hexadecimal digits each, and
the likeness of two is the share of equal places.

The selection looks at few elements: a threshold leaves about ``CANDIDATES`` of
each text for each function; where fewer than ``TUPLE`` are left, all of the
text are looked at. Equal values go to the earlier element.

``edited_report`` fingerprints every text together with an edited one, whose end
comes from the next document in descending doc_id. Documents are dealt into
ranges of doc_id and sorted there; a task pairs each with its follower, and the
last one of a range is paired with the first one of the next by a small join of
the ranges' ends. Elements of the part that both texts share are hashed once.

Defined results: a null text is the empty text; a text of fewer than ``K`` code
points is one k-mer; a text of fewer than ``TUPLE`` elements gives tuples of
what there is, so all empty texts are alike (1.0) and unlike others; texts with
equal code points have equal fingerprints. Null ids come after all others,
repeated ids are ordered by the hash of their text, then by the text; equal
rows follow each other and may stand for one another. A single row is its own
next. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64
from .pieces import steps

K, TUPLE, FUNCTIONS = 8, 2, 64
#: Elements of a text that pass a function's threshold, on average.
CANDIDATES = 10
#: Elements that are hashed by all functions at a time.
CHUNK = 1 << 17

_RNG = np.random.default_rng(20240611)
_PLACE = _RNG.integers(1, 1 << 62, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint64).astype(np.uint32)
_FACTOR = _RNG.integers(0, 1 << 31, FUNCTIONS, dtype=np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_IN_TUPLE = _RNG.integers(1, 1 << 62, TUPLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OF_FUNCTION = _RNG.integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64)
_AGAIN = np.uint64(0x9E3779B97F4A7C15)


def code_points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), "<u4")


def kmers(codes: np.ndarray) -> np.ndarray:
    """64-bit hashes of the k-mers of a text; a shorter text is one of its own length."""
    n = len(codes)
    wide = codes.astype(np.uint64) + np.uint64(1)
    if n < K:
        return mix64((wide * _PLACE[:n]).sum(keepdims=True) + np.uint64(n)) if n else np.zeros(0, np.uint64)
    out = np.zeros(n - K + 1, np.uint64)
    for j in range(K):
        out += wide[j : n - K + 1 + j] * _PLACE[j]
    return mix64(out)


def elements(grams: np.ndarray) -> np.ndarray:
    """32-bit values of the k-mers with their occurrence numbers."""
    n = len(grams)
    bits = max(1, int(n - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    order = np.sort((grams & ~low) | np.arange(n, dtype=np.uint64)) & low  # by k-mer, then by place
    order = order.astype(np.int64)
    ranked = grams[order]
    same = np.zeros(n, np.int64)
    same[1:] = ranked[1:] == ranked[:-1]
    run = np.arange(n)
    number = np.zeros(n, np.uint64)
    number[order] = run - np.maximum.accumulate(np.where(same == 0, run, 0))
    return (mix64(grams + number * _AGAIN) >> np.uint64(32)).astype(np.uint32)


class _Chunk:
    """Texts whose elements are hashed together: for each, the parts (begin, end)
    of the elements that make it up, in the order of the text."""

    def __init__(self) -> None:
        self.grams: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.size = 0
        self.texts: list[list[tuple[int, int]]] = []

    def put(self, grams: np.ndarray, values: np.ndarray) -> int:
        self.grams.append(grams)
        self.values.append(values)
        self.size += len(grams)
        return self.size - len(grams)

    def signatures(self) -> np.ndarray:
        """(texts, functions) hashes."""
        n = len(self.texts)
        out = np.empty((n, FUNCTIONS), np.uint32)
        grams = np.concatenate([*self.grams, np.zeros(0, np.uint64)])
        values = np.concatenate([*self.values, np.zeros(0, np.uint32)])
        sizes = np.array([sum(b - a for a, b in parts) for parts in self.texts], np.int64)
        # an element belongs to at most two texts: the one it stands in first, and the edited one that shares it
        limit = np.zeros(len(values), np.uint32)
        owner = np.full((2, len(values)), -1, np.int32)
        for t, parts in enumerate(self.texts):
            share = min(1.0, CANDIDATES / max(1, int(sizes[t])))
            for a, b in (p for p in parts if p[0] < p[1]):
                row = owner[0] if owner[0, a] < 0 else owner[1]
                row[a:b] = t
                np.maximum(limit[a:b], np.uint32(min((1 << 32) - 1, int(share * (1 << 32)))), out=limit[a:b])
        found_at, found_value, found_by = [], [], []
        for j in range(FUNCTIONS):
            hashed = (values ^ _FLIP[j]) * _FACTOR[j]
            at = np.flatnonzero(hashed <= limit)
            found_at.append(at)
            found_value.append(hashed[at])
            found_by.append(np.full(len(at), j, np.int64))
        at, value, by = np.concatenate(found_at), np.concatenate(found_value), np.concatenate(found_by)
        best = np.full((n * FUNCTIONS, TUPLE), -1, np.int64)  # places of the smallest values
        have = np.zeros(n * FUNCTIONS, np.int64)
        for row in owner:
            mine = row[at] >= 0
            if not mine.any():
                continue
            have += np.bincount(row[at[mine]] * np.int64(FUNCTIONS) + by[mine], minlength=n * FUNCTIONS)
        cell = np.concatenate([row[at].astype(np.int64) * FUNCTIONS + by for row in owner])
        keep = np.concatenate([row[at] >= 0 for row in owner])
        cell, place, value = cell[keep], np.tile(at, 2)[keep], np.tile(value, 2)[keep]
        order = np.lexsort((place, value, cell))
        cell, place = cell[order], place[order]
        head = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        for j in range(TUPLE):
            some = head + j
            some = some[(some < len(cell)) & (cell[np.minimum(some, len(cell) - 1)] == cell[head])] if len(cell) else some
            best[cell[some], j] = place[some]
        for c in np.flatnonzero(have < np.minimum(np.repeat(sizes, FUNCTIONS), TUPLE)).tolist():
            t, j = divmod(c, FUNCTIONS)
            at = np.concatenate([np.arange(a, b) for a, b in self.texts[t]])
            first = np.argsort((values[at] ^ _FLIP[j]) * _FACTOR[j], kind="stable")[:TUPLE]
            best[c, : len(first)] = at[first]
        # in the order of the text: parts of a text stand in its order; missing elements come last
        best = np.sort(np.where(best < 0, np.iinfo(np.int64).max, best), axis=1)
        total = _OF_FUNCTION[np.tile(np.arange(FUNCTIONS), n)].copy()
        for j in range(TUPLE):
            there = best[:, j] < len(grams)
            total[there] += grams[best[there, j]] * _IN_TUPLE[j]
        out[:] = (mix64(total) >> np.uint64(32)).astype(np.uint32).reshape(n, FUNCTIONS)
        return out


def _add(chunk: _Chunk, codes: np.ndarray) -> None:
    grams = kmers(codes)
    at = chunk.put(grams, elements(grams))
    chunk.texts.append([(at, at + len(grams))])


def _add_both(chunk: _Chunk, codes: np.ndarray, edited: np.ndarray, shared: int) -> None:
    """A text, and the edited one that begins with the same ``shared`` code points."""
    grams = kmers(codes)
    same = max(0, shared - K + 1) if len(codes) >= K and len(edited) >= K else 0
    at = chunk.put(grams, elements(grams))
    chunk.texts.append([(at, at + len(grams))])
    others = kmers(edited)
    tail = chunk.put(others[same:], elements(others)[same:])
    chunk.texts.append([(at, at + same), (tail, tail + len(others) - same)] if same else [(tail, tail + len(others))])


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, stop, data, ends in steps(batch.column("__text"), CHUNK):
            chunk = _Chunk()
            raw, begin, sizes = data.tobytes(), 0, []
            for end in ends.tolist():
                codes = code_points(raw[begin:end])
                sizes.append(len(codes))
                _add(chunk, codes)
                begin = end
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key").slice(k, stop - k), pa.array(sizes, pa.int64()), pa.array([as_text(s) for s in chunk.signatures()])],
                ["__key", "n_chars", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_chars and fingerprint. One pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("__key"), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(_fingerprints, f"__key {kind}, n_chars bigint, fingerprint string").withColumnRenamed("__key", id_col)


def likeness(a: str, b: str):
    """Share of equal places of two fingerprint columns, as an expression."""
    return F.expr(f"aggregate(sequence(0, {FUNCTIONS - 1}), 0, (s, i) -> s + int(substring({a}, 8 * i + 1, 8) = substring({b}, 8 * i + 1, 8))) / {float(FUNCTIONS)}D")


# ---- a text beside its edited text

_REPORT = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")
_REPORT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                           ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _edit(codes: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, int]:
    """The last third replaced by as many code points of the next text, and how many stay."""
    third = len(codes) // 3
    return np.concatenate([codes[: len(codes) - third], following[:third]]), len(codes) - third


def _rows(ids: list, texts: list[np.ndarray]) -> pa.RecordBatch:
    """The report of all texts but the last; each is followed by the next."""
    chunk, digests = _Chunk(), []
    for codes, following in zip(texts, texts[1:], strict=False):
        edited, shared = _edit(codes, following)
        _add_both(chunk, codes, edited, shared)
        digests.append(hashlib.sha256(edited.astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest())
    _add(chunk, texts[-1])
    marks = chunk.signatures()
    own = np.concatenate([marks[:-1:2], marks[-1:]])
    edited = marks[1:-1:2]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(digests, pa.string()),
         pa.array([as_text(s) for s in own[:-1]], pa.string()), pa.array([as_text(s) for s in edited], pa.string()),
         pa.array((own[:-1] == edited).mean(1), pa.float64()), pa.array((own[:-1] == own[1:]).mean(1), pa.float64())],
        schema=_REPORT_ARROW)


def _in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a sorted range but its last; texts wait for their follower."""
    ids: list = []
    texts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        column = batch.column("__text").cast(pa.large_binary())
        for k, key in enumerate(batch.column("doc_id").to_pylist()):
            ids.append(key)
            texts.append(code_points(column[k].as_py() or b""))
            size += len(texts[-1])
            if size >= CHUNK and len(texts) > 1:
                yield _rows(ids, texts)
                ids, texts = ids[-1:], texts[-1:]
                size = len(texts[0])
    if len(texts) > 1:
        yield _rows(ids, texts)


def _at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a range's last row and the next range's first."""
    for batch in batches:
        text, following = (batch.column(c).cast(pa.large_binary()) for c in ("__text", "following"))
        for k, key in enumerate(batch.column("doc_id").to_pylist()):
            yield _rows([key, None], [code_points(text[k].as_py() or b""), code_points(following[k].as_py() or b"")])


def edited_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Per row: n_chars, the edited text's digest, both fingerprints, and the
    likeness to the edited and to the next text. ``ranges``: tasks that the
    ids are dealt to (default: the session's shuffle partitions)."""
    n = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__hash", F.xxhash64("__text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("__hash"), F.asc("__text")]
    # a number of partitions that is given is kept, so both branches below see the same ranges
    dealt = rows.repartitionByRange(n, *order[:2])
    inside = dealt.sortWithinPartitions(*order).select("doc_id", "__text").mapInArrow(_in_range, _REPORT)
    place = F.struct(F.col("doc_id").isNull().alias("null"), (-F.col("doc_id")).alias("id"), "__hash", "__text")
    ends = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.min(place).alias("head"), F.max(place).alias("tail"))
    numbers = Window.orderBy("range")
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = ends.select("range").select("range", F.coalesce(F.lead("range").over(numbers), F.first("range").over(everything)).alias("next"))
    pairs = ends.select("range", (-F.col("tail.id")).alias("doc_id"), F.col("tail.__text").alias("__text")).join(after, "range").join(
        ends.select(F.col("range").alias("next"), F.col("head.__text").alias("following")), "next")
    return inside.unionByName(pairs.select("doc_id", "__text", "following").mapInArrow(_at_ends, _REPORT))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    return edited_report(docs)
