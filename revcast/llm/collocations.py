"""Phrase collocations, counted exactly in counting quotient filters.

1. A task cuts its texts into blocks of one language and numbers the distinct
   words of each block; a block is written as its word numbers (0 between
   pieces) with its list of words and their counts.
2. Spark adds the counts up by (language, word). A phrase of ``min_count``
   occurrences holds no rarer word, so words from ``min_count`` on get dense
   global ids; the language is that of the id. Ids go back to the blocks by a
   join, a row for each block and distinct word, so no task holds the whole
   vocabulary.
3. A task counts the id pairs and triples of its blocks in counting quotient
   filters (:mod:`.quotient_filter`), one for each shard of the permuted keys,
   and emits them in bytes; the filters of a shard are merged by their order.
   The permutation deals keys evenly, so a frequent word or pair is one entry
   of each filter, and shards grow with the corpus (``SHARD_TOKENS``).
4. Counts of parts, scores and the rule of longer phrases are joins by id.

Rules: A-Z become a-z; ``.,;:!?`` and U+000A to U+000D end a piece; words are
runs of anything but blank and tab. Everything is per language (null: ``und``).

Defined results: a null or empty text has no words; repeated rows count as
often as they occur; a row's id plays no part, so null or repeated ids change
nothing; a piece of any length is one; ties go to more occurrences, then to the
phrase first in the order of its UTF-8 bytes; an empty table gives none. Words
are told apart within a block by a 64-bit hash, everywhere else by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_path, via_table
from .hashing import word_spans
from .quotient_filter import Packing

MIN_COUNT, TOP, COVER_PERCENT = 10, 2_000, 50
#: Bytes of text in a block; longer texts are cut where a piece ends.
BLOCK_BYTES = 4 << 20
#: Bytes of text that a task holds for all languages together.
HELD_BYTES = 16 << 20
#: Words of the corpus for each shard of the counted phrases, and the fewest shards (as a power of two).
SHARD_TOKENS, LEAST_SHARD_BITS = 1 << 20, 6
#: Parts of a language that are ranked apart before its first phrases are.
RANK_PARTS = 8
#: Phrases that a task gathers before it counts them.
GATHERED = 1 << 22

_RULE = np.frombuffer(bytes(range(256)).lower(), np.uint8).copy()
_RULE[0] = 255  # a zero byte is part of a word; 255 is no byte of UTF-8
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_RULE[_BREAK] = 0
_RULE[[32, 9]] = 0


def _slices(raw: bytes, most: int) -> Iterator[bytes]:
    """A text in slices of about ``most`` bytes, cut behind the end of a piece."""
    while len(raw) > most:
        ends = np.flatnonzero(_BREAK[np.frombuffer(raw, np.uint8, most)])
        if len(ends):
            cut = int(ends[-1]) + 1
        else:
            ends = np.flatnonzero(_BREAK[np.frombuffer(raw, np.uint8)[most:]])
            cut = most + int(ends[0]) + 1 if len(ends) else len(raw)
        yield raw[:cut]
        raw = raw[cut:]
    yield raw


def number_words(raw: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Word numbers from 1 with a 0 wherever a piece ends between words, the distinct words, their counts."""
    data = np.frombuffer(raw, np.uint8)
    hashes, _, starts, sizes = word_spans(data, np.array([len(data)]), _RULE)
    if not len(hashes):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    _, first, number, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    piece = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
    cuts = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    lower = raw.lower()
    words = [lower[a : a + n] for a, n in zip(starts[first].tolist(), sizes[first].tolist(), strict=True)]
    return np.insert(number + 1, cuts, 0), words, counts


_BLOCK = "block bigint, lang string, n_words bigint, codes binary, words array<binary>, counts array<bigint>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}

    def flush(lang: str) -> pa.RecordBatch:
        nonlocal number
        number += 1
        codes, words, counts = number_words(b"\n".join(held.pop(lang)))
        size.pop(lang)
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([lang]), pa.array([int(counts.sum())], pa.int64()),
             pa.array([codes.astype("<u4").tobytes()], pa.binary()), pa.array([words], pa.list_(pa.binary())),
             pa.array([counts], pa.list_(pa.int64()))],
            ["block", "lang", "n_words", "codes", "words", "counts"])

    for batch in batches:
        langs = batch.column("lang").to_pylist()
        texts = batch.column("__text").cast(pa.large_binary())
        for k, lang in enumerate(langs):
            for part in _slices(texts[k].as_py() or b"", BLOCK_BYTES):
                if size.get(lang, 0) and size[lang] + len(part) > BLOCK_BYTES:
                    yield flush(lang)
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part) + 1
                if sum(size.values()) > HELD_BYTES:
                    yield flush(max(size, key=size.get))
    for lang in list(held):
        yield flush(lang)


def _vocabulary(words: DataFrame, min_count: int) -> tuple[DataFrame, int]:
    """(lang, word, f, id): dense ids from 1 of all words with ``min_count`` occurrences, and how many there are."""
    found = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    found = via_table(found.withColumn("place", F.monotonically_increasing_id()), "phrase-words")
    part = F.shiftright("place", 33).alias("part")
    parts = found.groupBy(part).agg(F.count("*").alias("n"))  # a row for each task that wrote the table
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ids = found.withColumn("part", part).join(F.broadcast(offsets), "part").select(
        "lang", "word", "f", (F.col("offset") + F.col("place").bitwiseAND((1 << 33) - 1) + 1).alias("id"))
    return ids, found.count()


def _count(bits: int, shard_bits: int, lengths: tuple[int, ...]):
    """Filters of the phrases of all blocks of a task, gathered up to ``GATHERED`` at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs = {n: Packing(n, bits) for n in lengths}
        held: dict[int, list] = {n: [] for n in lengths}
        size = dict.fromkeys(lengths, 0)

        def flush(n: int) -> pa.RecordBatch:
            pack, parts = packs[n], held[n]
            held[n], size[n] = [], 0
            low = np.concatenate([p[1] for p in parts]) if pack.low_bits else None
            upper, low, counts = pack.count(np.concatenate([p[0] for p in parts]), low)
            shard = pack.shard(upper, shard_bits)
            at = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            ends = np.append(at[1:], len(shard))
            rows = [pack.build(upper[a:b], None if low is None else low[a:b], counts[a:b], shard_bits)
                    for a, b in zip(at.tolist(), ends.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array([n] * len(rows), pa.int32()), pa.array(shard[at], pa.int64()), pa.array(rows, pa.binary())], ["n", "shard", "filter"])

        for batch in batches:
            for k in range(batch.num_rows):
                codes = np.frombuffer(batch.column("codes")[k].as_buffer(), "<u4")
                ids = batch.column("ids")[k].values
                known = np.zeros(int(codes.max(initial=0)) + 1, np.int64)  # 0: between pieces, or a rarer word
                known[ids.field("pos").to_numpy() + 1] = ids.field("id").to_numpy()
                stream = known[codes]
                for n in lengths:
                    grams = [stream[j : len(stream) - n + 1 + j] for j in range(n)]
                    whole = np.logical_and.reduce([g > 0 for g in grams])
                    if whole.any():
                        held[n].append(packs[n].keys([g[whole] for g in grams]))
                        size[n] += int(whole.sum())
                    if size[n] >= GATHERED:
                        yield flush(n)
        for n in lengths:
            if size[n]:
                yield flush(n)

    return run


def _merge(bits: int, min_count: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        n = key[0].as_py()
        pack = Packing(n, bits)
        upper, low, counts = pack.merge(rows.column("filter").to_pylist())
        keep = counts >= min_count
        ids = pack.ids(upper[keep], None if low is None else low[keep])
        columns = ids + [np.zeros(int(keep.sum()), np.int64)] * (3 - n)
        return pa.table([pa.array(np.full(int(keep.sum()), n), pa.int32()), *(pa.array(c, pa.int64()) for c in columns),
                         pa.array(counts[keep].astype(np.int64))], ["n", "id1", "id2", "id3", "a"])

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, word, f, id) and phrases (n, id1, id2, id3 or 0, a) of two
    and three words with at least ``min_count`` occurrences, and the words of
    each language (lang, n). All counts are exact."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("__text"))
    folder = shared_path(docs.sparkSession, "phrase-blocks")
    # a block is some megabytes, so a row group holds few of them
    texts.mapInArrow(_blocks, _BLOCK).write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(folder)
    blocks = docs.sparkSession.read.schema(_BLOCK).parquet(folder)
    totals = blocks.groupBy("lang").agg(F.sum("n_words").alias("n")).where("n > 0")
    words = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select(
        "block", "lang", "pos", F.col("col.words").alias("word"), F.col("col.counts").alias("n"))
    vocabulary, size = _vocabulary(words, min_count)
    tokens = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(1, size.bit_length())
    shard_bits = max(LEAST_SHARD_BITS, (tokens // SHARD_TOKENS).bit_length())
    ids = words.select("block", "lang", "pos", "word").join(vocabulary.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(
        F.collect_list(F.struct("pos", "id")).alias("ids"))  # as many as a block has distinct words
    coded = blocks.select("block", "codes").join(ids, "block").select("codes", "ids")
    filters = coded.mapInArrow(_count(bits, shard_bits, (2, 3)), "n int, shard bigint, filter binary")
    phrases = via_table(filters.groupBy("n", "shard").applyInArrow(_merge(bits, min_count), "n int, id1 bigint, id2 bigint, id3 bigint, a bigint"), "phrases")
    return vocabulary, phrases, totals


def _cut(left: str, right: str, k: int):
    """Floor of 1000000 a a / (l r), in 38 digits, with the cut's place after it for ties."""
    score = F.expr(f"CAST(CAST(a AS decimal(16,0)) * CAST(a AS decimal(16,0)) * 1000000BD AS decimal(38,0)) "
                   f"div (CAST({left} AS decimal(16,0)) * CAST({right} AS decimal(16,0)))")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int | None = TOP) -> DataFrame:
    """Per language: rank, phrase, a, l, r, n, score of its ``top`` phrases (all: None)."""
    vocabulary, phrases, totals = phrase_counts(docs, text_col, lang_col, min_count)

    def word(k: int) -> DataFrame:
        columns = [F.col("id").alias(f"id{k}"), F.col("f").alias(f"f{k}"), F.col("word").alias(f"w{k}")]
        return vocabulary.select(*columns, *(["lang"] if k == 1 else []))

    pairs = phrases.where("n = 2").select("id1", "id2", "a")
    triples = phrases.where("n = 3").select("id1", "id2", "id3", "a")
    longest = triples.select(F.inline(F.array(F.struct("id1", "id2", "a"), F.struct(F.col("id2").alias("id1"), F.col("id3").alias("id2"), "a"))))
    longest = longest.groupBy("id1", "id2").agg(F.max("a").alias("__longer"))
    two = pairs.join(longest, ["id1", "id2"], "left").where(f"__longer IS NULL OR 100 * __longer < {COVER_PERCENT} * a")
    two = two.join(word(1), "id1").join(word(2), "id2").select("lang", "a", F.array("w1", "w2").alias("words"), _cut("f1", "f2", 1).alias("cut"))
    three = triples.join(pairs.select("id1", "id2", F.col("a").alias("f12")), ["id1", "id2"]).join(
        pairs.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("a").alias("f23")), ["id2", "id3"])
    three = three.join(word(1), "id1").join(word(2), "id2").join(word(3), "id3").select(
        "lang", "a", F.array("w1", "w2", "w3").alias("words"), F.least(_cut("f1", "f23", 1), _cut("f12", "f3", 2)).alias("cut"))
    found = two.unionByName(three).select("lang", F.concat_ws(" ", F.transform("words", lambda w: w.cast("string"))).alias("phrase"),
                                          "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if top is not None:
        # the best of each of RANK_PARTS parts of a language first, so one task ranks RANK_PARTS * top rows at most
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        found = found.withColumn("__at", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("__at") <= top)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocation_report(docs: DataFrame) -> DataFrame:
    return collocations(docs)


ORACLE = """
WITH w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents)),
uni AS (SELECT lang, w, count(*) AS f FROM (SELECT lang, unnest(ws) AS w FROM w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM uni GROUP BY lang),
bi AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, count(*) AS a FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM w)
       GROUP BY ALL HAVING count(*) >= 10),
tri AS (SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z, count(*) AS a FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
        GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, x, y, max(a) AS a FROM (SELECT lang, x, y, a FROM tri UNION ALL SELECT lang, y, z, a FROM tri) GROUP BY ALL),
cuts AS (
  SELECT bi.lang, bi.x || ' ' || bi.y AS phrase, bi.a, 1 AS k, p.f AS l, q.f AS r
  FROM bi JOIN uni p ON p.lang = bi.lang AND p.w = bi.x JOIN uni q ON q.lang = bi.lang AND q.w = bi.y
  LEFT JOIN longer ON longer.lang = bi.lang AND longer.x = bi.x AND longer.y = bi.y
  WHERE longer.a IS NULL OR 100 * longer.a < 50 * bi.a
  UNION ALL
  SELECT tri.lang, tri.x || ' ' || tri.y || ' ' || tri.z, tri.a, 1, p.f, q.a
  FROM tri JOIN uni p ON p.lang = tri.lang AND p.w = tri.x JOIN bi q ON q.lang = tri.lang AND q.x = tri.y AND q.y = tri.z
  UNION ALL
  SELECT tri.lang, tri.x || ' ' || tri.y || ' ' || tri.z, tri.a, 2, p.a, q.f
  FROM tri JOIN bi p ON p.lang = tri.lang AND p.x = tri.x AND p.y = tri.y JOIN uni q ON q.lang = tri.lang AND q.w = tri.z),
scored AS (SELECT *, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS score FROM cuts),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least_cut)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
