"""Interpolated modified Kneser-Ney n-gram model over hashed words.

Words are counted first, exactly: their sum gives the number of buckets
(``TOKENS_PER_BUCKET``), and a word with more than a bucket's share of all
tokens is *hot*. The n-grams are then counted by a Spark job: every task
combines those of its batches and sends them, packed, to the bucket of their
context; contexts that end in a hot word are dealt over as many buckets as the
word has shares, by the hash of the whole n-gram, so no word's n-grams meet in
one task. A bucket's group adds the counts up and writes its part of the model
to the shared folder as sorted arrays: n-gram hashes with counts, and for each
context its total and how many of its n-grams were seen once, twice, more
often. What it knows of a split context goes to that context's own bucket and
is added up there. Continuation counts (before how many different words an
n-gram without its first word stands) go to the buckets of the next lower
order the same way, down to single words. Most long contexts occur once: of
these only the hash is kept, and counts take the smallest type that holds them.

Scoring maps the arrays into memory (where the folder is a file system; else
parts are read when needed and at most ``HELD_BYTES`` are held; never more than
``HELD_PARTS`` arrays at once) and looks up a whole batch of n-grams by binary
search in sorted order. Pages of mapped files
are the system's to drop.

A model of long n-grams is several times as large as its texts. Where it is only
to score the texts at hand, :func:`train_and_score` gives the same without storing it.

A text's tokens are its words (:data:`SPACE` rule), then one end token; start
marks stand before a text's first word. For a context h, the word w after it
and h' (h without its first word), with D1, D2, D3 the order's discounts of
counts 1, 2 and more; c are counts in the highest order, else continuation
counts:

    p(w|h) = (c(hw) - D(c(hw)) + (D1 N1(h.) + D2 N2(h.) + D3 N3+(h.)) p(w|h')) / c(h.)
    p(w) = (N(.w) - D'(N(.w)) + (D1' n1 + D2' n2 + D3' n3+) / (V + 1)) / N(..)

p(w|h) = p(w|h') for an unseen h. The base score is the additive unigram model
with 0.1. Counts are not rounded, pruned or sampled.

Defined results: a null or empty text is the end token alone; a row with a
null id is held out; repeated rows are counted and scored as often as they
occur; with nothing to learn from, N and V are 0, every base probability is
one, and the model's are uniform, 1 / (V + 1) = 1; an empty table gives none.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, give_back, mix64, shared_path, via_table
from .hashing import SPACE, hash_words
from .pieces import steps

#: Order of a model that is trained without naming one: the longest n-grams that are counted.
ORDER = 2
#: Order of the report's model, the usual one of Kneser-Ney models that rate texts.
REPORT_ORDER = 5
#: Tokens whose n-grams meet in one bucket, about.
TOKENS_PER_BUCKET = 1_500_000
#: Text that a worker counts or scores at a time.
STEP_BYTES = 4 << 20
#: Of contexts longer than a word, those are tallied that are at least this part of a step's tokens.
HEAVY = 4096
#: Words, the most frequent, that travel as numbers; others as their hash.
CODED = 1 << 19
#: Model arrays that a worker holds where they cannot be mapped.
HELD_BYTES = 256 << 20
#: Arrays that a worker has open at once (a process may map about 65,000 files).
HELD_PARTS = 8192

START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0x27D4EB2F165667C5)
_PAIR = np.uint64(0x9E3779B97F4A7C15)
#: Last words travel as the upper 48 bits of their hash.
_SHORT = np.uint64(16)
_CONTEXT = np.dtype([("context", "<u8"), ("total", "<u8"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])
_WORD = np.dtype([("word", "<u8"), ("n", "<u8")])


def _tokens(data: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``order`` - 1 tokens before every token, nearest last; every token; tokens of each document."""
    hashes, counts = hash_words(data, ends, SPACE)
    token = np.insert(hashes, np.cumsum(counts), END)
    counts = counts + 1
    return _before(token, counts, order, START), token, counts


def _before(token: np.ndarray, counts: np.ndarray, order: int, start) -> np.ndarray:
    """The ``order`` - 1 tokens before every token, nearest last; ``start`` before a text."""
    place = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts)
    before = np.full((order - 1, len(token)), start, token.dtype).T  # columns are contiguous
    for back in range(1, order):
        before[back:, -back] = np.where(place[back:] >= back, token[:-back], start)
    return before


def _contexts(before: np.ndarray) -> list[np.ndarray]:
    """One number for the nearest word, the nearest two, and so on: of a single word its hash."""
    out = [before[:, -1]]
    for k in range(2, before.shape[1] + 1):
        out.append(mix64(out[-1] * _PAIR + before[:, -k]))
    return out


def _context(before: np.ndarray) -> np.ndarray:
    """One number for all words of a context."""
    return _contexts(before)[-1]


def _bucket(word: np.ndarray, n: int) -> np.ndarray:
    return ((word >> _SHORT) % np.uint64(n)).astype(np.int64)


def _key(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(context * _PAIR + mix64(token >> _SHORT))


def _find(keys: np.ndarray | None, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of every wanted value in sorted keys."""
    if keys is None or not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Deal:
    """Where n-grams meet: the bucket of their context, or one of the buckets over which a hot word's contexts are split."""

    def __init__(self, buckets: int, hot: np.ndarray, shares: np.ndarray):
        order = np.argsort(hot)
        self.buckets, self.hot, self.shares = buckets, hot[order], shares[order].astype(np.uint64)

    def is_split(self, before: np.ndarray) -> np.ndarray:
        return _find(self.hot, before[:, -1])[1]

    def __call__(self, before: np.ndarray, key: np.ndarray) -> np.ndarray:
        out = _bucket(_context(before), self.buckets)
        at, split = _find(self.hot, before[:, -1])
        out[split] = (out[split] + (key[split] % self.shares[at[split]]).astype(np.int64)) % self.buckets
        return out


def _zip(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unzip(raw: bytes, n: int, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype)


def _short_bytes(word: np.ndarray) -> bytes:
    return np.ascontiguousarray((word >> _SHORT).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_short(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel() << _SHORT


def _slices(order_by: np.ndarray, n: int):
    """(bucket, slice) of a sorted bucket column."""
    cut = np.searchsorted(order_by, np.arange(n + 1))
    return [(k, slice(cut[k], cut[k + 1])) for k in range(n) if cut[k] < cut[k + 1]]


_ROWS = ("kind string, target int, n_contexts bigint, n bigint, contexts binary, sizes binary, words binary, counts binary, "
         "c1 bigint, c2 bigint, c3 bigint, c4 bigint, more bigint, grams bigint")
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]


def _packed(before: np.ndarray, word: np.ndarray, count: np.ndarray, bucket: np.ndarray, n: int) -> list[tuple]:
    """A row for each bucket: its contexts (once each), how many words follow each, these words and their counts."""
    by = np.lexsort((*before.T, bucket))
    before, word, count, bucket = before[by], word[by], count[by], bucket[by]
    new = np.append(True, (before[1:] != before[:-1]).any(1)) if len(word) else np.zeros(0, bool)
    rows = []
    for k, part in _slices(bucket, n):
        heads, sizes = np.zeros(0, np.int64), b""
        if before.shape[1]:
            own = new[part].copy()
            own[0] = True
            heads = np.flatnonzero(own)
            sizes = _zip(np.diff(np.append(heads, part.stop - part.start)).astype(np.uint32))
        rows.append(("gram", k, len(heads), part.stop - part.start, before[part][heads].tobytes(), sizes,
                     _short_bytes(word[part]), _zip(count[part].astype(np.uint32)), 0, 0, 0, 0, 0, 0))
    return rows


def _unpacked(rows: pd.DataFrame, words_before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context words, last word, count) of all n-grams of packed rows."""
    word = _from_short(b"".join(rows["words"]))
    count = np.concatenate([_unzip(r, n, "<u4") for r, n in zip(rows["counts"], rows["n"], strict=True)]).astype(np.int64)
    if not words_before:
        return np.zeros((len(word), 0), np.uint64), word, count
    before = np.concatenate([np.repeat(np.frombuffer(c, "<u8").reshape(-1, words_before), _unzip(z, n, "<u4"), axis=0)
                             for c, z, n in zip(rows["contexts"], rows["sizes"], rows["n_contexts"], strict=True)])
    return before, word, count


_TALLY = "length int, word bigint, n bigint, learned bigint"


def _tally(order: int):
    """How often each word stands before a token (a text's first token has the start mark before it), in all texts
    and in those to learn from. Of longer contexts, up to ``order`` - 1 words, those that are frequent in their step."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, stop, data, ends in steps(batch.column("__text"), STEP_BYTES):
                before, _, counts = _tokens(data, ends, order)
                learn = np.repeat(_flags(batch.column("__learn"))[k:stop], counts)
                least = len(before) / HEAVY
                for length in range(1, order):
                    word, of, n = np.unique(_context(before[:, order - 1 - length:]), return_inverse=True, return_counts=True)
                    learned = np.bincount(of[learn], minlength=len(word))
                    heavy = n >= least
                    told = heavy if length > 1 else np.ones(len(word), bool)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(told.sum(), length, np.int32)), *(pa.array(x[told]) for x in (word.view(np.int64), n, learned))],
                        ["length", "word", "n", "learned"])
                    before, learn = before[heavy[of]], learn[heavy[of]]
                del before, counts, learn, word, of, n, learned
        give_back()

    return run


def _flags(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def _save_words(folder: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        words = np.zeros(len(rows), _WORD)
        words["word"], words["n"] = rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"]
        _save(folder, f"words-{int(rows['bucket'].iloc[0]):08d}", np.sort(words, order="word"))
        return pd.DataFrame({"n": [len(words)]})

    return run


def _count(order: int, deal: Deal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(name, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[kind])
                            for name, kind in (c.split() for c in _ROWS.split(", "))])
        for batch in batches:
            for _, _, data, ends in steps(batch.column("__text"), STEP_BYTES):
                before, token, _ = _tokens(data, ends, order)
                key, first, count = np.unique(_key(_context(before), token), return_index=True, return_counts=True)
                rows = _packed(before[first], token[first], count, deal(before[first], key), deal.buckets)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _merge(folder: str, level: int, deal: Deal):
    """One bucket of n-grams of ``level`` words: write its arrays, hand on what the next lower order counts."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bucket = int(rows["target"].iloc[0])
        before, word, count = _unpacked(rows, level - 1)
        key = _key(_context(before), word) if level > 1 else word
        order = np.argsort(key)
        key = key[order]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.add.reduceat(count[order], at)
        key, before, word = key[at], before[order][at], word[order][at]
        out = [("sum", -1, 0, 0, b"", b"", b"", b"", *(int((count == k).sum()) for k in (1, 2, 3, 4)), int((count > 2).sum()), len(key))]
        if level == 1:
            words = np.zeros(len(key), _WORD)
            words["word"], words["n"] = key, count
            _save(folder, f"last-{bucket:08d}", words)
            return pd.DataFrame(out, columns=_NAMES)
        _save(folder, f"grams{level}-{bucket:08d}", key)
        _save(folder, f"counts{level}-{bucket:08d}", count.astype(np.min_scalar_type(count.max())))
        known, of = np.unique(_context(before), return_inverse=True)
        context = np.zeros(len(known), _CONTEXT)
        context["context"] = known
        np.add.at(context["total"], of, count.astype(np.uint64))
        for name, which in (("n1", count == 1), ("n2", count == 2), ("n3", count > 2)):
            context[name] = np.bincount(of[which], minlength=len(known))
        split = np.zeros(len(known), bool)
        split[of] = deal.is_split(before)
        once = ~split & (context["total"] == 1)
        _save(folder, f"once{level}-{bucket:08d}", known[once])
        _save(folder, f"contexts{level}-{bucket:08d}", context[~split & ~once])
        parts = context[split]
        home = _bucket(parts["context"], deal.buckets)
        by = np.argsort(home, kind="stable")
        out += [("split", k, 0, p.stop - p.start, parts[by][p].tobytes(), b"", b"", b"", 0, 0, 0, 0, 0, 0) for k, p in _slices(home[by], deal.buckets)]
        # without its first word, each n-gram is one occurrence for the order below
        shorter = before[:, 1:]
        lower = _key(_context(shorter), word) if level > 2 else word
        lower, first, seen = np.unique(lower, return_index=True, return_counts=True)
        shorter, word = shorter[first], word[first]
        target = deal(shorter, lower) if level > 2 else _bucket(word, deal.buckets)
        return pd.DataFrame(out + _packed(shorter, word, seen, target, deal.buckets), columns=_NAMES)

    return run


def _merge_split(folder: str, level: int):
    """Contexts that were split, added up in their own bucket."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        parts = np.frombuffer(b"".join(rows["contexts"]), _CONTEXT)
        known, of = np.unique(parts["context"], return_inverse=True)
        context = np.zeros(len(known), _CONTEXT)
        context["context"] = known
        for name in ("total", "n1", "n2", "n3"):
            np.add.at(context[name], of, parts[name])
        _save(folder, f"split{level}-{int(rows['target'].iloc[0]):08d}", context)
        return pd.DataFrame({"n": [len(known)]})

    return run


def _save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array under its final name at once, so a repeated or lost task does no harm."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(f"{folder}/{name}.npy")
    part = f"{path}.{uuid.uuid4().hex}"
    if isinstance(system, fs.LocalFileSystem):
        os.makedirs(os.path.dirname(path), exist_ok=True)
    with system.open_output_stream(part) as out:
        buffer = io.BytesIO()
        np.save(buffer, values)
        out.write(buffer.getbuffer())
    system.move(part, path)


def _load(folder: str, name: str) -> np.ndarray:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(f"{folder}/{name}.npy")
    if isinstance(system, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    with system.open_input_file(path) as f:
        return np.load(io.BytesIO(f.read()))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float, float]:
    """D(0) = 0, D(1), D(2), D(3+) from the counts of counts; where these are
    too few for the formulas (a small corpus), the nearest defined value."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else y
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    keep = lambda d, most: min(max(d, 0.0), most)
    return 0.0, keep(d1, 1.0), keep(d2, 2.0), keep(d3, 3.0)


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> dict:
    """Count and store the model; what is returned is a few numbers, its folder
    and the hot words (fewer than there are buckets)."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    folder = shared_path(spark, "kneser-ney")
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), F.lit(True).alias("__learn"))
    tally = via_table(texts.mapInArrow(_tally(2), _TALLY).groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    start = int(START.astype(np.int64))
    is_word = F.col("word") != start
    total = tally.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", F.when(~is_word, F.col("n")), is_word.cast("long")))).first()
    tokens, n_docs, words = (int(x) for x in total)
    buckets = max(1, -(-tokens // TOKENS_PER_BUCKET))
    hot = tally.where(F.col("n") * buckets > tokens).collect()
    deal = Deal(buckets, np.array([r["word"] for r in hot], np.int64).view(np.uint64), np.array([-(-r["n"] * buckets // max(tokens, 1)) for r in hot], np.int64))
    unsigned = F.expr("shiftrightunsigned(word, 16)")
    tally.where(is_word).withColumn("bucket", (unsigned % buckets).cast("int")).groupBy("bucket").applyInPandas(_save_words(folder), "n bigint").agg(F.sum("n")).first()

    discounts, grams, low = {}, {}, None
    rows = texts.mapInArrow(_count(order, deal), _ROWS)
    for level in range(order, 0, -1):
        merged = rows.where("kind = 'gram'").groupBy("target").applyInPandas(_merge(folder, level, deal), _ROWS)
        rows = via_table(merged, f"grams-of-{level}")
        sums = rows.where("kind = 'sum'").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("c1", "c2", "c3", "c4", "more", "grams"))).first()
        discounts[level], grams[level], low = np.array(_discounts(*sums[:4])), int(sums[5]), sums
        if level > 1 and hot:
            rows.where("kind = 'split'").groupBy("target").applyInPandas(_merge_split(folder, level), "n bigint").agg(F.sum("n")).first()
    return {"folder": folder, "order": order, "deal": deal, "docs": n_docs, "tokens": tokens, "grams": grams,
            "vocabulary": words + (n_docs > 0), "discounts": discounts, "low_counts": (low[0], low[1], low[4])}


class Arrays:
    """Stored arrays, mapped when first needed."""

    def __init__(self, folder: str, buckets: int):
        self.folder, self.buckets, self.parts, self.held = folder, buckets, {}, 0

    def part(self, kind: str, bucket: int) -> np.ndarray | None:
        name = f"{kind}-{bucket:08d}"
        if name not in self.parts:
            try:
                found = _load(self.folder, name)
            except FileNotFoundError:  # nothing fell in this bucket
                found = None
            read = 0 if found is None or isinstance(found, np.memmap) else found.nbytes
            if read and self.held + read > HELD_BYTES or len(self.parts) >= HELD_PARTS:
                self.parts, self.held = {}, 0
            self.held += read
            self.parts[name] = found
        return self.parts[name]

    def _by_bucket(self, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket, rows of it)."""
        order = np.argsort(bucket, kind="stable")
        for k, part in _slices(bucket[order], self.buckets):
            yield k, order[part]

    def numbers(self, kind: str, key: np.ndarray) -> np.ndarray:
        """The number stored with each key, or 0."""
        out = np.zeros(len(key), np.int64)
        for k, at in self._by_bucket(_bucket(key, self.buckets)):
            stored = self.part(kind, k)
            i, ok = _find(None if stored is None else stored["word"], key[at])
            if ok.any():
                out[at[ok]] = stored["n"][i[ok]]
        return out


class Model(Arrays):
    """The stored model."""

    def __init__(self, spec: dict):
        self.spec, self.deal = spec, spec["deal"]
        super().__init__(spec["folder"], self.deal.buckets)
        self.low, self.types, self.floor = _lowest(spec)

    def lookup(self, before: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count, log10 model probability) of each token."""
        word, of = np.unique(token, return_inverse=True)
        count, p = np.zeros(len(word)), np.full(len(word), self.floor)
        for k, at in self._by_bucket(_bucket(word, self.deal.buckets)):
            words, last = self.part("words", k), self.part("last", k)
            i, ok = _find(None if words is None else words["word"], word[at])
            if ok.any():
                count[at[ok]] = words["n"][i[ok]]
            i, ok = _find(None if last is None else last["word"], word[at] >> _SHORT << _SHORT)
            if ok.any():
                seen = last["n"][i[ok]].astype(np.int64)
                p[at[ok]] += (seen - self.low[np.minimum(seen, 3)]) / self.types
        count[word == END] = self.spec["docs"]
        p = p[of]
        for level in range(2, self.spec["order"] + 1):
            p = self._with_context(level, before[:, before.shape[1] - level + 1:], token, p)
        return count[of], np.log10(p)

    def _with_context(self, level: int, before: np.ndarray, token: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of order ``level`` from those of the order below."""
        key, first, of = np.unique(_key(_context(before), token), return_index=True, return_inverse=True)
        before, p = before[first], lower[first]
        context, split = _context(before), self.deal.is_split(before)
        row = np.zeros(len(key), _CONTEXT)
        for k, at in self._by_bucket(_bucket(context, self.deal.buckets)):
            for kind, mine in ((f"contexts{level}", at[~split[at]]), (f"split{level}", at[split[at]])):
                known = self.part(kind, k) if len(mine) else None
                i, ok = _find(None if known is None else known["context"], context[mine])
                if ok.any():
                    row[mine[ok]] = known[i[ok]]
            mine = at[~split[at]]
            ok = _find(self.part(f"once{level}", k) if len(mine) else None, context[mine])[1]
            row["total"][mine[ok]] = row["n1"][mine[ok]] = 1
        c = np.zeros(len(key), np.int64)
        seen = np.flatnonzero(row["total"])
        for k, at in self._by_bucket(self.deal(before[seen], key[seen])):
            i, ok = _find(self.part(f"grams{level}", k), key[seen[at]])
            if ok.any():
                c[seen[at[ok]]] = self.part(f"counts{level}", k)[i[ok]]
        d, row, c = self.spec["discounts"][level], row[seen], c[seen]
        rest = d[1] * row["n1"] + d[2] * row["n2"] + d[3] * row["n3"]
        p[seen] = (c - d[np.minimum(c, 3)] + rest * p[seen]) / row["total"]
        return p[of]


def _lowest(spec: dict) -> tuple[np.ndarray, int, float]:
    """Of single words: discounts, how many different pairs there are, and the probability of a word that was never seen."""
    low, n, types = spec["discounts"][1], spec["low_counts"], max(1, spec["grams"][2])
    uniform = 1 / (spec["vocabulary"] + 1)
    return low, types, (low[1] * n[0] + low[2] * n[1] + low[3] * n[2]) / types * uniform if spec["tokens"] else uniform


def score(docs: DataFrame, spec: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, n_tokens, n_known, base_score and score (log10 probabilities), perplexity."""
    kind = docs.schema[id_col].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(shipped.value)
        total = max(model.spec["tokens"] + 0.1 * (model.spec["vocabulary"] + 1), 0.1)
        for batch in batches:
            for k, stop, data, ends in steps(batch.column("__text"), STEP_BYTES):
                before, token, n = _tokens(data, ends, model.spec["order"])
                count, logp = model.lookup(before, token)
                at = np.cumsum(n) - n
                base = np.add.reduceat(np.log10((count + 0.1) / total), at)
                logs = np.add.reduceat(logp, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).slice(k, stop - k), pa.array(n), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
                     pa.array(base), pa.array(logs), pa.array(10 ** np.minimum(-logs / n, 300))],
                    [id_col, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).mapInArrow(
        run, f"{id_col} {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double")


# --- learning and scoring at once, without a stored model of all n-grams

def _gram(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(context * _PAIR + mix64(token))


class Spread:
    """Where windows (n-grams of the highest order) meet: by the shortest of
    their contexts that is not hot; if all are hot, by the whole window."""

    def __init__(self, buckets: int, hot: list[np.ndarray]):
        self.buckets, self.hot = buckets, [np.sort(h) for h in hot]
        #: Buckets of what is stored; fewer, as every partition reads and writes all of them.
        self.parts = 1 + buckets // 16

    def depth(self, contexts: list[np.ndarray]) -> np.ndarray:
        """How many words are in that context; one more than the longest has if all are hot."""
        out = np.ones(len(contexts[0]), np.uint8)
        for length, (context, hot) in enumerate(zip(contexts, self.hot, strict=True), 1):
            if len(hot):
                at = np.flatnonzero(out == length)
                out[at[_find(hot, context[at])[1]]] = length + 1
        return out

    def __call__(self, contexts: list[np.ndarray], key: np.ndarray, depth: np.ndarray) -> np.ndarray:
        spot = contexts[0].copy()
        for length, values in enumerate([*contexts[1:], key], 2):
            at = depth == length
            spot[at] = values[at]
        return (mix64(spot) % np.uint64(self.buckets)).astype(np.min_scalar_type(self.buckets))


class Codes:
    """Numbers for frequent words, the most frequent lowest, and how often these occur; all others have the number ``rare``."""

    def __init__(self, word: np.ndarray, learned: np.ndarray):
        self.rare, self.by = len(word), np.argsort(word).astype(np.uint32)
        self.sorted, self.word, self.learned = word[self.by], np.append(word, np.uint64(0)), np.append(learned, 0)

    def __call__(self, word: np.ndarray) -> np.ndarray:
        at, ok = _find(self.sorted, word)
        out = np.full(len(word), self.rare, np.uint32)
        out[ok] = self.by[at[ok]]
        return out


_WINDOWS = ("step bigint, target int, n bigint, low binary, middle binary, high binary, rare binary, learned binary, "
            "n_places bigint, places binary, n_docs bigint, docs binary, sizes binary, ids array<{kind}>, base binary")
_BLANK = b""


def _windows(order: int, spread: Spread, spec: dict, codes, id_col: str, schema: pa.Schema):
    """For each step of texts and each bucket: the step's windows, how often
    they occur in texts to learn from, and where in which texts they stand.
    Windows whose contexts are all hot are told once for a step. For each step
    one more row has its ids and base scores."""
    total = max(spec["tokens"] + 0.1 * (spec["vocabulary"] + 1), 0.1)

    def told_of(step: int, ids: list, learn: np.ndarray, data: np.ndarray, ends: np.ndarray, number: Codes, stored: Arrays) -> list[tuple]:
        rare = number.rare
        before, token, n = _tokens(data, ends, order)
        word, at = np.unique(token, return_inverse=True)
        code = number(word)
        count = number.learned[code]
        count[code == rare] = stored.numbers("words", word[code == rare])
        first_of = np.cumsum(n) - n
        base = np.add.reduceat(np.log10((count + 0.1) / total)[at], first_of)
        seen = np.add.reduceat((count > 0).astype(np.int64)[at], first_of)
        rows = [(step, step % spread.buckets, 0, *[_BLANK] * 5, 0, _BLANK, len(ids), n.astype("<i8").tobytes(), seen.astype("<i8").tobytes(),
                 ids, base.astype("<f8").tobytes())]
        contexts = _contexts(before)
        key, depth = _gram(contexts[-1], token), spread.depth(contexts)
        target = spread(contexts, key, depth)
        told = np.arange(len(token))  # the place whose window is told
        hot = np.flatnonzero(depth == order)
        if len(hot):
            _, again, heads = _grouped(key[hot])
            told[hot] = hot[again[heads]][_of(again, heads)]
        code = code[at]
        code = np.concatenate([_before(code, n, order, number(np.array([START]))[0]).T, code[None]])
        doc = np.repeat(np.arange(len(ids)), n)
        learn = learn[doc]
        place = np.argsort(target, kind="stable")
        for bucket, part in _slices(target[place], spread.buckets):
            where = place[part]
            mine = where[told[where] == where] if len(hot) else where
            index = np.searchsorted(mine, told[where]) if len(mine) < len(where) else np.arange(len(where))
            numbers = np.take(code, mine, axis=1)
            line, which = np.nonzero(numbers == rare)
            rest = mine[which]
            hashes = np.where(line < order - 1, before[rest, np.minimum(line, order - 2)], token[rest])
            planes = numbers.view(np.uint8).reshape(-1, 4)
            heads = np.flatnonzero(np.diff(doc[where], prepend=-1))
            rows.append((step, bucket, len(mine), *(_zip(np.ascontiguousarray(planes[:, j])) for j in range(3)), _short_bytes(hashes),
                         _zip(np.bincount(index[learn[where]], minlength=len(mine)).astype("<u4")),
                         len(where), _zip(np.diff(index, prepend=-1).astype("<i4")), len(heads),
                         _zip(np.diff(doc[where][heads], prepend=0).astype("<u4")), _zip(np.diff(heads, append=len(where)).astype("<u4")), None, None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        step, stored = TaskContext.get().partitionId() << 32, Arrays(spec["folder"], spread.parts)
        for batch in batches:
            for k, stop, data, ends in steps(batch.column("__text"), STEP_BYTES):
                ids, learn = batch.column(id_col).slice(k, stop - k).to_pylist(), _flags(batch.column("__learn"))[k:stop]
                rows = told_of(step, ids, learn, data, ends, codes.value, stored)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                step += 1
            batch = data = rows = None  # for what follows
        give_back()

    return run


def _words_of(row, order: int, number: Codes) -> np.ndarray:
    """The windows of a row, one line for each place in them."""
    planes = np.zeros((row.n * order, 4), np.uint8)
    for j, raw in enumerate((row.low, row.middle, row.high)):
        planes[:, j] = _unzip(raw, len(planes), np.uint8)
    code = planes.view("<u4").ravel()
    out = number.word[code]
    out[code == number.rare] = _from_short(row.rare)
    return out.reshape(order, row.n)


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted values, their places, where among these each different value begins)."""
    place = np.argsort(key)
    key = key[place]
    return key, place, np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else place


def _of(place: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Which of the different values each place has."""
    out = np.empty(len(place), np.uint32)
    out[place] = np.repeat(np.arange(len(heads), dtype=np.uint32), np.diff(heads, append=len(place)))
    return out


def _levels(rows: list, order: int, spread: Spread, number: Codes, places: bool) -> Iterator[tuple]:
    """From the highest order down, of the different n-grams of a partition: those that are not whole, for each row of
    the order above (or window) its n-gram, counts, which n-grams are whole, contexts and last words of all windows,
    and a window of each n-gram. One is whole if no other partition has its context; else it is not counted in the order below."""
    words, done = np.empty((order, sum(r.n for r in rows)), np.uint64), 0
    for r in rows:
        words[:, done : done + r.n] = _words_of(r, order, number)
        done += r.n
    count = np.concatenate([_unzip(r.learned, r.n, "<u4") for r in rows]).astype(np.int64)
    contexts, token = _contexts(words[:-1].T), words[-1].copy()
    contexts[0] = contexts[0].copy()
    del words
    depth, line = spread.depth(contexts), np.arange(len(token))
    for level in range(order, 1, -1):
        key, place, heads = _grouped(_gram(contexts[level - 2][line], token[line]) if level < order else _gram(contexts[-1], token))
        count, line = np.add.reduceat(count[place], heads), line[place[heads]]
        whole = depth[line] < level if depth.max() > 1 else np.ones(len(line), bool)
        yield key[heads[~whole]], _of(place, heads) if places else None, count, whole, contexts[:level - 1], token, line
        del key, place, heads
        contexts = contexts[:level - 1]
        count = ((count > 0) & whole).astype(np.int64)


def _context_sums(context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the different contexts, which of them each n-gram has)."""
    known, place, heads = _grouped(context)
    count = count[place]
    out = np.zeros(len(heads), _CONTEXT)
    out["context"] = known[heads]
    out["total"] = np.add.reduceat(count, heads)
    kinds = np.add.reduceat(np.array([0, 1, 1 << 32, 0])[np.minimum(count, 3)], heads)  # n1 and n2 in one number
    out["n1"], out["n2"] = kinds & 0xFFFFFFFF, kinds >> 32
    out["n3"] = np.add.reduceat(count > 2, heads, dtype=np.int64)
    return out, _of(place, heads)


_FOUND = "kind string, level int, target int, n bigint, columns binary, counts binary, c1 bigint, c2 bigint, c3 bigint, c4 bigint, more bigint, grams bigint"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _sums(level: int, count: np.ndarray) -> tuple:
    return ("sum", level, -1, 0, _BLANK, _BLANK, *(int((count == k).sum()) for k in (1, 2, 3, 4)), int((count > 2).sum()), int((count > 0).sum()))


def _handed(level: int, columns: list[np.ndarray], count: np.ndarray, buckets: int) -> list[tuple]:
    """Rows for the buckets of n-grams, given as last word and contexts."""
    target = _bucket(_gram(columns[-1], columns[0]) if level > 1 else columns[0], buckets)
    by = np.argsort(target, kind="stable")
    return [("gram", level, k, int(p.stop - p.start), b"".join(c[by[p]].tobytes() for c in columns), _zip(count[by[p]].astype("<u4")), 0, 0, 0, 0, 0, 0)
            for k, p in _slices(target[by], buckets)]


def _added(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted different values, a place of each, their sums)."""
    key, place, heads = _grouped(key)
    return key[heads], place[heads], np.add.reduceat(count[place], heads) if len(heads) else count


def _counted(order: int, spread: Spread, codes):
    """Of a partition: counts of counts; n-grams whose context is hot, to be
    added up by :func:`_merge_found`; before how many words each word stands."""
    def run(rows: Iterator) -> Iterator[tuple]:
        rows = [r for r in rows if r.n]
        if not rows:
            return
        for level, (_, _, count, whole, contexts, token, line) in zip(range(order, 1, -1), _levels(rows, order, spread, codes.value, False), strict=True):
            yield _sums(level, count[whole])
            at = line[(count > 0) & ~whole]
            yield from _handed(level, [token[at], *(c[at] for c in contexts)], count[(count > 0) & ~whole], spread.parts)
        at = line[(count > 0) & whole]
        word, _, n = _added(token[at], np.ones(len(at), np.int64))
        yield from _handed(1, [word], n, spread.parts)
        del rows, count, whole, contexts, token, line, at
        give_back()

    return run


def _merge_found(folder: str, level: int, buckets: int):
    """A bucket of n-grams (or words) that several partitions counted: their
    sums, stored; sums of their contexts; what the next lower order counts."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        columns = np.concatenate([np.frombuffer(c, "<u8").reshape(level, -1) for c in rows["columns"]], axis=1)
        count = np.concatenate([_unzip(c, n, "<u4") for c, n in zip(rows["counts"], rows["n"], strict=True)]).astype(np.int64)
        key, at, count = _added(_gram(columns[-1], columns[0]) if level > 1 else columns[0], count)
        columns = columns[:, at]
        stored = np.zeros(len(key), _WORD)
        stored["word"], stored["n"] = key, count
        _save(folder, f"{'last' if level == 1 else f'found{level}'}-{int(rows['target'].iloc[0]):08d}", stored)
        out = [_sums(level, count)]
        if level > 1:
            sums, _ = _context_sums(columns[-1], count)
            out += [("context", level, -1, int(s["context"].astype(np.int64)), _BLANK, _BLANK, *(int(s[c]) for c in ("total", "n1", "n2", "n3")), 0, 0) for s in sums]
            # without its first word, each n-gram is one occurrence for the order below
            shorter = columns[:-1]
            _, at, seen = _added(_gram(shorter[-1], shorter[0]) if level > 2 else shorter[0], np.ones(len(key), np.int64))
            out += _handed(level - 1, list(shorter[:, at]), seen, buckets)
        return pd.DataFrame(out, columns=_FOUND_NAMES)

    return run


def _answered(order: int, spread: Spread, codes, model):
    """Of each step's texts: the sums of log10 probabilities over a partition's windows."""
    def run(rows: Iterator) -> Iterator[tuple]:
        spec, grams = model.value, []
        for r in rows:
            if r.n:
                grams.append(r)
            else:
                yield (r.step, -1, r.n_docs, r.docs, r.sizes, r.ids, r.base)
        if not grams:
            return
        stored = Arrays(spec["folder"], spread.parts)
        levels = []
        for key, of, c, whole, contexts, token, line in _levels(grams, order, spread, codes.value, True):
            levels.append((key, of, c, whole, contexts[-1][line]))
        token = token[line]
        del key, of, contexts, line
        low, types, floor = _lowest(spec)
        word, of = np.unique(token, return_inverse=True)
        seen = stored.numbers("last", word)
        p = (floor + (seen - low[np.minimum(seen, 3)]) / types)[of]
        for level in range(2, order + 1):
            key, of, c, whole, context = levels.pop()
            c[~whole] = stored.numbers(f"found{level}", key)
            known, at = _context_sums(context, c)
            hot, i = spec["hot"][level], np.flatnonzero(~whole)
            if len(i):  # sums of hot contexts come from all partitions
                j, ok = _find(hot["context"], context[i])
                known[at[i[ok]]] = hot[j[ok]]
            d, total = spec["discounts"][level], known["total"].astype(np.float64)
            share = np.where(total > 0, (d[1] * known["n1"] + d[2] * known["n2"] + d[3] * known["n3"]) / np.maximum(total, 1), 1)
            p = ((c - d[np.minimum(c, 3)]) / np.maximum(total, 1)[at] + share[at] * p)[of]
        logs, done = np.log10(p), 0
        for r in grams:
            mine = logs[done : done + r.n][np.cumsum(_unzip(r.places, r.n_places, "<i4"), dtype=np.int64) - 1]
            sizes = _unzip(r.sizes, r.n_docs, "<u4").astype(np.int64)
            done += r.n
            yield (r.step, r.target, r.n_docs, r.docs, np.add.reduceat(mine, np.cumsum(sizes) - sizes).tobytes(), None, None)
        del levels, grams, c, whole, context, known, at, p, logs, total, share
        give_back()

    return run


def _texts(schema: pa.Schema):
    """The rows of one step: its texts' numbers, with the sums of all buckets."""
    def run(rows: pa.Table) -> pa.Table:
        rows = sorted(rows.to_pylist(), key=lambda r: r["target"])
        own = rows[0]
        n, seen = (np.frombuffer(own[c], "<i8") for c in ("docs", "logs"))
        logs = np.zeros(own["n_docs"])
        for r in rows[1:]:
            logs[np.cumsum(_unzip(r["docs"], r["n_docs"], "<u4"), dtype=np.int64)] += np.frombuffer(r["logs"], "<f8")
        columns = (own["ids"], n, seen, np.frombuffer(own["base"], "<f8"), logs, 10 ** np.minimum(-logs / n, 300))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _codes(words: DataFrame, n_docs: int) -> Codes:
    """Of the most frequent words, ``CODED`` at most."""
    size = F.floor(F.log2("n") * 16)
    least, room = float("inf"), CODED
    for r in words.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():
        room -= r["count"]
        if room < 0:
            break
        least = r["size"]
    top = words.where(size >= F.lit(least)).select("word", "n", "learned").toArrow()
    word, n, learned = (c.to_numpy() for c in top.columns)
    by = np.argsort(-n, kind="stable")
    return Codes(np.append(END, word[by].view(np.uint64)), np.append(n_docs, learned[by]))


def train_and_score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> tuple[DataFrame, int]:
    """What :func:`score` gives for all rows with the model that :func:`train`
    makes of the rows where ``learn`` holds, and this model's tokens.

    The model of all n-grams, which is several times as large as the texts, is
    not stored. Every window goes once to the partition of its last context
    word, where all n-grams and contexts that end there meet, as numbers of
    frequent words by byte planes. Partitions are read twice: for the counts of
    counts, which give the discounts, and for the probabilities. Only counts of
    single words and of n-grams after hot contexts are stored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    folder, kind = shared_path(spark, "kneser-ney"), docs.schema[id_col].dataType.simpleString()
    texts = docs.select(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), learn.alias("__learn"))
    sums = [F.sum(c).alias(c) for c in ("n", "learned")]
    tally = via_table(texts.mapInArrow(_tally(order), _TALLY).groupBy("length", "word").agg(*sums), "word-counts")
    words = tally.where("length = 1")
    start = int(START.astype(np.int64))
    is_word = (F.col("word") != start) & (F.col("learned") > 0)
    total = words.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "learned", F.when(F.col("word") == start, F.col("learned")), is_word.cast("long")))).first()
    everywhere, tokens, n_docs, different = (int(x) for x in total)
    buckets = max(1, -(-everywhere // TOKENS_PER_BUCKET))
    hot = tally.where(F.col("n") * buckets > everywhere).select("length", "word").collect()
    spread = Spread(buckets, [np.array([r["word"] for r in hot if r["length"] == k], np.int64).view(np.uint64) for k in range(1, order)])
    spec = {"folder": folder, "order": order, "docs": n_docs, "tokens": tokens, "vocabulary": different + (n_docs > 0)}
    bucket = (F.expr("shiftrightunsigned(word, 16)") % spread.parts).cast("int").alias("bucket")
    words.where(is_word).select("word", F.col("learned").alias("n"), bucket).groupBy("bucket").applyInPandas(_save_words(folder), "n bigint").agg(F.sum("n")).first()
    codes = spark.sparkContext.broadcast(_codes(words, n_docs))

    rows = _WINDOWS.format(kind=kind)
    schema = to_arrow_schema(spark.createDataFrame([], rows).schema)
    dealt = texts.mapInArrow(_windows(order, spread, spec, codes, id_col, schema), rows).repartitionById(buckets, F.col("target")).rdd
    found = via_table(spark.createDataFrame(dealt.mapPartitions(_counted(order, spread, codes)), _FOUND, verifySchema=False), "found")
    discounts, grams, hot_sums, handed, low = {}, {}, {}, None, None
    for level in range(order, 0, -1):
        here = found.where(F.col("level") == level)
        if level == 1 or len(spread.hot[level - 2]):
            merged = here.where("kind = 'gram'") if handed is None else here.where("kind = 'gram'").unionByName(handed)
            merged = via_table(merged.groupBy("target").applyInPandas(_merge_found(folder, level, spread.parts), _FOUND), f"found-{level}")
            handed = merged.where("kind = 'gram'")
            here = here.where("kind = 'sum'").unionByName(merged)
            hot_sums[level] = merged.where("kind = 'context'").groupBy("n").agg(*(F.sum(c) for c in ("c1", "c2", "c3", "c4"))).collect() if level > 1 else []
        low = here.where("kind = 'sum'").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("c1", "c2", "c3", "c4", "more", "grams"))).first()
        discounts[level], grams[level] = np.array(_discounts(*low[:4])), int(low[5])
    contexts = {k: np.sort(np.array([(r[0] % (1 << 64), *r[1:]) for r in hot_sums.get(k, [])], _CONTEXT), order="context") for k in range(2, order + 1)}
    spec |= {"grams": grams, "discounts": discounts, "low_counts": (low[0], low[1], low[4]), "hot": contexts}
    model = spark.sparkContext.broadcast(spec)
    answers = spark.createDataFrame(dealt.mapPartitions(_answered(order, spread, codes, model)),
                                    f"step bigint, target int, n_docs bigint, docs binary, logs binary, ids array<{kind}>, base binary", verifySchema=False)
    result = f"{id_col} {kind}, n_tokens bigint, n_known bigint, base_score double, score double, perplexity double"
    return answers.groupBy("step").applyInArrow(_texts(to_arrow_schema(spark.createDataFrame([], result).schema)), result), tokens



def held_out(id_col: str = "doc_id") -> Column:
    return crc_mod(id_col, 10) == 0


def language_model_report(docs: DataFrame, order: int = REPORT_ORDER) -> DataFrame:
    """Learn from the rows that are not held out, score all."""
    scored, tokens = train_and_score(docs, ~held_out(), order=order)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score", "perplexity")
