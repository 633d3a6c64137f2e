"""Benchmark decontamination with one Aho-Corasick automaton over words.

Test questions and answers are normalised to words (:func:`alnum_words`).
Every 13 consecutive words of an item are a pattern (an item of fewer words
is one pattern). The automaton's alphabet are the words of the benchmark;
any other word of a text resets it. Each text is scanned once; matches come
as word positions and are mapped back to offsets of the original text.

The automaton is shipped only up to ``max_bytes`` of normalised item text.
A larger benchmark is dealt by item hash into as many parts as needed; each
part scans the texts with its own automaton and the hits of the parts are
united per text, so the result does not depend on the limit.

Defined results: a null or wordless text has no words and is clean; an item
without words is ignored; repeated items, and items with the same id, count
once; an item whose id is null is listed as the empty string; each input row
gives one output row, also when rows repeat; an empty benchmark leaves every
text clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_bytes, alnum_words, give_back, texts_of, via_table

WINDOW = 13
#: Normalised benchmark text that one automaton may hold (about 25 bytes of
#: worker memory for each).
MAX_BYTES = 16 << 20


class WindowAutomaton:
    """Aho-Corasick automaton over the windows of ``items`` (id, text)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        import ahocorasick

        self.word_ids: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            ids = tuple(self.word_ids.setdefault(w, len(self.word_ids) + 1) for w in alnum_words(text))
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                patterns.setdefault(ids[i : i + window], set()).add(item_id)
        self.automaton = None
        if patterns:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for pattern, owners in patterns.items():
                self.automaton.add_word(pattern, (len(pattern), frozenset(owners)))
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [first, end) that windows cover; ids of their items."""
        if self.automaton is None or not words:
            return [], set()
        get = self.word_ids.get
        spans: list[list[int]] = []
        owners: set[str] = set()
        for end, (length, items) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            first = end - length + 1
            owners |= items
            while spans and spans[-1][1] >= first:
                first = min(first, spans.pop()[0])
            spans.append([first, end + 1])
        return [(a, b) for a, b in spans], owners


def word_offsets(raw: bytes) -> list[tuple[int, int]]:
    """Character offsets [start, end) of each word in the original text."""
    import re

    text = alnum_bytes(raw).decode()
    return [m.span() for m in re.finditer(r"[^ ]+", text)]


def _parts(benchmark: DataFrame, max_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items, in parts of about ``max_bytes``; only one is on the driver at a time."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")
    ).where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // max_bytes) or 1
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1].encode()) for r in part.toLocalIterator()]


_SPAN = "struct<first:int,end:int,start_char:int,end_char:int>"
_ADDED = f"__n_words bigint, __n_hit bigint, __spans array<{_SPAN}>, __items array<string>"
_SPAN_ARROW = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "end", "start_char", "end_char")]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
             max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` with __n_words, __n_hit, __spans (merged: word positions and
    character offsets of the original text) and __items (sorted ids of the
    items found). No shuffle. A larger benchmark is scanned part after part: the
    rows with the hits so far are written to the shared folder before the next
    part is shipped, so one automaton lives at a time.
    """
    spark = docs.sparkSession
    found, shipped = docs, None
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for items in _parts(benchmark, max_bytes):
        if shipped is not None:
            found = via_table(found, "contamination-part")
            shipped.unpersist()
        first, shipped = shipped is None, spark.sparkContext.broadcast(items)
        found = found.mapInArrow(_scanner(shipped, docs.columns, text_col, window, first), f"{fields}, {_ADDED}")
    return found


def _scanner(shipped, columns: list[str], text_col: str, window: int, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WindowAutomaton(shipped.value, window)
        for batch in batches:
            n_words, n_hit, spans, owners = [], [], [], []
            before = [((), ())] * batch.num_rows if first else zip(
                batch.column("__spans").to_pylist(), batch.column("__items").to_pylist(), strict=True)
            for raw, (old_spans, old_items) in zip(texts_of(batch, text_col), before, strict=True):
                words = alnum_words(raw)
                hit, who = automaton.scan(words)
                hit = _merged(hit + [(s["first"], s["end"]) for s in old_spans])
                at = word_offsets(raw) if hit else []
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in hit))
                spans.append([{"first": a, "end": b, "start_char": at[a][0], "end_char": at[b - 1][1]} for a, b in hit])
                owners.append(sorted(who.union(old_items)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in columns] + [
                    pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, _SPAN_ARROW),
                    pa.array(owners, pa.list_(pa.string()))],
                [*columns, "__n_words", "__n_hit", "__spans", "__items"])
        give_back()

    return run


def contaminated() -> Column:
    """The contamination rule: at least one hit, and a twentieth of the words hit."""
    return (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Per row of ``docs``: the id, n_words, n_hit, spans, items and contaminated."""
    found = annotate(docs.select(id_col, text_col), benchmark, text_col, window, max_bytes)
    return found.select(id_col, *(F.col(f"__{c}").alias(c) for c in ("n_words", "n_hit", "spans", "items")),
                        contaminated().alias("contaminated"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest per document."""
    return find_contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW,
                      max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` without its contaminated rows, all columns as they were."""
    return annotate(docs, benchmark, text_col, window, max_bytes).where(~contaminated()).select(*docs.columns)
