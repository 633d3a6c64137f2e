"""Exact ranked lexical search by sparse ball trees of integer impact vectors.

A document's vector holds, for each term of the queries that it contains, the
integer impact ``(10^9 tf) div (1000 tf + 20 m)``; other terms add nothing to
any query and are left out. The score of an item is the inner product with its
integer term weights.

1. One pass over the texts finds the term occurrences by word hash and writes
   the sparse counts; N, L and the terms' document counts are added up from
   that table.
2. Every task reads its vectors in groups of ``GROUP`` documents and builds a
   ball tree of each: nodes with a sparse centroid over the terms that occur
   below them and a radius. An item descends best first. For a document x
   below a node with centroid c and radius r, with q restricted to the terms
   that occur there, q.x <= q.c + |q| r. Radius and bound are rounded upward
   by more than the error of their doubles, and a subtree goes only if its
   bound is below the k-th score found; ties are visited. Leaves are scored in
   64-bit integers. The k best go on from group to group of the task.
3. The tasks' best are ranked per item; Spark keeps k of each task before the
   shuffle.

Queries are answered in blocks of about ``BLOCK_BYTES`` of item text, so what
is shipped has a bound; a larger benchmark takes more passes.

Rules: terms are maximal runs of ASCII letters and digits and of non-ASCII
characters, A-Z as a-z. Terms are recognised by a 64-bit hash.

Defined results: a null or empty text has no terms and is never found; an item
without terms, or none that any document holds, has no rows; repeated document
rows are ranked one by one; a null doc_id comes after all others of its score;
equal rows (item_id, text) of the benchmark are answered once; empty tables
give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import via_table
from .hashing import ALNUM, hash_words
from .pieces import steps

TOP = 50
#: Percent of length normalisation, and the saturation 2 * 10 of the impact.
LENGTH_PERCENT, SATURATION = 50, 20
#: Item text that is shipped and answered at a time.
BLOCK_BYTES = 4 << 20
#: Documents of a tree, and of a leaf.
GROUP, LEAF = 8_192, 64
#: Relative error that a bound or a radius is raised by; the doubles' own is below 1e-12 here.
SLACK = 1e-9

_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- vectors


def _vectors(terms):
    """Per document with any term: its length, and numbers and occurrences of the items' terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = terms.value
        for batch in batches:
            for k, stop, data, ends in steps(batch.column("__text")):
                words, counts = hash_words(data, ends, ALNUM)
                at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
                known = hashes[at] == words
                doc = np.repeat(np.arange(len(counts)), counts)[known]
                pair, tf = np.unique(doc * len(hashes) + at[known], return_counts=True)
                cut = np.searchsorted(pair, np.arange(len(counts) + 1) * len(hashes))
                term = (pair % len(hashes)).astype("<u4")
                tf = tf.astype("<u4")
                rows = [(term[a:b].tobytes(), tf[a:b].tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
                out = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(k, stop - k), pa.array(counts, pa.int64()),
                     pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
                    ["doc_id", "n", "terms", "tf"])
                yield out.filter(pa.array(counts > 0))

    return run


def _document_counts(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<u4")
            total += np.bincount(flat, minlength=n_terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["term", "df"])

    return run


# ---- the tree


class BallTree:
    """A ball tree over sparse rows (CSR: ``at``, ``term``, ``value``); no row is empty."""

    def __init__(self, at: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int, leaf: int = LEAF):
        self.at, self.term, self.value, self.n_terms, self.leaf = at, term, value, n_terms, leaf
        self.float = value.astype(np.float64)
        self.norm = np.add.reduceat(self.float * self.float, at[:-1])
        #: Per node: rows, terms, centroid, radius, children (none: a leaf).
        self.nodes: list[tuple] = []
        self._grow(np.arange(len(at) - 1))

    def _cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the rows' entries, and where each row begins among them."""
        size = self.at[rows + 1] - self.at[rows]
        begin = np.cumsum(size) - size
        return np.repeat(self.at[rows] - begin, size) + np.arange(int(size.sum())), begin

    def _distance(self, cells: np.ndarray, begin: np.ndarray, norm: np.ndarray, terms: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances to a sparse point, raised by more than their rounding."""
        dense = np.zeros(self.n_terms)
        dense[terms] = point
        dot = np.add.reduceat(self.float[cells] * dense[self.term[cells]], begin)
        own = float(point @ point)
        return np.maximum(norm - 2 * dot + own, 0) + SLACK * (norm + own)

    def _grow(self, rows: np.ndarray) -> int:
        cells, begin = self._cells(rows)
        norm = self.norm[rows]
        total = np.bincount(self.term[cells], weights=self.float[cells], minlength=self.n_terms)
        terms = np.unique(self.term[cells])
        centre = total[terms] / len(rows)
        away = self._distance(cells, begin, norm, terms, centre)
        number = len(self.nodes)
        radius = math.sqrt(float(away.max())) * (1 + SLACK)
        self.nodes.append(())
        children: tuple[int, ...] = ()
        if len(rows) > self.leaf:
            # the two sides: nearer to the row farthest from the centre, or to the row farthest from that one
            first = rows[int(away.argmax())]
            near = self._distance(cells, begin, norm, *self._row(first))
            second = rows[int(near.argmax())]
            side = near <= self._distance(cells, begin, norm, *self._row(second))
            smaller = min(int(side.sum()), len(rows) - int(side.sum()))
            if smaller < len(rows) // 16:  # a few outliers: halve by distance instead, so the depth stays logarithmic
                side = np.zeros(len(rows), bool)
                side[np.argsort(near, kind="stable")[: len(rows) // 2]] = True
            children = (self._grow(rows[side]), self._grow(rows[~side]))
        self.nodes[number] = (rows, terms, centre, radius, children)
        return number

    def _row(self, row: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.at[row], self.at[row + 1])
        return self.term[part], self.float[part]

    def bound(self, node: int, query: np.ndarray) -> float:
        """No row below the node has a larger inner product with the (dense) query."""
        _, terms, centre, radius, _ = self.nodes[node]
        held = query[terms]
        return (float(held @ centre) + math.sqrt(float(held @ held)) * radius) * (1 + SLACK) + 1

    def scores(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Exact inner products with the (dense, 64-bit integer) query."""
        cells, begin = self._cells(rows)
        return np.add.reduceat(query[self.term[cells]] * self.value[cells], begin)

    def visit(self, query: np.ndarray, as_float: np.ndarray, least):
        """Leaves best first: (rows, scores), until no bound reaches ``least()``."""
        queue = [(-self.bound(0, as_float), 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < least():
                return
            rows, _, _, _, children = self.nodes[node]
            if not children:
                yield rows, self.scores(rows, query)
            for child in children:
                b = self.bound(child, as_float)
                if b >= least():
                    heapq.heappush(queue, (-b, child))


class _Best:
    """The k best (score, id) of one item so far; a null id comes after all others."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.id, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least()
        if not keep.any():
            return
        score, doc, null = (np.concatenate([a, b[keep]]) for a, b in ((self.score, score), (self.id, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], doc[order], null[order]


def _search(shipped, n_terms: int, k: int):
    """Every item against the vectors of a task, a tree at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, n_docs, n_words = shipped.value
        best = [_Best(k) for _ in items]
        held: list[pa.RecordBatch] = []
        size = 0

        def search(rows: pa.Table) -> None:
            term = rows.column("terms").to_pylist()
            at = np.cumsum([0, *(len(t) // 4 for t in term)])
            term = np.frombuffer(b"".join(term), "<u4").astype(np.int64)
            tf = np.frombuffer(b"".join(rows.column("tf").to_pylist()), "<u4").astype(np.int64)
            n = rows.column("n").to_numpy()
            m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * n * n_docs) // n_words
            value = (1_000_000_000 * tf) // (1000 * tf + SATURATION * np.repeat(m, np.diff(at)))
            tree = BallTree(at, term, value, n_terms)
            doc = rows.column("doc_id").fill_null(0).to_numpy()
            null = rows.column("doc_id").is_null().to_numpy()
            query = np.zeros(n_terms, np.int64)
            as_float = np.zeros(n_terms)
            for terms, found in zip(items, best, strict=True):
                query[terms] = as_float[terms] = weight[terms]
                for some, score in tree.visit(query, as_float, found.least):
                    found.add(score, doc[some], null[some])
                query[terms] = as_float[terms] = 0

        for batch in batches:
            batch = batch.filter(pa.array([len(t) > 0 for t in batch.column("terms").to_pylist()], pa.bool_()))
            for a in range(0, batch.num_rows, GROUP):
                part = batch.slice(a, GROUP)
                if size + part.num_rows > GROUP:
                    search(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            search(pa.Table.from_batches(held))
        number = np.repeat(np.arange(len(best)), [len(b.id) for b in best])
        if len(number):
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int32()), pa.array(np.concatenate([b.id for b in best]), pa.int64(), mask=np.concatenate([b.null for b in best])),
                 pa.array(np.concatenate([b.score for b in best]), pa.int64())], ["item", "doc_id", "score"])

    return run


# ---- the operator


def _items(benchmark: DataFrame, max_bytes: int) -> Iterator[list[tuple]]:
    """(item_id, distinct terms) of the items with terms, a block at a time."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    items = items.withColumn("terms", F.array_distinct(F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(_TERM), F.lit(0)))).where(
        "size(terms) > 0")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // max_bytes)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        block = [(r[0], r[1]) for r in part.orderBy("item_id", "text").select("item_id", "terms").toLocalIterator()]
        if block:
            yield block


def lexical_search(docs: DataFrame, benchmark: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
                   max_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per item: its ``k`` documents of the highest scores: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    item_type = benchmark.schema["item_id"].dataType.simpleString()
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    out = None
    for block in _items(benchmark, max_bytes):
        words = sorted({t for _, terms in block for t in terms})
        hashes, _ = hash_words(np.frombuffer((joined := " ".join(words).encode()), np.uint8), np.array([len(joined)]), ALNUM)
        order = np.argsort(hashes)
        number = dict(zip((words[j] for j in order.tolist()), range(len(words)), strict=True))
        vectors = via_table(texts.mapInArrow(_vectors(spark.sparkContext.broadcast(hashes[order])), "doc_id bigint, n bigint, terms binary, tf binary"), "impacts")
        n_docs, n_words = vectors.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        counts = vectors.select("terms").mapInArrow(_document_counts(len(words)), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
        weight = np.zeros(len(words), np.int64)
        for term, df in counts.toLocalIterator():  # as many as the block has terms
            weight[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        queries = [np.array([number[t] for t in terms], np.int64) for _, terms in block]
        shipped = spark.sparkContext.broadcast((queries, weight, n_docs, n_words))
        found = vectors.mapInArrow(_search(shipped, len(words), k), "item int, doc_id bigint, score bigint")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(j, item) for j, (item, _) in enumerate(block)], f"item int, item_id {item_type}")
        ranked = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id bigint, score bigint") if out is None else out


ORACLE = """
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
len AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM len),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
      FROM benchmark),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN len USING (doc_id) JOIN weight USING (term), total GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
