"""Approximate nearest neighbours by inner product, with learned partitions.

1. A bounded sample of the distinct vectors gets its exact neighbour graph,
   which is cut into equal cells by recursive bisection (the graph's second
   eigenvector, split at its median).
2. A small network (one hidden layer) learns to tell a vector's cell. It
   places every vector of the table in its most probable cell.
3. A query goes to its ``probes`` most probable cells, and all of their
   vectors are compared with it in double precision. ``probes`` is measured:
   on sample rows that the network did not see, the smallest number of cells
   that hold ``RECALL`` of their true neighbours.

Equal vectors are one class; as ties go to the smaller id, only the k + 1
smallest ids of a class can be in a result, so no others travel. Equal query
vectors are searched once. Small cells share a task, large cells are cut in
blocks of rows, and queries in blocks, so no task grows with the table and a
common vector is no hot spot.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components, and rows with a null id, take no part; shorter vectors
count as filled up with zeros; a repeated row counts once; a query with fewer
than k candidates gets all; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import via_table

#: Distinct vectors that the partitions are learned from, at most.
SAMPLE = 8_192
#: Share of a sample query's true neighbours that the probed cells must hold.
RECALL = 0.95
ROWS_PER_CELL = 400
MAX_CELLS = 256
GRAPH_DEGREE = 12
#: Vectors and queries of a task.
BLOCK_ROWS, BLOCK_QUERIES = 4_096, 1_024


def _matrix(rows, dim: int | None = None) -> np.ndarray:
    lists = [np.asarray(r, np.float64) for r in rows]
    dim = dim or max((len(r) for r in lists), default=0)
    out = np.zeros((len(lists), dim))
    for k, r in enumerate(lists):
        out[k, : min(len(r), dim)] = r[:dim]
    return out


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    k = min(k, scores.shape[1])
    return np.argpartition(-scores, k - 1, axis=1)[:, :k]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, a block of rows at a time."""
    out = []
    for a in range(0, len(x), 256):
        scores = x[a : a + 256] @ x.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        out.append(_top(scores, k))
    return np.concatenate(out)


def bisect(neighbours: np.ndarray, cells: int) -> np.ndarray:
    """Balanced cells (a power of two) of a neighbour graph, by recursive spectral bisection."""
    n = len(neighbours)
    cell = np.zeros(n, np.int64)
    rng = np.random.default_rng(5)
    parts = [np.arange(n)]
    while len(parts) < cells:
        halves = []
        for part in parts:
            local = np.full(n, -1)
            local[part] = np.arange(len(part))
            to = local[neighbours[part]]
            a, b = np.nonzero(to >= 0)
            u, v = np.concatenate([a, to[a, b]]), np.concatenate([to[a, b], a])
            degree = np.bincount(u, minlength=len(part)) + 1.0
            root = np.sqrt(degree)
            x = rng.standard_normal(len(part))
            for _ in range(40):  # power iteration of (I + D^-1/2 (A + I) D^-1/2) / 2 off its first eigenvector
                y = x / root
                x = 0.5 * (x + (np.bincount(u, y[v], len(part)) + y) / root)
                x -= root * (x @ root) / (root @ root)
                x /= np.linalg.norm(x) or 1.0
            order = np.argsort(x / root, kind="stable")
            halves += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
        parts = halves
    for k, part in enumerate(parts):
        cell[part] = k
    return cell


class Router:
    """A network of one hidden layer that tells how probable each cell is."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights
        self.dim = weights[0].shape[0]

    @staticmethod
    def fit(x: np.ndarray, cell: np.ndarray, cells: int, hidden: int = 128, epochs: int = 15) -> Router:
        rng = np.random.default_rng(3)
        w = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden),
             rng.standard_normal((hidden, cells)) * np.sqrt(1 / hidden), np.zeros(cells)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        scale = np.sqrt((x * x).sum(1).mean()) or 1.0
        w[0] = w[0] * np.sqrt(x.shape[1]) / scale
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h = np.maximum(x[part] @ w[0] + w[1], 0)
                z = h @ w[2] + w[3]
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(part)), cell[part]] -= 1
                p /= len(part)
                back = (p @ w[2].T) * (h > 0)
                t += 1
                for k, g in enumerate((x[part].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    w[k] = w[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        return Router(w)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3]


def learn(sample: np.ndarray, cells: int, k: int) -> tuple[Router, int]:
    """The router, and how many cells a query is sent to."""
    if cells == 1 or len(sample) < 2 * cells:
        return Router([np.zeros((sample.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)]), 1
    held = max(1, len(sample) // 8)  # rows the network does not see
    seen = sample[held:]
    router = Router.fit(seen, bisect(neighbour_graph(seen, GRAPH_DEGREE), cells), cells)
    queries = sample[: min(held, 512)]
    truth = queries @ sample.T
    truth[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    near = _top(truth, k)
    of = router.logits(sample).argmax(1)
    ranks = np.argsort(np.argsort(-router.logits(queries), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(ranks, of[near], axis=1).ravel())
    return router, int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))))]) + 1


def _valid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    clean = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vec"))
    return clean.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))


def _fit(cells: int, k: int):
    """Learns from the sample in one task; one row comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [v for batch in batches for v in batch.column("vec").to_pylist()]
        if rows:
            router, probes = learn(_matrix(rows), cells, k)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(router.weights)], pa.binary()), pa.array([probes], pa.int32())], ["router", "probes"])

    return run


def _bundles(sizes: list[tuple[int, int]]) -> dict[int, tuple[int, int]]:
    """cell -> (bundle, blocks of rows): neighbouring small cells share a bundle of about a block, a large cell has several blocks."""
    out, bundle, held = {}, 0, 0
    for cell, n in sorted(sizes):
        blocks = -(-n // BLOCK_ROWS)
        if held and held + n > BLOCK_ROWS:
            bundle, held = bundle + 1, 0
        out[cell] = (bundle, blocks)
        held += n
        if blocks > 1:
            bundle, held = bundle + 1, 0
    return out


def _place(rows: DataFrame, shipped, columns: str) -> DataFrame:
    """``rows`` with ``cell``, the number of the most probable one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(shipped.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                best = router.logits(_matrix(part.column("vec").to_pylist(), router.dim)).argmax(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best, pa.int32())], [*part.schema.names, "cell"])

    return rows.mapInArrow(run, f"{columns}, cell int")


def _send(rows: DataFrame, shipped, bundles: dict[int, tuple[int, int]], columns: str, probes: int) -> DataFrame:
    """One row for each bundle that a query's most probable cells lie in, with these cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = Router(shipped.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                logits = router.logits(_matrix(part.column("vec").to_pylist(), router.dim))
                row, bundle, blocks, to = [], [], [], []
                for x, cells in enumerate(np.argsort(-logits, axis=1, kind="stable")[:, :probes].tolist()):
                    sent: dict[tuple[int, int], list[int]] = {}
                    for c in cells:
                        if c in bundles:  # else no row lies in it
                            sent.setdefault(bundles[c], []).append(c)
                    for (b, n), own in sent.items():
                        row.append(x)
                        bundle.append(b)
                        blocks.append(n)
                        to.append(own)
                taken = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(bundle, pa.int32()), pa.array(blocks, pa.int32()), pa.array(to, pa.list_(pa.int32()))],
                    [*part.schema.names, "bundle", "row_blocks", "cells"])

    return rows.mapInArrow(run, f"{columns}, bundle int, row_blocks int, cells array<int>")


def _search(k: int):
    """The k nearest of a block of rows for each query of a block, cell by cell."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        mine = rows["ids"].isna().to_numpy()
        dim = max(map(len, rows["vec"]))
        q, base = _matrix(rows["vec"][mine], dim), _matrix(rows["vec"][~mine], dim)
        q_ids, ids, cells = rows["vec_id"][mine].to_numpy(), rows["ids"][~mine].to_list(), rows["cells"][~mine].map(lambda c: c[0]).to_numpy()
        first = np.array([i[0] for i in ids], np.int64)
        asked: dict[int, list[int]] = {}
        for x, own in enumerate(rows["cells"][mine]):
            for c in own:
                asked.setdefault(c, []).append(x)
        found: dict[int, list[tuple[float, int]]] = {}
        for c, who in asked.items():
            here = np.flatnonzero(cells == c)
            if not len(here):
                continue
            scores = q[who] @ base[here].T
            n = min(k, len(here)) - 1
            # all that may tie with the k-th: the order of additions differs in a matrix product, by no more than this
            apart = 4 * dim * np.finfo(float).eps * np.linalg.norm(q[who], axis=1) * np.linalg.norm(base[here], axis=1).max()
            least = -np.partition(-scores, n, axis=1)[:, n] - apart
            for x, row, low in zip(who, scores, least, strict=True):
                at = here[row >= low]
                score = (base[at] * q[x]).sum(1)
                best = np.lexsort((first[at], -score))[:k]  # later rows have k pairs before them
                found.setdefault(x, []).extend((-s, i) for s, y in zip(score[best].tolist(), at[best], strict=True) for i in ids[y])
        out = [(q_ids[x], i, -s) for x, pairs in found.items() for s, i in heapq.nsmallest(k, pairs)]
        return pd.DataFrame(out, columns=["q", "vec_id", "score"]).astype({"q": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row of ``is_query`` (a condition on vec_id)."""
    spark = rows.sparkSession
    valid = _valid(rows, id_col, vector_col)
    copy = F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))
    classes = via_table(valid.withColumn("__copy", copy).where(F.col("__copy") <= k + 1).groupBy("vec").agg(
        F.array_sort(F.collect_set("vec_id")).alias("ids")), "vector-classes")
    n = classes.count()
    cells = 1 << int(np.clip(np.round(np.log2(max(1, n) / ROWS_PER_CELL)), 0, np.log2(MAX_CELLS)))
    sample = classes.orderBy(F.xxhash64("vec"), F.element_at("ids", 1)).limit(SAMPLE).select("vec").coalesce(1)
    learned = sample.mapInArrow(_fit(cells, k), "router binary, probes int").first()
    if learned is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    probes = min(cells, probes or learned["probes"])
    shipped = spark.sparkContext.broadcast(pickle.loads(learned["router"]))  # about 100 KB

    placed = via_table(_place(classes, shipped, "vec array<double>, ids array<bigint>"), "cells")
    sizes = [(r[0], r[1]) for r in placed.groupBy("cell").count().collect()]  # at most MAX_CELLS
    bundles = _bundles(sizes)
    of = F.create_map(*[F.lit(x) for c, b in bundles.items() for x in (c, b[0])])
    blocks = F.create_map(*[F.lit(x) for c, b in bundles.items() for x in (c, b[1])])
    queries = valid.where(is_query).select("vec_id", "vec").distinct()
    searched = queries.groupBy("vec").agg(F.min("vec_id").alias("q"))
    sent = via_table(_send(searched, shipped, bundles, "vec array<double>, q bigint", probes), "probes")
    loads = sent.groupBy("bundle").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("query_blocks"))
    loads = F.broadcast(loads)  # at most MAX_CELLS rows
    first = F.element_at("ids", 1)
    base = placed.select("vec", "ids", F.array("cell").alias("cells"), of[F.col("cell")].alias("bundle"),
                         F.pmod(F.xxhash64(first), blocks[F.col("cell")]).cast("int").alias("i")).join(loads, "bundle").select(
        "bundle", "i", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("j"), first.alias("vec_id"), "vec", "ids", "cells")
    asked = sent.join(loads, "bundle").select(
        "bundle", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("i"),
        F.pmod(F.xxhash64("q"), "query_blocks").cast("int").alias("j"), F.col("q").alias("vec_id"), "vec",
        F.lit(None).cast("array<bigint>").alias("ids"), "cells")
    found = base.unionByName(asked).groupBy("bundle", "i", "j").applyInPandas(_search(k + 1), "q bigint, vec_id bigint, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k + 1).drop("__r")
    # from searched vectors back to all queries with that vector
    own = queries.join(searched, "vec").select(F.col("vec_id").alias("query_id"), "q")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.join(top, "q").where("query_id <> vec_id").withColumn("rank", F.row_number().over(rank)).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_report(rows: DataFrame) -> DataFrame:
    return nearest(rows, F.col("vec_id") % 20 == 0)
