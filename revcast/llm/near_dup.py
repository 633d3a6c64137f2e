"""MinHash near-duplicates with an LSH forest.

A document's set are its distinct shingles of five words (as 64-bit hashes),
its signature 128 minima. The forest has 32 trees; tree t orders the
signatures by the hash values from place 4t on. Documents with the same first
four values of a tree are a region of it. Within a region documents are sorted
by the values that follow, four at a time, so that neighbours are those with
the longest common prefix: in sparse regions four values decide, in crowded
ones eight, twelve or sixteen.

Candidates are confirmed on the full sets. To find whole components without
making all pairs of a region, rounds alternate with connected components:

1. copies (equal sets) are one class, which gets a number of its own; one row of
   each class goes on, and from here on a "document" is a class;
2. every document meets, over all trees, its neighbour of the longest common
   prefix and the smallest number before it in a region;
3. documents of regions that are not yet one component meet all others there
   that are still in another component, block against block. Pairs with at
   least ``LEAST_EQUAL`` equal minima are confirmed at once, on the full sets
   that lie beside them; only links leave the task.

So every pair that shares a region is confirmed, already connected, or has half
of its minima or fewer equal, 6.5 standard errors below the threshold. A pair of
similarity 0.75 shares no region in 5 of a million cases. Regions of any size
are cut in blocks by hash; a task holds two blocks at a time.

Defined results: an empty or null text has an empty set and is linked with
nothing; fewer than five words are one shingle; rows with a null id are kept,
with a null component, and link nothing; a repeated id is judged row by row by
its own text, and several of its rows may be ``kept``. ``drop_near_duplicates``
keeps one row of each component: the smallest id, of several rows with that id
the one with the smallest hash of its text, of equal rows one. Rows with empty
texts stay, equal ones (id and text) once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, mix64, via_table
from .components import components
from .hashing import SPACE, hash_words
from .pieces import steps

SHINGLE = 5
HASHES, DEPTH = 128, 4
TREES = HASHES // DEPTH
#: Percent of the union that the intersection must reach.
PERCENT = 75
#: Equal minima of 128 below which a pair is not confirmed: 0.75 less 6.5 standard errors of the estimate.
LEAST_EQUAL = 64
#: Documents in a block of a region.
BLOCK = 2_048
#: Rows (24 bytes each) that are shipped to all executors for a join; more are joined by shuffle.
MAX_SHIPPED_IDS = 1_000_000

_RNG = np.random.default_rng(11)
_ORDER = _RNG.integers(1, 1 << 62, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = _RNG.integers(1, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(1, 1 << 62, HASHES, dtype=np.uint64)


def shingle_sets(data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a UTF-8 buffer."""
    hashes, counts = hash_words(data, ends, SPACE)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(SHINGLE, n)):
        rolled[: n - j] += hashes[j:] * _ORDER[j]
    rolled = mix64(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= SHINGLE:
            out.append(np.unique(rolled[at : at + c - SHINGLE + 1]))
        elif c:  # the whole sequence; the length keeps it apart from shingles
            out.append(mix64((hashes[at : at + c] * _ORDER[:c]).sum(keepdims=True) + np.uint64(c)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, 128) minima; every set has at least one element."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat((flat ^ _FLIP[k]) * _FACTOR[k], at) >> np.uint64(32)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        for k, stop, data, ends in steps(batch.column("__text")):
            sets = shingle_sets(data, ends)
            full = [s for s in sets if len(s)]
            minima = iter(_signatures(full)) if full else iter(())
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else bytes(16) for s in sets]
            halves = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(k, stop - k), batch.column("text_hash").slice(k, stop - k), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()),
                 pa.array([next(minima).astype(">u4").tobytes() if len(s) else None for s in sets], pa.binary())],
                ["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "sig"])
    give_back()


def _list_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k, stop, data, ends in steps(batch.column("__text")):
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(data, ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(k, stop - k), pa.array(sets, pa.binary())], ["doc_id", "shingles"])
    give_back()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("__text")).withColumn(
        "text_hash", F.xxhash64("__text"))


def _shipped(rows: DataFrame) -> DataFrame:
    """For a join: broadcast if it is small, by its count."""
    return F.broadcast(rows) if rows.count() <= MAX_SHIPPED_IDS else rows


def _members(signed: DataFrame) -> DataFrame:
    """One row for each document and tree where its region has others: the
    region, the neighbour before it, the length of their common prefix in
    steps of four values, and the smallest id before it."""

    rows = signed.select("doc_id", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "doc_id", "tree", F.expr(f"xxhash64(substring(sig, tree * {4 * DEPTH} + 1, {4 * DEPTH}))").alias("k0"),
        *(F.expr(f"hash(substring(sig, (tree + {s}) % {TREES} * {4 * DEPTH} + 1, {4 * DEPTH}))").alias(f"k{s}") for s in (1, 2, 3)))
    region = Window.partitionBy("tree", "k0").orderBy("k1", "k2", "k3", "doc_id")
    before = region.rowsBetween(Window.unboundedPreceding, -1)
    same = [F.lag(f"k{s}").over(region) == F.col(f"k{s}") for s in (1, 2, 3)]
    depth = F.when(~same[0], 1).when(~same[1], 2).when(~same[2], 3).otherwise(4)
    return rows.select("tree", "k0", "doc_id", F.lag("doc_id").over(region).alias("near"), F.lead("doc_id").over(region).alias("__next"),
                       F.min("doc_id").over(before).alias("hub"), depth.alias("depth")).where(
        "near IS NOT NULL OR __next IS NOT NULL").drop("__next")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _first_pairs(members: DataFrame) -> DataFrame:
    best = members.where("near IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.struct("depth", (-F.col("near")).alias("near"))).alias("best"), F.min("hub").alias("hub"))
    near = best.select("doc_id", (-F.col("best.near")).alias("other"))
    return near.unionByName(best.select("doc_id", F.col("hub").alias("other"))).where(
        "doc_id <> other").select(*_pair("doc_id", "other")).distinct()


def _similar_enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                common = int(_overlaps(x, [y])[0])
                keep.append(100 * common >= PERCENT * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "sa", "sb").mapInArrow(_similar_enough, "a bigint, b bigint")


def _open_blocks(members: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of regions that are in several components, dealt into blocks,
    and the pairs of blocks that meet in such a region.

    A document's place is its component of documents that share open regions, in
    whichever tree: so a group is compared once and not once for each tree. A
    place of any size is cut in blocks; which of them meet follows from the
    regions.
    """
    rows = members.select("tree", "k0", "doc_id").join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").withColumn(
        "root", F.coalesce("root", "doc_id"))
    mixed = rows.groupBy("tree", "k0").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("doc_id").alias("first")).where("lo < hi")
    rows = via_table(rows.join(mixed.select("tree", "k0", "first"), ["tree", "k0"]), "open-regions")
    places = components(rows.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    docs = rows.select("doc_id", "root").distinct().join(places.select(F.col("node").alias("doc_id"), F.col("root").alias("place")), "doc_id")
    # a large component has blocks of its own, the others of a place share some; all by hash, so no task orders a place
    sizes = docs.groupBy("place", "root").agg(F.count("*").alias("n"))
    shared = sizes.groupBy("place").agg(F.coalesce(F.sum(F.when(F.col("n") < BLOCK, F.col("n"))), F.lit(0)).alias("small"))
    own = F.xxhash64("root", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("n") / BLOCK)))
    block = F.when(F.col("n") < BLOCK, F.pmod(F.xxhash64("root"), F.ceil((F.col("small") + 1) / BLOCK))).otherwise(own)
    docs = via_table(docs.join(sizes, ["place", "root"]).join(shared, "place").select("doc_id", "root", "place", block.alias("block")), "open-documents")
    parts = rows.join(docs.select("doc_id", "place", "block"), "doc_id").select("tree", "k0", "place", "block").distinct()
    one = parts.select("tree", "k0", F.struct("place", "block").alias("x"))
    other = parts.select("tree", "k0", F.struct("place", "block").alias("y"))
    meet = one.join(other, ["tree", "k0"]).where("x <= y").select("x", "y").distinct()
    span = docs.groupBy(F.struct("place", "block").alias("x")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    # blocks are cut by component: two that hold one and the same have nothing to compare
    meet = meet.join(span, "x").join(span.select(F.col("x").alias("y"), F.col("lo").alias("lo_y"), F.col("hi").alias("hi_y")), "y").where(
        "NOT (lo = hi AND lo_y = hi_y AND lo = lo_y)").select("x", "y")
    return docs, meet


def _overlaps(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sorted arrays with ``own``."""
    sizes = [len(o) for o in others]
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    return np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum([0, *sizes[:-1]]))


def _links(doc: np.ndarray, root: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], split: int) -> list[tuple[int, int]]:
    """Links that join components: among all rows, or between those before and
    from ``split`` on. Pairs with enough equal minima are confirmed on their
    full sets; what a link has joined is not compared again.
    """
    n, out = len(doc), []
    if split == n:  # small components first: a row meets what comes after its own component
        _, of, size = np.unique(root, return_inverse=True, return_counts=True)
        order = np.lexsort((doc, of, size[of]))
        doc, root, sig, sets = doc[order], root[order], sig[order], [sets[k] for k in order.tolist()]
        ends = np.searchsorted(of[order] + size[of[order]] * n, of[order] + size[of[order]] * n, "right")
    else:
        ends = np.full(split, split)
    root = root.copy()
    for x in range(min(split, n)):
        first = int(ends[x])
        if first >= n:
            continue
        near = first + np.flatnonzero(root[first:] != root[x])
        near = near[(sig[near] == sig[x]).sum(1) >= LEAST_EQUAL] if len(near) else near
        if not len(near):
            continue
        common = _overlaps(sets[x], [sets[y] for y in near.tolist()])
        size = np.array([len(sets[y]) for y in near.tolist()])
        for y in near[100 * common >= PERCENT * (len(sets[x]) + size - common)].tolist():
            if root[y] != root[x]:
                out.append((min(doc[x], doc[y]), max(doc[x], doc[y])))
                root[root == root[y]] = root[x]
    return out


_SIDES = ["x", "y", "side", "doc_id", "root", "sig", "shingles"]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks come sorted; at most one is carried from batch to batch."""
    held: pa.Table | None = None

    def links(rows: pa.Table, last: bool) -> pa.RecordBatch:
        nonlocal held
        new = np.zeros(rows.num_rows, bool)
        for side in ("x", "y"):
            for field in ("place", "block"):
                k = rows.column(side).combine_chunks().field(field).to_numpy()
                new[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        if last:
            cuts.append(rows.num_rows)
        held = rows.slice(cuts[-1])
        doc, root, side = (rows.column(c).to_numpy() for c in ("doc_id", "root", "side"))
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = rows.slice(a, b - a)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u4").reshape(-1, HASHES)
            sets = [np.frombuffer(s, "<u8") for s in part.column("shingles").to_pylist()]
            out += _links(doc[a:b], root[a:b], sig, sets, int((side[a:b] == 0).sum()))
        got = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], ["a", "b"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None and held.num_rows:
            rows = pa.concat_tables([held, rows])
        if rows.num_rows:
            yield links(rows, False)
    if held is not None and held.num_rows:
        yield links(held, True)
    give_back()


def _open_links(docs: DataFrame, meet: DataFrame, signed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components, block against block."""
    place = F.struct("place", "block")
    rows = docs.join(signed.select("doc_id", "sig"), "doc_id").join(sets, "doc_id")
    left = rows.withColumn("x", place).join(meet, "x").withColumn("side", F.lit(0))
    right = rows.withColumn("y", place).join(meet.where("x < y"), "y").withColumn("side", F.lit(1))
    dealt = left.select(_SIDES).unionByName(right.select(_SIDES)).repartition("x", "y").sortWithinPartitions("x", "y", "side", "root", "doc_id")
    return dealt.mapInArrow(_compare, "a bigint, b bigint").distinct()


def _judged(texts: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, class (fp1, fp2), the component's smallest row (first_id, first_hash)."""
    signed = via_table(texts.mapInArrow(_sign, "doc_id bigint, text_hash bigint, n_shingles bigint, fp1 bigint, fp2 bigint, sig binary"), "signatures")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("fp1", "fp2").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("sig").alias("sig"))  # equal sets have equal signatures
    classes = via_table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    members = via_table(_members(classes.select(F.col("class").alias("doc_id"), "sig")), "regions")
    ids = members.select(F.col("doc_id").alias("class")).distinct()
    near = via_table(classes.join(ids, "class", "left_semi").select("class", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "sig"), "region-classes")
    rows = texts.join(_shipped(near.select("class", "doc_id", "text_hash")), ["doc_id", "text_hash"]).select(F.col("class").alias("doc_id"), "__text")
    sets = rows.mapInArrow(_list_sets, "doc_id bigint, shingles binary").where(F.length("shingles") > 0)
    if not signed.groupBy("doc_id", "text_hash").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty():
        sets = sets.dropDuplicates(["doc_id"])  # rows that occur again, with id and text
    sets = via_table(sets, "shingles", "lz4")
    signatures = near.select(F.col("class").alias("doc_id"), "sig")

    links = via_table(_confirmed(_first_pairs(members), sets), "links")
    roots = components(links)
    open_docs, meet = _open_blocks(members, roots)
    more = via_table(_open_links(open_docs, meet, signatures, sets), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    found = classes.join(roots, F.col("class") == F.col("node"), "left").select("fp1", "fp2", "first", F.coalesce("root", "class").alias("root"))
    smallest = found.groupBy("root").agg(F.min("first").alias("smallest"))
    found = found.join(smallest, "root").select("fp1", "fp2", F.col("smallest.doc_id").alias("first_id"), F.col("smallest.text_hash").alias("first_hash"))
    return signed.select("doc_id", "text_hash", "n_shingles", "fp1", "fp2").join(found, ["fp1", "fp2"], "left")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, and the copies' class (fp1, fp2)."""
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("first_id")).otherwise(F.col("doc_id")))
    return _judged(_texts(docs, id_col, text_col)).select("doc_id", "n_shingles", component.alias("component_id"), "fp1", "fp2").withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dup_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component, all columns as they were."""
    judged = via_table(_judged(_texts(docs, id_col, text_col)), "judged")
    first = (F.col("doc_id") == F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    gone = judged.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0) & ~first).select(
        F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__gone_hash")).distinct()
    left = docs.join(_shipped(gone), (docs[id_col].cast("bigint") == F.col("__gone")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__gone_hash")), "left_anti")
    if judged.where("doc_id IS NOT NULL").groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        return left
    # rows that occur again stay once
    row = Window.partitionBy(id_col, text_col).orderBy(F.lit(0))
    return left.withColumn("__n", F.when(F.col(id_col).isNull(), 1).otherwise(F.row_number().over(row))).where("__n = 1").drop("__n")
