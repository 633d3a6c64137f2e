"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.session import cut_lineage

#: Links up to which a round runs in one task and without a shuffle (16 bytes
#: each); the operations and the result are the same for more.
ONE_TASK_LINKS = 250_000


def _both(first, second):
    """Two (u, v) rows for each row, without a union, so a single partition stays one."""
    return F.inline(F.array(F.struct(first[0].alias("u"), first[1].alias("v")), F.struct(second[0].alias("u"), second[1].alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``links`` (a, b).

    Each round hangs every node's larger neighbours on its smallest one (large
    star), then its smaller neighbours and itself (small star), until nothing
    changes; the links then are stars around the roots. Only aggregates and
    joins by node, so a node with very many links is pre-aggregated and its
    join split; every round is checkpointed.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    few = edges.count() <= ONE_TASK_LINKS
    u, v, m = F.col("u"), F.col("v"), F.col("m")
    seen = None
    while True:
        edges = edges.coalesce(1) if few else edges
        both = edges.select(_both((u, v), (v, u)))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(v.alias("u"), m.alias("v"))
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        edges = cut_lineage(small.select(_both((v, m), (u, m))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(_both((u, v), (v, v))).distinct().select(u.alias("node"), v.alias("root"))
