"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import cut_lineage


#: Narrow rows a task; few links are not dealt to all of a session's partitions in every round.
PART_ROWS = 20_000


def _star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest node near it; u > v in the result."""
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # Each node also keeps its own link to the smallest.
    return out.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node's smaller neighbours, and itself, to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return out.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that is not itself its component's smallest node.

    No step gathers a node's neighbours: minima are partial sums and the join back is one row a link.
    Every round's links are written to the shared folder.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, parts = None, 1 + edges.count() // PART_ROWS
    while True:
        starred = _star(edges.coalesce(parts)).coalesce(parts)
        edges = cut_lineage(_small_star(starred).coalesce(parts))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, parts = tuple(now), 1 + now[0] // PART_ROWS
