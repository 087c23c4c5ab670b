"""Connected components of an edge table, by alternating stars.

Every round relinks each vertex to the smallest vertex it sees, first from above and
then from below, until nothing changes; the edges then form stars around the smallest
vertex of each component. Minima are pre-aggregated and the joins back have one row
per vertex on one side, so a vertex with very many edges can be split over tasks. Each
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moveatlas.llm.text import stored

MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    code = F.xxhash64("v", "u").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(code)).first())


def components(edges: DataFrame) -> DataFrame:
    """From edges (v, u), v != u, to stars: v, u with u the smallest of v's component.

    The smallest vertex of a component has no row of its own.
    """
    edges = stored(edges.select("v", "u").distinct(), "edges")
    before = _mark(edges)
    for _ in range(MAX_ROUNDS if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        above = both.join(least, "v").where(F.col("u") > F.col("v"))
        large = above.select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(low, "v").where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        own = low.select("v", F.col("m").alias("u"))
        edges = stored(moved.unionByName(own).distinct(), "edges")
        after = _mark(edges)
        if after == before:
            return edges
        before = after
    if before[0]:
        raise RuntimeError("components did not settle")
    return edges
