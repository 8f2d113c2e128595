"""Connected components of an edge table by alternating large and small stars.

Each round joins every edge with the least neighbour of one of its ends.  The
least neighbours are written first, so the edges' exchange serves the join
alone: a vertex of very many edges may be split over tasks, or the small table
sent to all of them.  Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm import scratch


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour above u, linked to the least of u and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")), "least").withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """u and its neighbours below, linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.table(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select("u", F.col("m").alias("v")))


def _edges(df: DataFrame) -> DataFrame:
    return scratch.table(df.where("u != v").distinct(), "edges")


def _stars(edges: DataFrame) -> bool:
    """Every upper end has one edge, and no vertex is an upper and a lower end: the lower ends are the components."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every vertex in links; component is its least id.

    Null ends and loops are ignored; repeated links count once; an empty table
    gives an empty one.  The rounds end when all edges form stars.
    """
    edges = _edges(links.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")))
    while not _stars(edges):
        edges = _edges(_small(_edges(_large(edges))))
    centres = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return scratch.table(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(centres), "linked")
