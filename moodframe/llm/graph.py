"""Connected components of an edge table, distributed.

Alternating large-star and small-star steps: every vertex ends linked to the
smallest vertex of its component.  Each step is a partial-aggregated minimum
per vertex joined back to its edges, so a vertex with very many links is
combined before the shuffle and its join partition can be split.  Nothing is
collected; edge tables are written between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodframe.llm.store import drop, written_at


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b.  Of a vertex, its neighbours and itself the
    smallest is found; the larger neighbours move to it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Of a vertex's smaller neighbours the smallest is found; the others and
    the vertex itself move to it."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.withColumnRenamed("low", "b")).filter("a > b").distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether every larger vertex has one edge, to a vertex that has none to a
    smaller one: then the edges are the components."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    )
    seen = ends.groupBy("v").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    return seen.filter("down > 1 or (down > 0 and up > 0)").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of the (a, b) edges; the component
    is its smallest vertex.  Self-links and repeats are allowed; a null end
    drops the edge."""
    spark = edges.sparkSession
    ordered = edges.filter("a <> b").select(F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b"))
    now, path = written_at(ordered.distinct(), "edges")
    while not _is_done(now):
        after, new_path = written_at(_small_star(_large_star(now)), "edges")
        drop(spark, path)
        now, path = after, new_path
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
