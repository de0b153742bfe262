"""Connected components of a link table, by large and small stars.

Each round links every vertex to the smallest one it knows of, first for the
larger neighbours, then for the smaller; links shrink to stars around the
smallest vertex of each component in about log(n) rounds. Only sums, joins and
distinct rows are used, so a vertex with very many links is combined in the
tasks first and its join rows are split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilo.llm.common import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(vertex, smallest) for every vertex of ``links`` (a, b: bigint).

    Self-links and repeated links do no harm; nulls are ignored. Vertices
    that are the smallest of their component are included.
    """
    edges = written(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        lowest = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("m"))
        # Larger neighbours of each vertex are linked to the smallest it knows.
        large = (both.where("b > a").join(lowest, F.col("a") == F.col("v"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        # So are the smaller ones, and the vertex itself.
        least = large.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
        small = (large.join(least, F.col("a") == F.col("v")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("v", "m")).where("a <> b").distinct())
        edges = written(small, "links")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("smallest")).union(
        edges.select("b", "b").distinct())
