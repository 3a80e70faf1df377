"""Connected components of a distributed edge table by alternating star contraction.

Nothing is collected but one count and one checksum a round. Minima are found by
partial aggregates and handed back by joins, so a hub with very many neighbours
is never gathered in one task (adaptive execution splits a skewed join side). The
minima grow with the edges, so no join may broadcast them: they are merged by hint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop, written


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """Of rows (u, v): adds m, the least of u and all its v."""
    # Grouped by a struct, the minima are dealt anew for the join: adaptive execution splits only joins of two plain exchanges.
    least = pairs.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("m")).select("k.u", F.least("k.u", "m").alias("m"))
    return pairs.join(least.hint("merge"), "u")


def _round(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    small = _to_minimum(large)
    return (
        small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(small.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(edges: DataFrame, left: str, right: str, node: str = "node", label: str = "component") -> DataFrame:
    """One row for each node that has an edge: the node and the least node reachable from it.

    Null ends and loops are ignored; repeated edges and either direction are fine;
    without edges the result is empty.
    """
    spark = edges.sparkSession
    canonical = (
        edges.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
    )
    current, path = written(canonical, "edges")
    mark = None
    while True:
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            break
        mark = tuple(seen)
        following, later = written(_round(current), "edges")
        drop(spark, path)
        current, path = following, later
    children = current.select(F.col("u").alias(node), F.col("v").alias(label))
    roots = current.select(F.col("v").alias(node), F.col("v").alias(label)).distinct()
    return children.unionByName(roots)
