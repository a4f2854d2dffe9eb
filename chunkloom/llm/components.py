"""Connected components by alternating large and small stars, in a logarithmic number of rounds even for long chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm.common import forget, stored


def _large(e: DataFrame) -> DataFrame:
    """Every node's greater neighbours are moved to its least one."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(e: DataFrame) -> DataFrame:
    """Every node and its lesser neighbours are moved to the least of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _stars(e: DataFrame) -> bool:
    """Whether every node has one lesser neighbour at most, and those that have one are nobody's."""
    ends = e.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select("b", F.lit(0), F.lit(1)).toDF("id", "up", "down"))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each node of the edges (a, b); root is the least id that it is connected with.

    Every round writes its edges to the shared folder and removes the last one's; minima are pre-aggregated, so a node
    with any number of neighbours needs no task of its own.  Loops and repeated edges do no harm, edges with a null end
    are ignored, no edges give no rows.  The result reads one stored table, whatever the number of rounds.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(e):
        far = stored(_large(e), "edges")
        near = stored(_small(far), "edges")
        forget(e, far)
        e = near
    return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
