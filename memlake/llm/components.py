"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.tables import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v), u > v. Ties the neighbours of each node, the larger or the smaller ones, to its least neighbour."""
    near = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = near.join(least, "u")
    if large:
        tied = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return tied.filter("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b) but the least of its component, which names it.

    Links may repeat, point either way or tie a node to itself. No links give an empty table. Every round writes its
    links to the shared folder and deletes those of the one before; rounds grow with the logarithm of the longest path.
    """
    scratch = Scratch(links.sparkSession)
    now = scratch.saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        before, now = now, scratch.saved(_star(_star(now, True), False), "links")
        scratch.drop(before)
        mark, last = _mark(now), mark
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
