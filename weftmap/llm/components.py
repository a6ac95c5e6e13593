"""Connected components of a table of links, by alternating large and small stars.

Each round replaces links by links to the least neighbour: a large star moves
what is above a node to the least of its neighbourhood, a small star the node
and what is below it. Nothing is gathered by node: the least neighbour is an
aggregate that combines before the shuffle, and is joined back, so a node with
very many neighbours is rows that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmap.llm._session import cut


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).filter("a != b").distinct()


def _stars(links: DataFrame) -> bool:
    """Does every node above another have one link, and no link go on from a centre?"""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below"))
    ends = ends.union(links.select("b", F.lit(0), F.lit(1)))
    told = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return not told.filter("above > 1 OR (above = 1 AND below = 1)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of numbers -> (node, component): the least node that each linked node reaches."""
    links = links.select("a", "b").filter("a != b")
    while True:
        links = cut(_small(_large(links)), "links")
        if _stars(links):
            break
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
