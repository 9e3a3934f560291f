"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.llm.common import saved


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least node around that node."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its neighbours below it are linked to the least of these."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def connected_components(links: DataFrame) -> DataFrame:
    """`node`, `root` for every node of `links` (u, v): the root is the least node of its component.

    Only least neighbours are aggregated, never neighbour lists, so a node with very many links is
    no unbounded group. Each round is written to the shared folder; the stars settle after a number
    of rounds that grows with the logarithm of the longest path. Self links and repeats are allowed;
    rows with a null end are ignored.
    """
    ends = links.where("u is not null and v is not null")
    e = saved(ends.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == mark or state[0] == 0:
            break
        mark = tuple(state)
        e = saved(_small_star(_large_star(e).distinct()).distinct(), "stars")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
