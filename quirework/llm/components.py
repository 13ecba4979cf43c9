"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import Scratch


def _fresh(df: DataFrame) -> DataFrame:
    """Deal rows anew, so that a following join shuffles both sides and Spark may split a hot key."""
    return df.repartition(max(2, df.sparkSession.sparkContext.defaultParallelism))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(_fresh(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(_fresh(least), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest reachable id for every id that has a link.

    ``links`` has columns u and v (long). Returns ``id, component_id``, one row per id
    that occurs in a link with another id; self-links, nulls and repeats have no effect, and no
    links give no rows. Each pass is two joins on aggregated minima and is written to
    the shared folder; the number of passes grows with the logarithm of the longest path.
    """
    edges = scratch.save(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark = tuple(now)
        step = scratch.save(_small_star(_large_star(edges)).distinct())
        scratch.drop(edges)
        edges = step
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).union(edges.select("v", "v").distinct())
