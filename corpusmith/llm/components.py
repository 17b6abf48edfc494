"""Connected components of an edge table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Every step is a shuffle of the edges on their
vertices, with minimum and link taken by aggregation and join; no component is ever gathered in one task, and the
result of each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each vertex's larger (or smaller) neighbours to the least vertex of its neighbourhood."""
    both = edges.select("u", "v")
    both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """vertex, root: the least vertex of the component of every vertex that has an edge. ``edges`` has u and v, of one
    orderable type without nulls; loops and repeats do no harm. Raises if ``max_rounds`` did not suffice, rather than
    return partial components."""
    now = materialise(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        # Stars at their least vertex are a fixed point, and their sum of roots no longer changes.
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
        seen = state
        now = materialise(_star(_star(now, large=True), large=False), "cc")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def one_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each group by ``order``; Spark cuts each task's rows of a group to one before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_cs_first", F.row_number().over(window)).filter("_cs_first = 1").drop("_cs_first")
