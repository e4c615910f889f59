"""Connected components of an edge table by alternating large-star and small-star steps.

Edges are ``(a, b)`` of long ids.  Each step replaces edges by ones that point at
smaller ids (Kiveris et al. 2014) and keeps the components; it ends when every edge
points at its component's smallest id.  Each round is written to the shared folder.

A hub's edges never meet under one key: they are dealt over ``LANES`` lanes by their
other end, minima are taken by lane first, and a hub's minimum goes back to its lanes
and from there to the edges.  Null ids and self-edges link nothing; repeated edges count
once; an empty table has no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weft.llm import common

LANES = 64


def _with_least(near: DataFrame) -> DataFrame:
    """Edges with ``m``, the least ``b`` of their ``a``."""
    near = near.withColumn("lane", F.pmod(F.xxhash64("b"), F.lit(LANES)).cast("int"))
    lanes = near.groupBy("a", "lane").agg(F.min("b").alias("m"))
    least = lanes.groupBy("a").agg(F.min("m").alias("m"))
    return near.join(lanes.select("a", "lane").join(least, "a"), ["a", "lane"]).drop("lane")


def _large_star(edges: DataFrame) -> DataFrame:
    near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(near).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    moved = _with_least(down)
    return moved.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for every id that has an edge to another; ``root`` is the smallest id it reaches."""
    edges = common.written(edges.where("a <> b").distinct(), "edges")
    before = None
    while True:
        # a star forest is stable: the count and the sums no longer move; they are taken while the edges are written
        seen = Observation()
        sums = [F.sum(x.cast("decimal(38,0)")) for x in (F.col("b"), F.xxhash64("a", "b"))]
        moved = _small_star(_large_star(edges)).where("a <> b").distinct()
        edges = common.written(moved.observe(seen, F.count(F.lit(1)).alias("n"), sums[0].alias("b"), sums[1].alias("h")), "edges")
        now = seen.get
        if now == before or not now["n"]:
            break
        before = now
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("root")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
