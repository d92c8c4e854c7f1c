"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tutorgauge.operators.joins import settled


def _mark(edges: DataFrame):
    """Rows and an order-free digest: equal for equal edge sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge; the component is its least node.

    Alternating stars: larger neighbours of a node move to the least node it knows, then smaller ones do.
    Each round settles in the shared folder, so a lost executor costs one round, and stops when the edge
    set no longer changes. Minima combine map-side and are settled before they are joined, so a node
    with very many edges is split by the adaptive skew join. Edges with a null end and loops say nothing
    and are left out; no edges give no rows.
    """
    least = lambda e: settled(e.groupBy("u").agg(F.min("v").alias("m")))
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    # u is the larger end from here on
    now = settled(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    before = None
    while (mark := _mark(now)) != before and mark[0]:
        before = mark
        # large star: only a node's smaller neighbours can lower its minimum
        known = least(now).withColumnsRenamed({"u": "k"})
        moved = now.join(known, now.v == known.k, "left").select("u", F.coalesce("m", "v").alias("v"))
        large = settled(moved.distinct())
        # small star
        known = least(large).withColumnRenamed("u", "k")
        turned = large.join(known, large.u == known.k).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = settled(turned.union(known.select(F.col("k").alias("u"), F.col("m").alias("v"))).distinct())
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
