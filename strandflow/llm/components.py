"""Connected components by alternating large-star and small-star rounds on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, ship


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge list (a, b) of longs; component is its least node.

    Every round replaces edges by edges towards the least neighbour seen, with pre-aggregated
    minima only: no neighbour list is ever collected, so a node with very many edges stays cheap.
    Repeated edges are allowed; self loops are left out, and so is a node that has nothing else; no edges give no rows.
    """
    e = materialize(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "cc")
    state = None
    while True:  # ends: the least node of a component comes nearer to all others in every round
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(e.select(F.col("hi"), F.col("lo")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        below = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(below, "hi").select(F.col("m").alias("lo"), F.explode(F.array("hi", "lo")).alias("hi"))
            .where("lo <= hi").distinct()
        )
        # A node that is its own least neighbour keeps a self loop, so no node is lost.
        new = materialize(small, "cc")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        release(e)
        e = new
        if now == state:
            break
        state = now
    return e.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))


ship(__name__)
